"""Sentence units of texts in many languages, by document-centred disambiguation.

A full stop is ambiguous: it ends a sentence, an abbreviation, or both. What stands unambiguously elsewhere decides. The document
is asked first: a word whose stop is followed by a comma or a small letter somewhere in it, and which never stands without its
stop there, is an abbreviation in all of it; a word that stands in it without a stop is an ordinary one; a capitalised word in
the middle of a sentence is a name. Where the document is silent, the corpus answers with the same evidence, counted in one pass
over all documents: abbreviations, those that stand before numbers, whether they can end a sentence (they close paragraphs), and
words that open sentences. Only where both are silent does a short list of common abbreviations count. Scripts have their own
terminators and rules; nothing depends on a language label.
"""

from __future__ import annotations

import contextlib
import gc
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.session import cut

# Common abbreviations, in lower case and without the last stop.
#: They stand before something and do not end a sentence.
NEVER_END = frozenset(
    "mr mrs ms dr prof rev gen st mt no nos fig figs sec ch vol pp art cf e.g i.e vs approx ca incl excl max min est dept "
    "jan feb mar apr jun jul aug sep sept oct nov dec "
    "hr fr nr abb tab bzw z.b d.h vgl bspw evtl ggf inkl zzgl bd kap ziff abs sog str ges i.d.r "
    "m mm mme mlle p.ex chap env n av "
    "sr sra srta dra p.ej núm cap aprox pág ej "
    "т.е тыс рис см п ок стр ул им гл табл проф млн млрд "
    "د أ ص डॉ श्री रु सं प्रो พ.ศ ค.ศ".split()
)
#: They may stand at the end of a sentence as well as inside it.
MAY_END = frozenset("etc ltd inc corp co jr u.s u.k e.u a.m p.m usw m.b.h ee.uu т.д т.п г руб др коп мин إلخ น".split())
GERMAN_MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())
#: The commonest function words of German.
GERMAN_WORDS = frozenset("der die das den dem des ein eine einen und oder aber nicht auch ist sind war wird wurde werden hat für mit von bei auf aus zum zur am im zu nach über als wie wir sie".split())

STRONG = "。！？｡．؟۔।॥"
TERM = ".!?…" + STRONG
_TERMS = re.compile(f"[{re.escape(TERM)}]+")
_ASCII_TERMS = re.compile("[.!?]+")
_MARKS = re.compile("[\"“”„«»‹›「」『』‘’()（）\\[\\]［］{}【】《》〈〉]")
_PAIRS = {"(": ")", "（": "）", "[": "]", "［": "］", "{": "}", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』", "«": "»", "‹": "›", "“": "”\"", "„": "“”\"", "‘": "’"}
_CLOSERS = set("\"”’»›)）]］}」』】》〉“")
_OPENERS = set("\"“„«‹(（[［{「『【《〈‘¿¡'")
_PAUSE = set(",，、;；:：—–")
_INVISIBLE = "​‌‍⁠﻿­"
_TRIM = " \t\n\r\x0b\x0c\x85\xa0  　" + "".join(map(chr, range(0x2000, 0x200B))) + "   " + _INVISIBLE
#: A name of a table, column or file, which may begin a sentence in small letters.
_NAMED = re.compile(r"\w_\w|\w\.[a-z_]\w")
_HIDDEN = dict.fromkeys(map(ord, _INVISIBLE))
_LINE = re.compile(r"[^\n\r  ]*(?:\r\n|[\n\r  ]|\Z)")
_ITEM = re.compile(r"[ \t]*(?:(?P<bullet>[-*•])|(?P<num>\d{1,3})[.)]|\[\d{1,2}:\d{2}(?::\d{2})?\]|(?P<head>#{1,6}))[ \t]+")
_DATED = re.compile("|".join(["Quartal", *sorted(GERMAN_MONTHS)]))
_THAI = re.compile(r"(?<=[ก-ฺเ-๎])[ \t\xa0]+(?=[ก-ฺเ-๎])")
#: A letter with its marks: vowel signs and accents are not letters to ``re``.
_L = "(?:[^\\W\\d_][\u0300-\u036f\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]*)"
_PART = re.compile(f"{_L}{{1,3}}\\.")
_EDGE = re.compile("[\"“”„«»‹›「」『』()（）\\[\\]［］{}【】《》〈〉,;!?…。、，：；！？]")
#: Words of scripts with blanks; Han, kana and compatibility characters end one.
_CODE = re.compile("[A-Z]{2,}\\d+")
_APART = re.compile("[’'\\-]")
_WORD = re.compile(f"(?:(?![\u3040-\u9fff\uf900-\ufaff])(?:{_L}|[\\w.\\-’']))*(?![\u3040-\u9fff\uf900-\ufaff])(?:{_L}|\\w)")


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is item) of the stretches that end without a stop: paragraphs, list items, chat lines, headings. The
    start is behind list marks and time stamps."""
    start = end = None
    item = False
    last_num = None  # the number of the list item that the block before was
    for m in _LINE.finditer(text):
        s, e = m.span()
        if s == e:
            break
        line = text[s:e]
        if not line.strip(_TRIM):
            if start is not None:
                yield start, end, item
            start = None
            continue
        mark = _ITEM.match(line)
        if mark and mark["num"]:
            # in running text a line can begin with a number and a stop by chance
            n = int(mark["num"])
            mark = mark if last_num == n - 1 or start is None or (n == 1 and not _DATED.match(line, mark.end())) else None
        if mark:
            if start is not None:
                yield start, end, item
            last_num = int(mark["num"]) if mark["num"] else None
            start, end, item = s + mark.end(), e, bool(mark["bullet"] or mark["num"])
            if mark["head"]:
                yield start, end, True
                start = None
        else:
            if start is None:
                start, item, last_num = s, False, None
            end = e
    if start is not None:
        yield start, end, item


def enclosed(t: str) -> list[tuple[int, int]]:
    """The outermost quotations and brackets of a block, from the opening to the closing mark; marks without partner count not."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _MARKS.finditer(t):
        ch, i = m[0], m.start()
        before, after = t[i - 1 : i], t[i + 1 : i + 2]
        if ch == "’" and (after.isalnum() or not any(c == "’" for c, _ in stack)):
            continue
        k = next((k for k in range(len(stack) - 1, -1, -1) if ch in stack[k][0]), None)
        if k is not None and not (ch == '"' and (not before or before.isspace()) and after.strip()):
            found.append((stack[k][1], i))
            del stack[k:]
        elif ch == '"':
            stack.append(('"', i))
        elif ch in _PAIRS:
            stack.append((_PAIRS[ch], i))
        elif ch == "»" and after.strip() and (not before or before.isspace()):
            stack.append(("«", i))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


_PLAIN = re.compile("[A-Za-z\u00c0-\u024f\u0400-\u04ff]+(?=[ ,;:\n])")


def starter(t: str, i: int) -> str:
    """What stands at ``i``, for comparing sentence starts: a word, two characters of a script without blanks, or a class."""
    m = _PLAIN.match(t, i)
    if m:
        return m[0]
    c = t[i : i + 1]
    if c.isdigit():
        return "<num>"
    if "\u3040" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff":
        return t[i : i + 2]
    m = _WORD.match(t, i)
    if not m:
        return ""
    w = m[0]
    if _NAMED.search(w):
        return "<id>"
    return "<code>" if _CODE.fullmatch(w) else _APART.split(w)[0]


@dataclass
class Knowledge:
    """What the corpus says of words, in small letters: sentence starters (as written); abbreviations, with whether they can
    end a sentence; those of them that stand before numbers; and the forms (as written) that stand without a stop more often
    than with one."""

    starters: frozenset[str] = frozenset()
    abbreviations: dict[str, bool] = field(default_factory=dict)
    ordinary: frozenset[str] = frozenset()
    numbered: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        #: Words that are looked at closely.
        self.doubtful = frozenset(self.abbreviations) | NEVER_END | MAY_END


_STOP = re.compile(r"\.(?=(\s*)(\S?))")
_STRONG_START = re.compile(r"[。！？।؟]\s*(?=\w)")
_LETTERS = re.compile(f"(?:{_L}|\\.)+")
_OUTER = "\"“”„«»‹›「」『』‘’'()（）[]［］{}【】《》〈〉,;:!?…。、，：；！？*#|"


def _word(form: str) -> bool:
    """Does ``form`` hold letters, their marks and stops only?"""
    return form.isalpha() or (len(form) <= 24 and _LETTERS.fullmatch(form) is not None and form != ".")


def _form(t: str, lo: int, stop: int) -> str:
    """The word before the stop at ``stop``, with the parts of an abbreviation written apart."""
    w = t[max(t.rfind(" ", lo, stop) + 1, lo) : stop]
    if len(w) > 3 and w.isalpha():
        return w
    near = t[max(lo, stop - 40) : stop]
    return _before(near if near.isascii() else near.translate(_HIDDEN))


def observe(text: str, seen: Counter, tokens: Counter) -> None:
    """Count the unambiguous occurrences of one text, (kind, word): what opens it, and what follows the stop of a word (the
    end of a block, a comma, a small letter, a number, anything else). ``tokens`` counts what stands between blanks."""
    for s, e, item in blocks(text):
        t = text[s:e].rstrip(_TRIM)
        i = len(t) - len(t.lstrip(_TRIM))
        while t[i : i + 1] in _OPENERS and t[i : i + 1]:
            i += 1
        w = starter(t, i)
        if w and not (item and w[:1].islower()):
            seen["start", w] += 1
        if not t.isascii():
            for m in _STRONG_START.finditer(t):
                seen["start", starter(t, m.end())] += 1
        for m in _STOP.finditer(t):
            gap, c = m[1], m[2]
            i = m.start()
            if (not gap and c and c not in ",;:") or not i or t[i - 1] in ". )" or t[i - 1].isdigit():
                continue
            form = _form(t, 0, i)
            if not form or not _word(form):
                continue
            if not c:
                kind = "end"
            elif c in ",;:":
                kind = "comma"
            elif c.isdigit():
                kind = "num"
            elif c.islower() and not _NAMED.search(t[m.end(1) : m.end(1) + 40].split(None, 1)[0]):
                kind = "small"
            else:
                kind = "open"
            seen[kind, form] += 1
    if "." in text:
        tokens.update(text.split())


def _bare(tokens: Counter) -> Counter:
    """Words without a stop behind them, from tokens with the marks around them."""
    out: Counter = Counter()
    for w, n in tokens.items():
        if len(w) <= 24:
            w = w.strip(_OUTER)
            if w.isalpha() or (w and w[-1] != "." and "." not in w and _word(w)):
                out[w] += n
    return out


@contextlib.contextmanager
def _no_gc() -> Iterator[None]:
    """Nothing here makes cycles, and looking for them among many small tuples takes time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_KINDS = ["start", "end", "comma", "small", "num", "open", "bare"]
#: A small letter behind a stop speaks for an abbreviation only of words up to this length: some texts have no capitals.
SHORT = 6


def learn(docs: DataFrame, rare: float = 5e-6) -> Knowledge:
    """Corpus knowledge from all texts. Kept are starters that make up at least ``rare`` of all starts (and stand 3 times), so
    at most 1 / ``rare`` of them, and abbreviations by the same rule, whatever the size of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tokens = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            rows = [(k, w, w if k == "start" else w.lower(), n) for (k, w), n in seen.items()] + [("bare", w, w.lower(), n) for w, n in _bare(tokens).items()]
            seen.clear()
            tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(("string", "string", "string", "int64"))], ["kind", "form", "low", "n"])

        with _no_gc():
            for b in batches:
                for t in b.column(0).to_pylist():
                    observe(t, seen, tokens)
                if len(seen) + len(tokens) > 200_000:
                    yield flush()
            yield flush()

    per = docs.select("text").where("text IS NOT NULL").mapInArrow(count, "kind string, form string, low string, n long").groupBy("form", "low").pivot("kind", _KINDS).agg(F.sum("n")).na.fill(0)
    per = cut(per, "words")
    forms = per.where("start = 0 OR form = low").select("*", (F.col("end") + F.col("comma") + F.col("small") + F.col("num") + F.col("open")).alias("dots"))
    words = per.where("end + comma + small + num + open + bare > 0").groupBy(F.lower("low").alias("word")).agg(*(F.sum(k).alias(k) for k in _KINDS[1:]))
    dots = F.col("end") + F.col("comma") + F.col("small") + F.col("num") + F.col("open")
    total = per.agg(F.sum("start"), F.sum(dots)).first()
    starts = per.where((F.col("start") >= 3) & (F.col("start") >= rare * (total[0] or 0))).select("form")
    inside = F.col("comma") + F.when(F.length("word") <= SHORT, F.col("small")).otherwise(0)
    # seen inside a sentence often, or before numbers, or, being short, never at an end and hardly ever without the stop
    often = (inside >= F.lit(0.3) * dots) & (F.col("bare") <= 2 * dots)
    always = (F.length("word") <= 4) & (dots >= 10) & (F.col("end") <= 0.01 * dots) & (F.col("bare") <= 0.05 * dots)
    number = (F.col("num") >= 0.5 * dots) & (dots >= 5)
    known = words.where((dots >= 3) & (dots >= rare * (total[1] or 0)) & (often | always | number)).select("word", (F.col("end") > 0.03 * dots).alias("ends"), number.alias("numbered")).collect()
    names = [r.word for r in known]
    doubtful = docs.sparkSession.createDataFrame([(w,) for w in sorted({*names, *NEVER_END, *MAY_END})], "low string")
    ordinary = forms.join(F.broadcast(doubtful), "low", "left_semi").where("bare > dots").select("form")  # of at most 1 / rare words
    return Knowledge(frozenset(r.form for r in starts.collect()), {r.word: r.ends for r in known}, frozenset(r.form for r in ordinary.collect()), frozenset(r.word for r in known if r.numbered))


_FOLLOWED = re.compile(r"\.(?:\s*[,;:]|\s+(?=[^\W\d_]))")


def _stands(text: str, w: str) -> bool:
    """Does ``w`` stand in ``text`` as a word, without a stop on either side?"""
    i = text.find(w)
    while i >= 0:
        j = i + len(w)
        if not (i and (text[i - 1].isalnum() or text[i - 1] in "_.")) and not (j < len(text) and (text[j].isalnum() or text[j] in "_.")):
            return True
        i = text.find(w, j)
    return False


class _Document:
    """What one document says about its own words; asked first, and only where a stop is in doubt."""

    def __init__(self, text: str, know: Knowledge):
        self.text, self.know = text, know
        self._low: str | None = None
        self._german: bool | None = None
        self._bare: dict[str, bool] = {}
        #: Words whose stop stands inside a sentence here.
        self.inside: set[str] = set()
        for m in _FOLLOWED.finditer(text):
            i, j = m.span()
            comma = text[j - 1] in ",;:"
            if i and (comma or text[j].islower()) and text[i - 1] not in ". )" and not text[i - 1].isdigit():
                w = _form(text, max(0, i - 60), i)
                if not w or not _word(w) or (not comma and (len(w) > SHORT or _NAMED.search(text[j : j + 40].split(None, 1)[0]))):
                    continue
                self.inside.add(w.lower())

    @property
    def german(self) -> bool:
        if self._german is None:
            self._german = len(GERMAN_WORDS.intersection(self.text.split())) >= 3
        return self._german

    def name(self, w: str) -> bool:
        """Does ``w`` stand here capitalised in the middle of a sentence?"""
        text, i = self.text, self.text.find(" " + w)
        while i >= 0:
            j = i + 1 + len(w)
            if i and (text[i - 1].isalnum() or text[i - 1] in "_,") and not text[j : j + 1].isalnum():
                return True
            i = text.find(" " + w, j)
        return False

    def bare(self, w: str, low: bool = False) -> bool:
        """Does ``w``, as it is written or (``low``) in any case, stand here without a stop?"""
        got = self._bare.get((w, low))
        if got is None:
            if low and self._low is None:
                self._low = self.text.lower()
            got = self._bare[w, low] = _stands(self._low if low else self.text, w)
        return got

    def own(self, low: str) -> bool:
        """Is ``low`` an abbreviation by this document?"""
        return low in self.inside and not self.bare(low, True)

    def abbreviation(self, form: str) -> tuple[bool, bool] | None:
        """None: an ordinary word. Else whether it can end a sentence, and whether then only before a known starter (not
        before numbers or small letters): so do words that are usually ordinary, or that stand before numbers."""
        low = form.lower()
        last = low.rsplit(".", 1)[-1]
        word = low if low in self.know.doubtful else last if last in self.know.doubtful else None
        mine = self.own(low)
        if word is None:
            return (True, False) if mine else None
        if not mine and word == low and (self.bare(form) or form in self.know.ordinary) and low not in MAY_END:
            return True, True
        ends = self.know.abbreviations.get(word)
        if ends is None:
            ends = word in MAY_END
        return ends, word in self.know.numbered


def _before(t: str) -> str:
    """The word at the end of ``t``, with the parts of an abbreviation written apart (z. B)."""
    parts = t.split()
    if not parts or t[-1:].isspace():
        return ""
    w = _EDGE.split(parts[-1])[-1]
    for p in parts[-2:-5:-1]:
        p = _EDGE.split(p)[-1]
        if not w or w[0] == "." or len(w.split(".", 1)[0]) > 3 or not _PART.fullmatch(p):
            break
        w = p + w
    return w


_DIGITS = re.compile(r"\d{1,2}")
_INITIAL = re.compile(r"(?:\w\.)*[A-ZА-ЯЁ]")
#: A number before a single small letter, which then is a unit (5 h).
_UNIT = re.compile(r"\d[ \xa0]?\Z")
_SINGLES = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]")
_INNER_END = re.compile(f"([{re.escape(TERM)}]+)[\"”’»)）」』]*\\Z")
_STRONG_SET = frozenset(STRONG)
_SEEN = re.compile(r"[^\W_]")
_THAI_LETTER = re.compile("[\u0e00-\u0e7f]")


def _is_end(doc: _Document, t: str, term: str, stop: int, end: int, quoted: int | None, unit: int) -> bool:
    """Does a unit end at ``end``, behind the terminators ``term`` (which begin at ``stop``) and closing marks? ``quoted``: where
    the quotation or bracket opened that closes here. ``unit``: the start of the unit."""
    n = len(t)
    nxt = end
    while nxt < n and t[nxt] in _TRIM:
        nxt += 1
    if nxt == n:
        return False  # the end of the block is one anyway
    c, gap = t[nxt], nxt > end
    if c in _PAUSE or (c in _CLOSERS and c not in _OPENERS):
        return False
    strong = not _STRONG_SET.isdisjoint(term)
    if quoted is None:
        if strong:
            return True
        if gap and c.isupper():  # the common case: nothing is in doubt
            if term[0] in "!?":
                return True
            if term == ".":
                w = t[max(t.rfind(" ", unit, stop) + 1, unit) : stop]
                if len(w) > 3 and w.isalpha() and (w := w.lower()) not in doc.inside and w not in doc.know.doubtful:
                    return True
    first = nxt
    while first < n and t[first] in _OPENERS:
        first += 1
    word = starter(t, first)
    known = word in doc.know.starters
    f = t[first : first + 1]
    if strong:
        return known or (not t[unit:quoted].strip(_TRIM) and t[quoted] in "(（[［【")
    if c == "-" or not word:
        return False if c == "-" else gap
    upper, lower = f.isupper() or f.istitle(), f.islower()
    if not gap:
        if "…" in term and "\u3040" <= t[stop - 1 : stop] <= "\u9fff":
            return known
        glued = upper and (t[first + 1 : first + 2].islower() or t[first + 1 : first + 2] == ".") and known
        return glued and (t[max(stop - 2, 0) : stop].islower() or t[stop - 1 : stop].isdigit() or quoted is not None)
    opens = not lower or word == "<id>" or known
    if quoted is not None:
        return opens if upper or lower or f.isdigit() else known
    if term != ".":
        return opens or "…" not in term and ".." not in term
    ch = t[stop - 1 : stop]
    if ch == ")" or (ch.isdigit() and stop - unit > 3 and len(t[stop - 3 : stop].split(None, 1)[0]) == 3):
        return opens or ch == ")"  # no word stands before the stop
    w = _form(t, unit, stop)
    if _DIGITS.fullmatch(w) and not lower and (word in GERMAN_MONTHS or doc.german):
        return not f.isalpha() or (word not in GERMAN_MONTHS and known)
    low = w.lower()
    said = doc.abbreviation(w) if low else None
    if said is None or (not said[0] and not doc.own(low)):
        if _INITIAL.fullmatch(w) or said is not None:
            return False
        if _SINGLES.fullmatch(w):
            return known and (upper or f.isdigit()) and w.islower() and _UNIT.search(t, max(unit, stop - 4), stop - 1) is not None
        # a small letter behind an ordinary word: text that was put into small letters
        return opens or (len(low) >= 3 and low.isalpha())
    if len(w) == 1 and w.isupper():
        return False  # an initial
    ends, only_known = said
    if not ends:
        return False
    if only_known:
        return upper and known
    if lower:
        return opens
    if upper and not doc.german and not doc.own(low):
        return known or not doc.name(word)
    return known or f.isdigit()


def sentence_ends(text: str | None, know: Knowledge = Knowledge()) -> list[tuple[int, int]]:
    """(start, end) of the units of a text: 0-based start, end behind the last visible character."""
    if not text:
        return []
    doc = _Document(text, know)
    out: list[tuple[int, int]] = []
    ascii_text = text.isascii()
    marks, thai_text = _MARKS.search(text) is not None, not ascii_text and _THAI_LETTER.search(text) is not None
    terms = _ASCII_TERMS if ascii_text else _TERMS
    inside, doubtful = doc.inside, know.doubtful
    for s, e, _ in blocks(text):
        t = text[s:e].rstrip(_TRIM)
        n = len(t)
        pairs = enclosed(t) if marks else []
        opens = [a for a, _ in pairs]

        def within(i: int) -> bool:
            k = bisect_right(opens, i) - 1
            return k >= 0 and pairs[k][0] <= i <= pairs[k][1]

        cuts: list[int] = []
        if pairs:
            spots: list[tuple[int, int, str, int | None]] = []  # end, stop, terminators, opening mark
            for m in terms.finditer(t):
                stop, end = m.span()
                if end < n and t[end].isalnum() and t[stop] == "." and end == stop + 1 and not (t[end].isupper() or t[end].istitle()):
                    continue  # a number, a file, a version
                if not within(stop):
                    while end < n and t[end] in _CLOSERS and not within(end):
                        end += 1
                    if end < n:
                        spots.append((end, stop, m[0], None))
            for a, b in pairs:
                m = _INNER_END.search(t[a + 1 : b].rstrip(_TRIM))
                if m and b + 1 < n:
                    spots.append((b + 1, a + 1 + m.start(), m[1], a))
            spots.sort()
            for end, stop, term, quoted in spots:
                if _is_end(doc, t, term, stop, end, quoted, cuts[-1] if cuts and cuts[-1] <= stop else 0):
                    cuts.append(end)
        else:
            unit = 0
            for m in terms.finditer(t):
                stop, end = m.span()
                if end < n:
                    if end == stop + 1 and t[stop] == ".":
                        c = t[end]
                        if c == " ":
                            if t[end + 1].isupper():  # the common case, as _is_end has it
                                w = t[max(t.rfind(" ", unit, stop) + 1, unit) : stop]
                                if len(w) > 3 and w.isalpha() and (w := w.lower()) not in inside and w not in doubtful:
                                    cuts.append(end)
                                    unit = end
                                    continue
                        elif c.isalnum() and not (c.isupper() or c.istitle()):
                            continue  # a number, a file, a version
                    while end < n and t[end] in _CLOSERS:
                        end += 1
                    if end < n and _is_end(doc, t, m[0], stop, end, None, unit):
                        cuts.append(end)
                        unit = end
        if thai_text:
            cuts = sorted({*cuts, *(m.start() for m in _THAI.finditer(t) if not within(m.start()))})
        cuts.append(n)
        unit = 0
        for end in cuts:
            piece = t[unit:end]
            body = piece.lstrip(_TRIM)
            a = s + end - len(body)
            size = len(body.rstrip(_TRIM))
            if not size:
                continue
            if unit and not body[0].isalnum() and _SEEN.search(t, unit, end) is None:
                out[-1] = (out[-1][0], a + size)  # marks alone go to the unit before
            else:
                out.append((a, a + size))
            unit = end
    return out


def split_sentences(docs: DataFrame, know: Knowledge | None = None, with_text: bool = True) -> DataFrame:
    """(doc_id, sent_no, sent_start, sent_end, sentence) of documents (doc_id, text); places are 1-based code points.

    Null texts and texts without visible characters have no rows. ``know``: corpus knowledge; without it, it is learnt from
    ``docs``. ``with_text``: false leaves the column ``sentence`` out. Documents are independent, so nothing is shuffled but
    the word counts of the corpus pass.
    """
    know = learn(docs) if know is None else know
    shared = docs.sparkSession.sparkContext.broadcast(know)
    names = ["doc_id", "sent_no", "sent_start", "sent_end", *(["sentence"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _no_gc():
            for b in batches:
                texts = b.column(1).to_pylist()
                places = [sentence_ends(t, shared.value) for t in texts]
                n = np.array([len(p) for p in places], np.int64)
                flat = np.array([x for p in places for x in p], np.int32).reshape(-1, 2)
                no = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1).astype(np.int32)
                cols = [b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))).cast("int64"), pa.array(no), pa.array(flat[:, 0] + np.int32(1)), pa.array(flat[:, 1])]
                if with_text:
                    cols.append(pa.array([t[x:y] for t, p in zip(texts, places) for x, y in p], "string"))
                yield pa.RecordBatch.from_arrays(cols, names)

    out = "doc_id long, sent_no int, sent_start int, sent_end int" + (", sentence string" if with_text else "")
    return docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, out)
