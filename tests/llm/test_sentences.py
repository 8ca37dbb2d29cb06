from __future__ import annotations

import pytest

from tarnwork.llm.sentences import Knowledge, blocks, enclosed, learn, sentence_ends, split_sentences

KNOW = Knowledge(frozenset(["The", "On", "Мы", "为什", "报告", "站点", "لم", "Die", "<num>", "<id>", "site"]), {})


def units(text, know=KNOW):
    return [text[a:b] for a, b in sentence_ends(text, know)]


#: Units are divided by | here.
CASES = [
    "Mr. Pellow and J. R. Sifton left at 10 p.m. |The run ended (e.g. 12.5 columns).",
    "It sits in the U.S. |The bill goes to Brasko Ltd. |12 rows were lost.",
    "He moved it to the U.S. bucket, etc. for one week.",
    "Costs fell to 4.78 USD, i.e. 19.4% less than in No. 10. |Version 3.1.0 ships.",
    'The note said "Stop the list. It is broken." and gave no reason. |Quindal replied: "It was late." |Done? |Nobody knows...',
    '"The row is blocked," wrote Bo, "so please wait." |(It is kept. Really.) |Next!',
    "Wait ... and then it came back. |silver_job.py wrote 5 rows. |site no. 5 was slow -- again! |The end",
    "It came up in the meeting.|The note was short.",
    "Wir haben Dateien usw. gesichert. |Die Quote stieg, d. h. um 4 Punkte, bis zum 4. Quartal und am 16. Mai nicht. |Dr. Ondrake prüfte z. B. die Schlüssel.",
    "Im Protokoll steht: „Der Abzug kam zu spät.“ |Die Kopie der Tabelle passt.",
    "Le rapport dit : « La copie est partielle. » |On a gardé les clés, p. ex. celles de lundi. |Faut-il relancer ? |Attention !",
    "¿Por qué falló? |¡No borren la copia! |El Sr. Brask revisó el núm. 4 a las 9 p. m. y nadie avisó.",
    "В 2024 г. мы потеряли 16 тыс. руб. и ключи, т. е. всё. |Мы сохранили журналы и т. д. |Мы ждём.",
    "报告写道：“快照不完整。”|为什么还没到？|同事说：“停了。明天再跑。”然后就离开了。|（旧记录保留。）|报告多出3.5条……|站点很慢",
    "担当者は「確認しました。問題ありません。」と答えました。|本当に大丈夫？！|終わり",
    "डॉ. शालवी ने 4.5 फ़ाइल जाँची। |क्या चला? |यह ठीक है।",
    "راجع د. سلوان الملف. |كتب: «كل شيء جاهز.» |لم يعرف السبب بعد. |هل اكتملت؟",
    "ข้อมูลมาช้า |สำเนาใช้เวลา 12 นาที |รุ่น 1.3 เริ่มใช้งาน",
]


@pytest.mark.parametrize("case", CASES)
def test_units(case):
    want = [u.strip() for u in case.split("|")]
    text = case.replace("|", "")
    assert units(text) == want


def test_lines_lists_and_headings():
    text = "# Title of 3 May\nWrapped line\nof text. Second\n\n- One. The two\n* no stop\n1. First\n2) second\n[10:20] Chat line\n[10:21] done?\n  \n\n"
    assert units(text) == ["Title of 3 May", "Wrapped line\nof text.", "Second", "One.", "The two", "no stop", "First", "second", "Chat line", "done?"]
    assert units("Der Lauf wurde am\n23. Juni beendet.\r\n\r\nDie Kopie kam.") == ["Der Lauf wurde am\n23. Juni beendet.", "Die Kopie kam."]


def test_places_are_code_points_and_cover_all_visible_text():
    text = " \U0001f600 A b. \n\nC d\xa0\n"
    assert sentence_ends(text) == [(1, 7), (10, 13)]
    for case in CASES:
        text = case.replace("|", "")
        assert "".join("".join(units(text)).split()) == "".join(text.split())


def test_unmatched_marks_and_nesting():
    assert enclosed('He said "yes (no) and left. 5" (open') == [(8, 29)]
    assert enclosed("a (b [c] d) e") == [(2, 10)]
    assert enclosed("a) b ( c") == []
    assert units("One ) two. The three ( four. The five") == ["One ) two.", "The three ( four.", "The five"]


def test_document_decides_on_its_own_words():
    # "Tkt." is no listed abbreviation; its stop before a small letter elsewhere in the document tells
    assert units("The Tkt. is old. See Tkt. Five now. Tkt. The end.") == ["The Tkt. is old.", "See Tkt. Five now.", "Tkt.", "The end."]
    assert units("See Tkt. Five now.") == ["See Tkt.", "Five now."]


def test_a_letter_with_a_longer_small_form_does_not_silence_the_document():
    assert units("\u0130x. The Tkt. is old. See Tkt. Five now.")[-1] == "See Tkt. Five now."


def test_listed_words_are_ordinary_where_document_or_corpus_says_so(spark):
    text = "There is no row, and no key. The answer is no. The job failed. See no. 5 of it."
    assert units(text) == ["There is no row, and no key.", "The answer is no.", "The job failed.", "See no. 5 of it."]
    assert units("The answer is no. The job failed.", Knowledge(KNOW.starters, {}, frozenset(["no"]))) == ["The answer is no.", "The job failed."]
    assert units("Dr. The left. It took no key. No. The end") == ["Dr. The left.", "It took no key.", "No. The end"]
    assert learn(spark.createDataFrame([("One art. One art and art, Dr. Bo.",)], "text string")).ordinary == {"art"}


def test_operator_on_dirty_tables(spark):
    rows = [(1, "One. Two.", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, " \n\t ", "x", 1), (5, "One. Two.", None, 1), (6, "No sentence. " * 30000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sentence string, sent_no int")
    got = split_sentences(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 2, 5: 2, 6: 30000}
    assert [(r.sent_start, r.sent_end, r.sentence) for r in split_sentences(df.where("doc_id = 1")).orderBy("sent_no").collect()] == [(1, 4, "One."), (6, 9, "Two.")]
    assert split_sentences(df.where("doc_id = 99")).count() == 0


def test_blocks_of_a_long_text():
    assert sum(1 for _ in blocks("line\n" * 50000 + "\n" + "- item\n" * 1000)) == 1001


def test_document_is_asked_before_corpus_and_corpus_before_lists(monkeypatch):
    know = Knowledge(KNOW.starters, {"max": False, "row": False}, frozenset(), frozenset(["max"]))
    # the corpus takes "row." for an abbreviation, this document uses it as an ordinary word
    assert units("Each row counts. It lost a row. The end", know) == ["Each row counts.", "It lost a row.", "The end"]
    assert units("It lost a row. The end", know) == ["It lost a row. The end"]
    # no list knows "dpt", the document does; lists play no part where it or the corpus speaks
    monkeypatch.setattr("tarnwork.llm.sentences.NEVER_END", frozenset())
    monkeypatch.setattr("tarnwork.llm.sentences.MAY_END", frozenset())
    know = Knowledge(KNOW.starters, {"max": False}, frozenset(), frozenset(["max"]))
    assert units("It was max. 5 rows. The dpt. of it saw Dpt. Five. The end", know) == ["It was max. 5 rows.", "The dpt. of it saw Dpt. Five.", "The end"]


def test_corpus_alone_learns_abbreviations(spark, monkeypatch):
    monkeypatch.setattr("tarnwork.llm.sentences.NEVER_END", frozenset())
    monkeypatch.setattr("tarnwork.llm.sentences.MAY_END", frozenset())
    texts = [f"There is no file {i}. See no. {i} of it, and ask Mr. Bo.\n\nThe run took max. {i} rows, logs etc. at dawn. The log says no.\n\nWe keep keys, logs etc.\n\nThe bucket is in the U.S.\n\nThe copy sits in the U.S. and the U.S. copy. It came." for i in range(12)]
    know = learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {"no", "max"} <= know.numbered and know.abbreviations["etc"] and know.abbreviations["u.s"] and not know.abbreviations["mr"] and "file" not in know.abbreviations
    assert know.abbreviations["no"] and {"The", "We"} <= know.starters
    assert units("It says no. The end. See no. 5, etc. The log. It is in the U.S. The end", know) == ["It says no.", "The end.", "See no. 5, etc.", "The log.", "It is in the U.S.", "The end"]


def test_units_after_numbers():
    assert units("Er kam um 5 h. The end of p. 3 came.") == ["Er kam um 5 h.", "The end of p. 3 came."]
