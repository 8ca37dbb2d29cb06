"""Words of a text, without regard to case, compatibility forms and invisible characters."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import xxhash

#: Han and kana characters, each a word of its own.
_OWN = "々-〇ぁ-ゖゝ-ゟァ-ヺヽ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(f"[{_OWN}]|[^\\W_{_OWN}]+")
#: Format characters, variation selectors and fillers: they show nothing and separate nothing.
_INVISIBLE = dict.fromkeys(
    [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"] + [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE)).casefold()
        text = unicodedata.normalize("NFKC", text)
    else:
        text = text.lower()
    return _WORD.findall(text)


_IDS: dict[str, int] = {}


def word_ids(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, the same on every machine."""
    if len(_IDS) > 2_000_000:
        _IDS.clear()
    out = []
    for w in words(text):
        h = _IDS.get(w)
        if h is None:
            h = _IDS[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)
