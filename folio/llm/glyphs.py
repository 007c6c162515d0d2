"""Characters that look the same: one table, as a JVM expression and as Python translation maps."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Letters of other scripts that are drawn like a Latin letter.
CYRILLIC_UPPER = dict(zip("АВЕКМНОРСТУХІЅЈԚԜ", "ABEKMHOPCTYXISJQW"))
CYRILLIC_LOWER = dict(zip("аеорсухіѕјһԛԝ", "aeopcyxisjhqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲϳ", "ABEZHIKMNOPTYXovpcj"))
ACCENTED = dict(zip("ёЁїЇ", "ëËïÏ"))
OTHER = {"µ": "μ"} | dict(zip("ıɡԁѵӀӏօսհ", "igdvIlouh"))
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
UNSEEN = [0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF]
FIXED_BLANKS = [0x00A0, 0x2007, 0x202F]
HYPHENS = [0x02D7, 0x2010, 0x2011, 0x2043, 0xFE63]

FULL_WIDTH = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {"　": " "}

# By rule: letters and digits of mathematical alphabets, and Roman numerals, as their compatibility decomposition has them.
MATHEMATICAL = {c: d for c in map(chr, range(0x1D400, 0x1D800)) if len(d := unicodedata.normalize("NFKC", c)) == 1 and d != c}
MATHEMATICAL = {c: (CYRILLIC_UPPER | CYRILLIC_LOWER | GREEK).get(d, d) for c, d in MATHEMATICAL.items()}
_ROMAN = {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0x2160, 0x2180))}
LIGATURES |= {c: d for c, d in _ROMAN.items() if len(d) > 1}

ONE_TO_ONE: dict[str, str] = (
    CYRILLIC_UPPER | CYRILLIC_LOWER | GREEK | ACCENTED | OTHER | FULL_WIDTH | MATHEMATICAL
    | {c: d for c, d in _ROMAN.items() if len(d) == 1}
    | {chr(c): " " for c in FIXED_BLANKS} | {chr(c): "-" for c in HYPHENS}
)
REMOVED = "".join(map(chr, UNSEEN))


def look(text: Column) -> Column:
    """The text with every look-alike character replaced; composed and combining accents stay as they are."""
    src = "".join(ONE_TO_ONE) + REMOVED
    mapped = F.translate(text, src, "".join(ONE_TO_ONE.values()))
    parted = mapped
    for lig, plain in LIGATURES.items():
        parted = F.replace(parted, F.lit(lig), F.lit(plain))
    return (
        F.when(text.rlike(f"[{''.join(LIGATURES)}]"), parted)
        .when(text.rlike(r"[^\x00-\x7F]"), mapped)
        .otherwise(text)
    )


# A letter with a combining mark, and every letter that has a decomposition in the scripts above or in kana,
# hangul and the Latin, Greek and Cyrillic blocks: what is left is the same for composed and decomposed text.
_UNSTABLE = (
    r"[^\p{M}]\p{M}+|\p{M}|[À-ɏͰ-ϿЀЁЃЇЌ-ЎЙйѐё"
    r"ѓїќ-ўѶѷӁӂӐ-ӹḀ-῿぀-ヿᄀ-ᇿ가-힣]"
)


def look_key(looked: Column) -> Column:
    """Hash that is equal for any two canonically equivalent texts: a lossless blocking key."""
    stable = F.when(looked.rlike(r"[^\x00-\x7F]"), F.regexp_replace(looked, _UNSTABLE, "")).otherwise(looked)
    return F.xxhash64(stable)


# Python side: one form per word whatever case, look and composition it has (used by the text searches).
_FOLD = {ord(k): v.lower() for k, v in (CYRILLIC_UPPER | CYRILLIC_LOWER | GREEK).items()}
_FOLD |= {ord(k.lower()): v.lower() for k, v in CYRILLIC_UPPER.items()}
_FOLD |= {ord(k): v.lower() for k, v in (ACCENTED | FULL_WIDTH | LIGATURES | OTHER | MATHEMATICAL | _ROMAN).items()}
_FOLD |= {c: None for c in UNSEEN} | {c: " " for c in FIXED_BLANKS} | {c: "-" for c in HYPHENS}
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Text as a reader sees it, without case."""
    if not text.isascii():
        text = text.translate(_FOLD)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text).translate(_FOLD)
    return text.lower()


def words(text: str) -> list[str]:
    """Runs of letters and digits of the folded text."""
    return _WORD.findall(fold(text))


_LOOK = {ord(k): v for k, v in (ONE_TO_ONE | LIGATURES).items()} | {c: None for c in UNSEEN}


def look_py(text: str) -> str:
    """Python twin of :func:`look`, with accents composed."""
    return text if text.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_LOOK))
