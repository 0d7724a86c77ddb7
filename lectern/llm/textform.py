"""Words, sentences, markers and look-alike folding, shared by the operators of this subpackage."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import SparkSession

WORD = re.compile(r"[^\W_]+")
MARKER = re.compile(r"\[\[/?ZX[A-Z]+\d+X\]\]")
LINE = re.compile(r"\r\n|[\n\r  ]")
_STOP = re.compile(r"[.!?…]+(?:\s?»|[”)\"])*(?=\s+(\S))")
_ABBREVIATION = re.compile(r"(?<![^\W_])(?:M|Mr|Mrs|Dr)$")
_OPENERS = frozenset("“«—([")
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}

# Letters of other scripts that look like Latin letters, after Unicode's confusables (UTS 39).
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h",
    "ԛ": "q", "ԝ": "w", "ү": "y", "ѵ": "v", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Armenian
    "Օ": "O", "օ": "o", "Ս": "U", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Լ": "L",
}


@lru_cache(maxsize=1)
def fold_table() -> dict[int, str | None]:
    """Code point -> what it is read as: width forms, ligatures, presentation forms, spaces, invisible characters.

    Built from Unicode's compatibility decompositions by a rule. Raised and lowered figures, fractions and
    enclosed forms keep their own reading and aren't in it.
    """
    table: dict[int, str | None] = {}
    kinds = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
    for cp in range(0x80, min(sys.maxunicode, 0x1FFFF)):
        c = chr(cp)
        category = unicodedata.category(c)
        if category == "Cf" or cp in _INVISIBLE:
            table[cp] = None
        elif category in ("Zs", "Zl", "Zp") or cp == 0x85:
            table[cp] = " "
        elif (tag := unicodedata.decomposition(c).split(" ", 1)[0]) and tag in kinds:
            if cp not in (0xA8, 0xAF, 0xB4, 0xB8):  # spacing accents, not ligatures
                table[cp] = unicodedata.normalize("NFKD", c)
    for c in "\t\n\v\f\r":
        table[ord(c)] = " "
    return table


def confusables(spark: SparkSession) -> dict[int, str]:
    """Code point -> the Latin letters that it looks like, for letters of other scripts: all of Unicode's confusables
    (UTS 39), as the ICU library beside Spark holds them, with LOOK_ALIKES before them.

    ICU gives one prototype for I and l; a letter with case keeps its own. Latin letters are letters of their own,
    modifiers and figures read otherwise, and Hangul's parts are no letters borrowed from another script. Without ICU this
    fails, since a shorter table would miss cases and look like a result.
    """
    out: dict[int, str] = {}
    letters = [
        c
        for c in map(chr, range(0x80, 0x20000))
        if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo")
        and not unicodedata.decomposition(c)
        and not unicodedata.name(c, "LATIN").startswith(("LATIN", "HANGUL", "MODIFIER", "CJK", "MATHEMATICAL"))
    ]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    prototypes = checker.getSkeleton("\x01".join(letters)).split("\x01")
    if len(prototypes) != len(letters):
        raise ValueError(f"ICU gave {len(prototypes)} prototypes for {len(letters)} letters")
    for c, p in zip(letters, prototypes):
        if p != c and p.isascii() and p.isalpha():
            out[ord(c)] = "I" if p == "l" and c.isupper() else p
    return out | {ord(k): v for k, v in LOOK_ALIKES.items()}


@lru_cache(maxsize=1)
def skeleton_table() -> dict[int, str | None]:
    """fold_table and the look-alike letters, with prototypes as values."""
    table = dict(fold_table())
    table.update({ord(k): v for k, v in LOOK_ALIKES.items()})
    return table


_MANY_SPACES = re.compile(r" {2,}")


def skeleton(text: str, table: dict[int, str | None] | None = None) -> str:
    """Decompose, put each character's prototype in its place, decompose again; one space for each run of white space.

    table: prototypes in place of skeleton_table()'s.
    """
    if text.isascii():
        out = text.translate(_ASCII_SPACE)
    else:
        out = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table or skeleton_table()))
    return _MANY_SPACES.sub(" ", out).strip()


_ASCII_SPACE = {ord(c): " " for c in "\t\n\v\f\r"}


def one_form(text: str, table: dict[int, str | None] | None = None) -> str:
    """The consistent form in which texts go on: the composed skeleton."""
    return unicodedata.normalize("NFC", skeleton(text, table))


def visible(text: str) -> str:
    """The text without invisible characters, width forms and look-alikes; line breaks stay."""
    if text.isascii():
        return text
    lines = LINE.split(text)
    return "\n".join(one_form(x) if not x.isascii() else x for x in lines)


def plain(text: str) -> str:
    """The text without inline markers."""
    return MARKER.sub("", text) if "[[" in text else text


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def digests(found: list[str] | set[str], cache: dict[str, int]) -> np.ndarray:
    """64-bit digests of words, none of them 0; cache keeps those of words seen and is emptied when it grows large."""
    if len(cache) > 500_000:
        cache.clear()
    for w in found if isinstance(found, set) else set(found):
        if w not in cache:
            cache[w] = xxhash.xxh3_64_intdigest(w) | 1
    return np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence by the rule of the data model; white space around sentences is left out."""
    spans: list[tuple[int, int]] = []
    at = 0

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            spans.append((a, b))

    ends = [(m.start(), m.end()) for m in LINE.finditer(text)] + [(len(text), len(text))]
    for end, after in ends:
        a = at
        for m in _STOP.finditer(text, at, end):
            nxt = m.group(1)
            if not (nxt.isupper() or nxt.istitle() or nxt.isdigit() or nxt in _OPENERS):
                continue
            if m.group() == "." and _ABBREVIATION.search(text, max(at, m.start() - 4), m.start()):
                continue
            add(a, m.end())
            a = m.end()
        add(a, end)
        at = after
    return spans


def sentences(text: str) -> list[str]:
    return [text[a:b] for a, b in sentence_spans(text)]
