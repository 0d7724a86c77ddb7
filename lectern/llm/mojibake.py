"""Problem 9: text garbled by a wrong character encoding.

Method: a multinomial classifier on hashed byte bigrams. Sound sentences of a bounded sample (SAMPLE_DOCS) are
garbled with every encoding chain; bigrams of their UTF-8 bytes that touch a non-ASCII byte are counted by chain,
and a sentence gets the chain under which its bigrams are likeliest, or none. The chain is inverted, and only
what decodes strictly is taken: valid UTF-8 sequences of plausible characters for chains that begin in UTF-8,
words that encode and decode without loss for those between single-byte encodings.

Replacement characters, and question marks inside words, are what a wrong decoding left where nothing can be
restored; they count as wrong.

Scale: a document is independent of the others, the tables are about 64 KB a chain and travel with the function;
no shuffle. ASCII sentences are passed over by the classifier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_rows, spread
from .textform import sentence_spans

SAMPLE_DOCS = 3000  # sound documents that the classifier is fitted on, about; a fifth of them is garbled
LEAST = 3  # wrong characters that make a document a case
MARGIN = 4.0  # log-likelihood by which a chain must beat sound text
_TABLE = 1 << 14

# Encoding chains: written in the first encoding, read in the second; "x2" twice.
UTF8_READ_AS = ("western", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_2", "cp1253", "koi8_r")
SINGLE = (
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("cp1252", "iso8859_2"),
    ("cp1252", "cp1251"), ("cp1252", "cp1253"), ("cp1252", "koi8_r"),
    ("mac_roman", "western"), ("cp437", "western"), ("cp850", "western"), ("cp1250", "western"), ("cp1251", "western"),
)
CHAINS = ("sound", *(f"utf_8>{d}" for d in UTF8_READ_AS), "utf_8>western>utf_8>western", *(f"{e}>{d}" for e, d in SINGLE))


@lru_cache(maxsize=32)
def _byte_of(encoding: str) -> dict[str, int]:
    """Character -> byte; western is cp1252 with Latin-1's control characters where it has no sign, or in their stead."""
    out: dict[str, int] = {}
    if encoding == "western":
        out = {chr(b): b for b in range(256)}
    for b in range(256):
        try:
            out[bytes([b]).decode("cp1252" if encoding == "western" else encoding)] = b
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(maxsize=1)
def _western() -> list[str]:
    return [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)]


def _read(data: bytes, encoding: str) -> str:
    if encoding == "western":
        return "".join(map(_western().__getitem__, data))
    return data.decode(encoding, "replace")


def _bytes(text: str, encoding: str) -> bytes | None:
    table = _byte_of(encoding)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def garble(text: str, chain: str) -> str | None:
    """The text written and read by the chain; None where its first encoding can't write it."""
    parts = chain.split(">")
    for e, d in zip(parts[::2], parts[1::2]):
        try:
            text = _read(text.encode(e), d)
        except UnicodeEncodeError:
            return None
    return text


@lru_cache(maxsize=32)
def _utf8_pattern(encoding: str) -> re.Pattern[str]:
    by: dict[int, list[str]] = {}
    for c, b in _byte_of(encoding).items():
        by.setdefault(b, []).append(c)
    part = lambda a, b: "[" + re.escape("".join(c for x in range(a, b) for c in by.get(x, []))) + "]"
    tail = part(0x80, 0xC0)
    return re.compile(f"(?:{part(0xC2, 0xE0)}{tail}|{part(0xE0, 0xF0)}{tail}{tail}|{part(0xF0, 0xF5)}{tail}{tail}{tail})+")


def _plausible(text: str) -> bool:
    """Characters that texts have; kinds that chance sequences of sound characters decode to are left out."""
    han = 0
    for c in text:
        o = ord(c)
        if 0x4E00 <= o < 0xA000:
            han += 1
        elif not (0xA0 <= o < 0x180 or 0x2C6 <= o < 0x2DE or 0x300 <= o < 0x530 or 0x1E00 <= o < 0x2300 or 0x2500 <= o < 0x2700 or 0x3000 <= o < 0x3100 or 0xFB00 <= o < 0xFB07 or o in (0xFEFF, 0xFFFD) or 0xFF00 <= o < 0xFFF0 or 0x80 <= o < 0xA0):
            return False
    return han == 0 or len(text) >= 2 and han == len(text)


_SCRIPTS = ("A-Za-zÀ-ÖØ-öø-ɏ", "\u0370-\u03ff", "\u0400-\u052f")
_MIXED = re.compile("|".join(f"[{a}][{b}]" for a in _SCRIPTS for b in _SCRIPTS if a != b))


def _invert_utf8(text: str, encoding: str) -> tuple[str, int]:
    """The text with strictly decodable sequences restored, and the number of characters that they took."""
    wrong = 0

    def put(m: re.Match[str]) -> str:
        nonlocal wrong
        data = _bytes(m.group(), encoding)
        try:
            out = data.decode("utf-8") if data else ""
        except UnicodeDecodeError:
            return m.group()
        if not out or not _plausible(out):
            return m.group()
        wrong += len(m.group())
        return out

    fixed = _utf8_pattern(encoding).sub(put, text)
    return (text, 0) if wrong and len(_MIXED.findall(fixed)) > len(_MIXED.findall(text)) else (fixed, wrong)


_TOKEN = re.compile(r"[^\x00-\x20]*[^\x00-\x7f][^\x00-\x20]*")


_OTHER_SCRIPT = re.compile(r"[\u0370-\u052f]{3}")  # a word rightly in another script; garbling leaves its letters alone


_SIGN_INSIDE = re.compile(r"(?<=[^\W\d_])[^\w\s'’.‑-](?=[^\W\d_])|(?<=[a-zà-ÿ])[A-ZÀ-Þ]")


def _odd_words(text: str) -> int:
    """Signs inside words, capitals behind small letters and words of two scripts: what no writer writes."""
    return len(_MIXED.findall(text)) + len(_SIGN_INSIDE.findall(text))


def _invert_single(text: str, e: str, d: str) -> tuple[str, int]:
    """The sentence with its words restored, if all its signs encode in d and the words then read no odder; the
    number of characters that changed."""
    wrong = 0
    if _OTHER_SCRIPT.search(text) or _bytes(text, d) is None:
        return text, 0

    def put(m: re.Match[str]) -> str:
        nonlocal wrong
        data = _bytes(m.group(), d) or b""
        try:
            out = data.decode(e)
        except UnicodeDecodeError:
            return m.group()
        wrong += sum(1 for a, b in zip(m.group(), out) if a != b)
        return out

    fixed = _TOKEN.sub(put, text)
    return (text, 0) if _odd_words(fixed) > _odd_words(text) else (fixed, wrong)


# --- the classifier --------------------------------------------------------------------------------------------


def _features(sentences: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashed features, number of the sentence of each, in order): bigrams of the UTF-8 bytes that touch a byte over
    127, and those bigrams of two such bytes with the byte after. ASCII letters count by case, digits as one."""
    parts = [b" " + s.encode("utf-8", "replace") for s in sentences]
    b = _BYTE_KIND[np.frombuffer(b"".join(parts) + b"  ", np.uint8)]
    ends = np.cumsum([len(x) for x in parts])
    at = np.flatnonzero((b[:-2] > 127) | (b[1:-1] > 127))
    pair = b[at] * 256 + b[at + 1]
    high = (b[at] > 127) & (b[at + 1] > 127)
    triple = pair[high] * 31 + b[at[high] + 2] + 7
    of = np.searchsorted(ends, at, "right")
    return [(pair * 2654435761 % _TABLE, of), (triple * 2654435761 % 1000003 % _TABLE, of[high])]


_BYTE_KIND = np.arange(256, dtype=np.int64)
_BYTE_KIND[97:123], _BYTE_KIND[65:91], _BYTE_KIND[48:58] = 97, 65, 48


@dataclass
class Classifier:
    log_share: np.ndarray  # table x chains

    def scores(self, sentences: list[str]) -> np.ndarray:
        """Log-likelihood of every sentence under every chain."""
        out = np.zeros((len(sentences), len(CHAINS)))
        for features, of in _features(sentences):
            sums = np.vstack([np.zeros(len(CHAINS)), np.cumsum(self.log_share[features], axis=0, dtype=np.float64)])
            cuts = np.searchsorted(of, np.arange(len(sentences) + 1))
            out += sums[cuts[1:]] - sums[cuts[:-1]]
        return out


def _fit(sound: list[str], garbled_share: int = 5) -> Classifier:
    counts = np.zeros((len(CHAINS), _TABLE))
    for c, chain in enumerate(CHAINS):
        some = sound if c == 0 else [g for s in sound[::garbled_share] if (g := garble(s, chain)) and g != s]
        for a in range(0, len(some), 500):
            for features, _ in _features(some[a : a + 500]):
                counts[c] += np.bincount(features, minlength=_TABLE)
    smoothed = counts + 0.02
    return Classifier(np.ascontiguousarray(np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).T.astype(np.float32)))


def _sentences_of(text: str) -> list[str]:
    return [text[a:b] for a, b in sentence_spans(text) if not text[a:b].isascii()]


def fit(documents: DataFrame, id_col: str, text_col: str, sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """The classifier, fitted on about sample_docs documents chosen by a hash of the id.

    Documents with strictly decodable sequences aren't sound. What a first classifier can restore is left out before
    the second is fitted; what it only takes for garbled, such as a rare language, stays.
    """
    n = max(1, documents.count())
    h = F.xxhash64(id_col, F.lit(23))
    rows = (
        documents.select(text_col, h.alias("h"))
        .where(F.pmod("h", F.lit(max(1, n // sample_docs))) == 0)
        .where(f"{text_col} is not null")
        .orderBy("h")
        .limit(2 * sample_docs)
        .collect()
    )
    sound = []
    for r in rows:
        t = r[0]
        if "�" in t or t.isascii() or any(_invert_utf8(t, e)[1] for e in UTF8_READ_AS):
            continue
        sound += list(dict.fromkeys(_sentences_of(t)))
    first = _fit(sound, garbled_share=10)
    kept = []
    for a in range(0, len(sound), 500):
        some = sound[a : a + 500]
        for s, x in zip(some, first.scores(some)):
            if _OTHER_SCRIPT.search(s) or x[1:].max() - x[0] < MARGIN or not _restore(s, x, first)[1]:
                kept.append(s)
    return _fit(kept)


# Places where no writer puts a question mark: inside a word, right before one, after a comma or an opening quotation mark.
_ODD = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_])|(?<!\S)\?(?=[^\W\d_])|(?<=[,;«])\?")
_LOOSE = re.compile(r"(?<=[^\W\d_])\?(?=\s[a-zà-ÿ])|(?<!\S)\?(?=\s[^\W\d_])")


def _question_marks(text: str) -> int:
    """Question marks that a decoding put in place of letters and quotation marks: those in odd places and, where
    there are such, the ones that stand where a sentence goes on."""
    odd = len(_ODD.findall(text)) if "?" in text else 0
    return odd + len(_LOOSE.findall(text)) if odd >= 2 or odd and text.isascii() else 0


def _restore(s: str, scores: np.ndarray, c: Classifier) -> tuple[str, int, str]:
    """(restored sentence, wrong characters, chain) by the likeliest chain, or those near it, that inverts strictly."""
    for k in np.argsort(-scores)[:4].tolist():
        chain = CHAINS[k]
        if k == 0:
            break
        parts = chain.split(">")
        if parts[0] == "utf_8":
            fixed, m = _invert_utf8(s, parts[1])
            if m and parts[1] == "western" and (len(parts) > 2 or _invert_utf8(fixed, parts[1])[1]):
                fixed = _invert_utf8(fixed, parts[1])[0]
        else:
            if scores[k] - scores[0] < MARGIN:
                continue
            fixed, m = _invert_single(s, parts[0], parts[1])
            # the restored sentence must be likelier as sound text than the one at hand
            if m and c.scores([fixed])[0, 0] < scores[0] + MARGIN:
                continue
        if m:
            return fixed, m, chain
    return s, 0, ""


def examine(text: str, c: Classifier) -> tuple[str, int, str]:
    """(restored text, number of wrong characters, chains) of a text."""
    if text.isascii() and "?" not in text:
        return text, 0, ""
    wrong = text.count("�") + _question_marks(text)
    chains = ["lossy"] if wrong else []
    fixes: list[tuple[int, int, str, int, str, frozenset[str]]] = []
    spans = [(a, b) for a, b in sentence_spans(text) if not text[a:b].isascii()]
    if not spans:
        return text, wrong, ",".join(chains)
    likely = c.scores([text[a:b] for a, b in spans])
    top = likely.argmax(axis=1)
    places = [e for e in ("western", "mac_roman", "cp850", "cp437") if _utf8_pattern(e).search(text)]
    for (a, b), scores, first in zip(spans, likely, top.tolist()):
        if not first and not places:
            continue
        s = text[a:b]
        best, n, chain = _restore(s, scores, c) if first else (s, 0, "")
        if not n:  # places in an otherwise sound sentence: only strictly decodable sequences speak
            for e in places:
                fixed, m = _invert_utf8(s, e)
                if m >= 2:
                    best, n, chain = fixed, m, f"utf_8>{e}"
                    break
        if n:
            changed = frozenset() if chain.startswith("utf_8") else frozenset(x for x, y in zip(s, best) if x != y)
            fixes.append((a, b, best, n, chain, changed))
    # one sign alone, however often, may be rightly there; a wrong single-byte decoding changes several
    signs: dict[str, set[str]] = {}
    for f in fixes:
        signs.setdefault(f[4], set()).update(f[5])
    out, at = [], 0
    for a, b, best, n, chain, changed in fixes:
        if changed and len(signs[chain]) < 2:
            continue
        wrong += n
        chains.append(chain)
        out += [text[at:a], best]
        at = b
    out.append(text[at:])
    return "".join(out), wrong, ",".join(dict.fromkeys(chains))


def garbled(documents: DataFrame, id_col: str, text_col: str, least: int = LEAST, classifier: Classifier | None = None) -> DataFrame:
    """(doc_id, chains, n_wrong, n_left, restored) of every document with at least least wrong characters.

    n_left counts replacement characters and question marks, which can't be restored. Null texts have no row.
    """
    c = classifier or fit(documents, id_col, text_col)

    def run(ids: list, texts: list) -> Iterator[tuple]:
        for i, t in zip(ids, texts):
            restored, wrong, chains = examine(t, c)
            if wrong >= least:
                yield i, chains, wrong, restored.count("�") + _question_marks(restored), restored

    docs = spread(documents.select(id_col, text_col).where(f"{text_col} is not null"))
    return arrow_rows(docs, run, [id_col, text_col], "doc_id bigint, chains string, n_wrong int, n_left int, restored string")
