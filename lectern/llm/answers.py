"""Problems 1 and 2: defective answers, and texts cut off by a limit or a broken transfer.

Cut texts: intact answers are cut artificially to make positives, and a hashed logistic regression is trained
on closing characters, punctuation, length against the producer's limits and how much of the source's words
the answer still renders; every answer is scored, and the threshold is set on rows held out of the training. The
last kind of feature needs to know which word renders which, so a bilingual lexicon is fitted on the same pairs.

Defects: a pushdown parser over fences, brackets, quotations, lists and inline markup says what is left open: a text
that ends without a closing sign inside something that the source closes is truncated; other truncated texts are by the score.
Greedy string tiling finds copies; script checks and character models of the language (language.py) find the
language; refusal grammars (refusals.py) find declining answers, outside quotations only, so that characters may
decline.

Scale: the model is fitted on all rows (fitting.py): passes over the pairs in Arrow batches, of which counts of words
and pairs of words are shuffled and sums come to the driver; it travels with the function. Judging is one more pass.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_rows, forget, shared_table, spread
from . import fitting, language
from .language import Language
from .refusals import QUOTED, declines
from .textform import MARKER, WORD, visible

BUCKETS = 1 << 14
FEATURES = 19  # of an answer
COMMON = 0.15  # share of the intact answers that a frequent word is in
USUAL = 0.001  # share of the intact answers that a usual word is in
SEEN = 2e-5  # share of the intact answers that a word seen in them is in, twice at least
NAMED = 0.1  # share of the pairs whose sources a name is in, at most
FOLDS = 3  # of the rows held out of training in turn
CUT_PRIOR = 0.3  # share of cut answers for which the threshold is set
SCORES = np.linspace(-8, 8, 321)  # among which the threshold is sought
FIELDS = ("draft", "final")
DEFECTS = ("empty", "refusal", "copy", "language", "truncated")

_USUAL = re.compile(r"[^\x00-\xac\xae-\xffŒœ–—‘’“”„… ]")
_CLOSERS = " \t\n\r  »”\")]’'*"
_TERMINAL = frozenset(".!?…")


def shape(text: str) -> str:
    """The text without markers; unusual characters folded."""
    if "[[" in text:
        text = MARKER.sub("", text)
    return visible(text) if _USUAL.search(text) else text


# --- pushdown parser -------------------------------------------------------------------------------------

_PAIRS = {"«": "»", "“": "”", "„": "“", "(": ")", "[": "]", "{": "}"}
_CLOSING = {v: k for k, v in _PAIRS.items()} | {"”": "“"}
_TOKEN = re.compile(r"```|\[\[(/?)ZX[A-Z]+(\d+)X\]\]|</?([A-Za-z]\w*)[^<>]*?(/?)>|[«»“”„(){}\[\]]|\n\s*(?:[-*•]|\d+[.)])\s*(?=\n|$)")


def left_open(text: str) -> tuple[str, ...]:
    """What a pushdown parser has on its stack at the end: fences, brackets, quotations, markup; a last bare list
    mark counts as open too. A closing sign without its opening one is passed over; a closing sign pops what
    was opened inside, as in well-nested text."""
    stack: list[str] = []
    for m in _TOKEN.finditer(text):
        t = m.group()
        if t == "```":
            if "```" in stack:
                del stack[stack.index("```") :]
            else:
                stack.append("```")
        elif "```" in stack:
            continue
        elif t.startswith("[["):
            name = f"zx{m.group(2)}"
            if not m.group(1):
                stack.append(name)
            elif name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name) :]
        elif m.group(3):
            name = f"<{m.group(3).lower()}>"
            if t.startswith("</"):
                if name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
            elif not m.group(4) and name not in ("<br>", "<hr>", "<img>"):
                stack.append(name)
        elif t in _CLOSING and (_CLOSING[t] in stack or (t == "“" and "„" in stack)):
            sign = "„" if t == "“" else _CLOSING[t]
            del stack[len(stack) - 1 - stack[::-1].index(sign) :]
        elif t in _PAIRS:
            stack.append(t)
        elif t[:1] == "\n":
            stack.append("list")
    return tuple(stack)


# --- greedy string tiling ---------------------------------------------------------------------------------


def tiled(a: list[str], b: list[str], least: int = 2) -> int:
    """Words of a and b covered by greedy string tiling: longest common runs first, none overlapping."""
    free_a, free_b = [True] * len(a), [True] * len(b)
    where: dict[str, list[int]] = defaultdict(list)
    for j, w in enumerate(b):
        where[w].append(j)
    covered = 0
    while True:
        best, matches = least, []
        for i in range(len(a)):
            if not free_a[i]:
                continue
            for j in where.get(a[i], ()):
                if not free_b[j]:
                    continue
                n = 1
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, matches = n, [(i, j)]
                elif n == best:
                    matches.append((i, j))
        if not matches:
            return covered
        for i, j in matches:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                covered += best


def is_copy(source: list[str], answer: list[str], source_text: str, answer_text: str) -> bool:
    """The answer gives back the source's own words, a label or a few characters apart."""
    if not source or not answer:
        return False
    if source == answer:
        return True
    common = len(set(source) & set(answer))
    if common < 0.6 * len(set(answer)) and common < 0.6 * len(set(source)):
        return False
    if len(source) < 4:
        extra = len(answer) - len(source)
        return 0 < extra <= 4 and answer[-len(source) :] == source
    covered = tiled(source, answer)
    label = 4 if ":" in answer_text[:40] and ":" not in source_text[:40] else 0
    return covered >= 0.75 * max(len(answer) - label, 1) and covered >= 0.5 * len(source)


# --- language -------------------------------------------------------------------------------------------------


def foreign(s: Side, text: str, m: Model) -> bool:
    """Whether an answer is written in another language or script than the intact answers.

    Quotations may rightly be in any language, so the words outside them decide where they say enough, and words
    that a quotation keeps from the source say nothing. Names, which the source writes with a capital too, and
    figures belong to no language.
    """

    def telling(part: str, kept: frozenset[str]) -> list[str]:
        out = []
        for w in WORD.findall(part):
            low = w.lower()
            if low in kept or not low.isalpha() or (w[0].isupper() and (low in s.names or low not in m.seen)):
                continue
            out.append(low)
        return out

    found = WORD.findall(text)
    strange = sum(1 for w in found if w[0] > "\u024f" and w[0].isalpha() and not "\u1e00" <= w[0] <= "\u1eff")
    if 2 * strange > len(found):
        return True
    outside = QUOTED.sub(" ", text)
    if outside != text:
        said = m.language.foreign(telling(outside, frozenset()))
        if said is not None:
            return said
    return bool(m.language.foreign(telling(text, s.set if outside != text else frozenset())))


# --- the model -------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Fitted state: what renders each source word, in how many pairs it is, their number, words seen in intact answers,
    frequent ones among them, limits by producer, character models, weights."""

    renders: dict[str, frozenset[str]] = field(default_factory=dict)
    known: dict[str, int] = field(default_factory=dict)
    pairs: int = 0
    seen: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()
    language: Language = field(default_factory=Language)
    limits: dict[str, frozenset[int]] = field(default_factory=dict)
    byte_limits: dict[str, frozenset[int]] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * BUCKETS)
    threshold: float = 0.0


@dataclass
class Side:
    """What is needed of a source, computed once for its draft and its final."""

    text: str
    words: list[str]
    cased: list[str]
    end: str
    needs: list[tuple[str, frozenset[str]]]
    last_needs: list[tuple[str, frozenset[str]]]
    opened: int

    @cached_property
    def names(self) -> frozenset[str]:
        return frozenset(w for w, c in zip(self.words, self.cased) if c[0].isupper())

    @cached_property
    def set(self) -> frozenset[str]:
        return frozenset(self.words)


def end_class(text: str) -> str:
    """Class of the last sign that isn't a closing one: t terminal, o ellipsis, c comma, d dash, : colon, ~ broken, w word."""
    bare = text.rstrip(_CLOSERS)
    if not bare:
        return "0"
    c = bare[-1]
    return "o" if c == "…" else "t" if c in _TERMINAL else "c" if c in ",;" else "d" if c in "-–—" else ":" if c == ":" else "~" if c == "�" else "w"


_SENTENCE_END = re.compile(r"[.!?…]+[”»)\"\s]*\s(?=[A-ZÀ-Ý“«—(\[\d])")


_BEFORE_FIRST = re.compile(r"[.!?…:“«\"\n]")


@dataclass
class Source:
    """A shaped source's words, where they begin and end, and those of them that an answer has to render, by place."""

    text: str
    cased: list[str]
    words: list[str]
    begins: list[int]
    ends: list[int]
    needed: list[tuple[str, frozenset[str]]]
    needed_at: list[int]


def source_of(text: str, m: Model) -> Source:
    out = Source(text, [], [], [], [], [], [])
    end = 0
    for k, hit in enumerate(WORD.finditer(text)):
        cased, begin = hit.group(), hit.start()
        w = cased.lower()
        r = m.renders.get(w)
        # an unknown word with a capital is a name, unless it begins a sentence or a quotation, as any word may
        if r is None and (w[0].isdigit() or (cased[0].isupper() and end and m.known.get(w, 0) < 5 and not _BEFORE_FIRST.search(text, end, begin))):
            r = frozenset((w,))
        if r:
            out.needed.append((w, r))
            out.needed_at.append(k)
        end = hit.end()
        out.cased.append(cased)
        out.words.append(w)
        out.begins.append(begin)
        out.ends.append(end)
    return out


def side_of(source: str, m: Model) -> Side:
    s = source_of(shape(source), m)
    return _side(s, s.text, len(s.words))


def _side(s: Source, text: str, n: int) -> Side:
    """The side of a text that is the source up to its first n words, and closing signs."""
    tail = 0
    for hit in _SENTENCE_END.finditer(text):
        tail = hit.end()
    at = bisect_left(s.needed_at, bisect_left(s.begins, tail, 0, n))  # of the last sentence's first need
    last = dict(s.needed[at : bisect_left(s.needed_at, n)])
    needs = dict(s.needed[:at]) | last
    return Side(text, s.words[:n], s.cased[:n], end_class(text), [*needs.items()], [*last.items()], len(left_open(text)))


_INDEX: dict[tuple, int] = {}


def _h(parts: tuple) -> int:
    i = _INDEX.get(parts)
    if i is None:
        if len(_INDEX) > 200_000:
            _INDEX.clear()
        i = _INDEX[parts] = zlib.crc32("\x1f".join(map(str, parts)).encode()) % BUCKETS
    return i


def _bucket(x: float) -> int:
    return int(min(24, max(0, x * 10)))


def lacking(needs: list[tuple[str, frozenset[str]]], have: set[str]) -> int:
    """How many of the needs none of these words renders."""
    n = 0
    for w, r in needs:
        if w not in have and r.isdisjoint(have):
            n += 1
    return n


def features(s: Side, text: str, found: list[str], raw_length: int, raw_bytes: int, producer: str, m: Model, missing: int | None = None) -> list[int]:
    """The numbers of an answer's features; missing: the needs that it lacks, where they are counted already."""
    have = set(found)
    if missing is None:
        missing = lacking(s.needs, have)
    tail_at = 0
    for hit in _SENTENCE_END.finditer(text):
        tail_at = hit.end()
    have_last = set(WORD.findall(text[tail_at:].lower())) if tail_at else have
    missing_last = lacking(s.last_needs, have_last)
    n = max(1, len(s.needs))
    end = end_class(text)
    bare = text.rstrip(_CLOSERS + ".!?…,;:—–-")
    last = found[-1] if found else ""
    opened = left_open(text)
    fit = raw_length in m.limits.get(producer, ()) or raw_bytes in m.byte_limits.get(producer, ()) if producer else False
    same = end == s.end
    unfinished = last and last not in m.seen and not (last[0].isdigit() or last in s.words)
    more = len(opened) > s.opened
    miss = min(missing, 4)
    miss_last = min(missing_last, 4)
    tail = text[len(bare) :].strip()[:4]
    ratio = _bucket(len(text) / max(1, len(s.text)))
    parts = (
        ("b",),
        ("end", end, s.end),
        ("miss", miss, end, same),
        ("last", miss_last, end, same),
        ("share", _bucket(missing / n), same),
        ("ml", miss, miss_last, same),
        ("lshare", _bucket(missing_last / max(1, len(s.last_needs))), end, same),
        ("ratio", ratio, same),
        ("word", last, end != "t"),
        ("function", last in m.common, end, same),
        ("new", bool(unfinished), end, same),
        ("open", more, opened[-1:], end),
        ("fit", fit, end),
        ("fitm", fit, miss > 0),
        ("tail", tail, s.end),
        ("space", text[-1:].isspace(), end),
        ("short", min(len(found), 6), end, same),
        ("long", min(9, raw_length // 40), end),
        ("mirror", same and end != "t", miss, miss_last, last in m.common),
    )
    return [_h(p) if (i := _INDEX.get(p)) is None else i for p in parts]


def _cut(text: str, limits: frozenset[int], rng: random.Random) -> str | None:
    """The text, cut as a limit or a broken transfer would; None where nothing of a sentence would be missing."""
    inside = [x for x in limits if x < len(text) - 2]
    at = rng.choice(inside) if inside and rng.random() < 0.5 else rng.randint(max(4, len(text) // 5), max(5, len(text) - 3))
    if rng.random() < 0.3 and len(text) > 30:  # near the end, where little is missing
        at = len(text) - rng.randint(3, 25)
    if rng.random() < 0.25:  # at a word's end
        while at < len(text) and not text[at].isspace():
            at += 1
    out = text[:at]
    if len(WORD.findall(text[at:])) == 0 or out.rstrip()[-1:] in _TERMINAL or not WORD.search(out):
        return None
    kind = rng.random()
    return out + "…" if kind < 0.12 else out + "�" if kind < 0.18 else out.rstrip() if kind < 0.5 else out


def _places(s: Source, words: list[str], m: Model) -> list[tuple[int, int]]:
    """Where a word of the source and one of its answer's words render each other, inside both."""
    at: dict[str, list[int]] = defaultdict(list)
    for j, w in enumerate(words):
        at[w].append(j)
    out = []
    for i, w in enumerate(s.words[:-1]):
        r = m.renders.get(w)
        js = at.get(w, ()) if r is None else [j for x in r if x in at for j in at[x]]
        if len(js) == 1 and 1 < js[0] < len(words) - 1:
            out.append((i, js[0]))
    return out


def _broken_off(s: Source, text: str, words: list[str], ends: list[int], places: list[tuple[int, int]], m: Model, rng: random.Random) -> tuple[Side, str] | None:
    """A source's side and its answer, both broken off behind words that render each other, where nothing else is lost."""
    if not places:
        return None
    i, j = rng.choice(places)
    if words[j + 1] in m.common and s.cased[i + 1].islower() and rng.random() < 0.6:
        i, j = i + 1, j + 1  # "and", "et"
    end = rng.choice(("", "", "—", "…", ","))
    side = _side(s, s.text[: s.ends[i]] + end, i + 1)
    have, whole = set(words[: j + 1]), set(words)
    if any(w not in have and r.isdisjoint(have) and (w in whole or not r.isdisjoint(whole)) for w, r in side.needs):
        return None
    return side, text[: ends[j]] + end


def fit_lexicon(pairs: DataFrame, m: Model, least: int = 4) -> None:
    """Which answer words render each source word, from all pairs (source, text).

    A greedy cover: the word most particular to the pairs that hold w, then the one most particular to those
    not covered yet, and so on. So "rideau" renders "curtain", and "derrière", which comes with it, does not.
    """

    def sets(source: str, text: str) -> tuple[set[str], set[str]]:
        return set(WORD.findall(shape(source).lower())), set(WORD.findall(shape(text).lower()))

    def count(source: str, text: str) -> tuple:
        ws, wt = sets(source, text)
        return ws, ws & wt, ("", *wt)  # "" counts the pairs

    pairs = spread(pairs)
    found = fitting.counted(pairs, 3, count).where("n0 >= 2 or n2 >= 2").toArrow()
    rows = list(zip(*(found.column(k).to_pylist() for k in range(4))))
    n = m.pairs = next((c for w, _, _, c in rows if not w), 0)
    n_t = {w: c for w, _, _, c in rows if w and c >= 2}
    m.common = frozenset(t for t, c in n_t.items() if c >= max(4, COMMON * n))
    m.seen = frozenset(t for t, c in n_t.items() if c >= max(2, SEEN * n))
    m.known = {w: c for w, c, _, _ in rows if w and c >= least}
    # names and figures stay as they are
    m.renders = {w: frozenset((w,)) for w, c, kept, _ in rows if w and c >= least and kept >= 0.5 * c}
    active = {w: c for w, c in m.known.items() if w not in m.renders}
    for w, (picked, left) in fitting.cover(pairs, sets, active, {t: c for t, c in n_t.items() if t not in m.common}, n).items():
        # a word is needed only if nearly every intact answer renders it
        if left <= 0.07 * active[w]:
            m.renders[w] = picked


def _limits(df: DataFrame) -> tuple[dict[str, frozenset[int]], dict[str, frozenset[int]]]:
    """Lengths, in characters and in bytes, at which a producer's unfinished texts pile up, over all rows.

    One aggregation by (producer, length); only lengths that hold a twentieth of a producer's unfinished texts
    (at most twenty a producer) come to the driver.
    """
    unfinished = ~F.right(F.rtrim("text"), F.lit(2)).rlike(r"[.!?…]")
    t = df.select("producer", F.struct(F.length("text").alias("c"), F.octet_length("text").alias("b")).alias("n")).where(
        unfinished & F.col("producer").isNotNull() & (F.length("text") > 20)
    )
    long = t.select("producer", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("n.c").alias("len")), F.struct(F.lit("b").alias("unit"), F.col("n.b").alias("len")))).alias("x")).select("producer", "x.*")
    counts = long.groupBy("producer", "unit", "len").agg(F.count("*").alias("n"))
    totals = counts.groupBy("producer", "unit").agg(F.sum("n").alias("total"))
    spikes = counts.join(totals, ["producer", "unit"]).where("n >= 8 and n >= 0.05 * total").collect()
    out: tuple[dict, dict] = (defaultdict(set), defaultdict(set))
    for r in spikes:
        out[r.unit == "b"][r.producer].add(r.len)
    return tuple({k: frozenset(v) for k, v in d.items()} for d in out)  # type: ignore[return-value]


def answers(chunks: DataFrame) -> DataFrame:
    """(producer, text) of every draft and final."""
    pairs = F.explode(F.array(F.struct(F.col("model").alias("producer"), F.col("draft").alias("text")), F.struct(F.col("patcher").alias("producer"), F.col("final").alias("text"))))
    return chunks.select(pairs.alias("x")).select("x.*").where("text is not null")


def _intact(chunks: DataFrame) -> DataFrame:
    """(key, source, text, who) of every answer that ends as its source does, doesn't decline and is no copy; a final
    that is its draft is one answer with it."""

    def run(ids: list, sources: list, drafts: list, finals: list, models: list, patchers: list) -> Iterator[tuple]:
        for i, source, draft, final, by, then in zip(ids, sources, drafts, finals, models, patchers):
            if not source or i is None:
                continue
            s = shape(source)
            end, words = end_class(s), [w.lower() for w in WORD.findall(s)]
            for k, text, who in ((0, final, then), (1, draft, by)):
                t = shape(text) if text else ""
                found = WORD.findall(t)
                if not found or end_class(t) != end or declines(text) or is_copy(words, [w.lower() for w in found], source, text):
                    continue
                yield 2 * i + k, source, text, who or ""
                if final == draft:
                    break

    return arrow_rows(
        spread(chunks.select("chunk_id", "source", "draft", "final", "model", "patcher")),
        run,
        ["chunk_id", "source", "draft", "final", "model", "patcher"],
        "key bigint, source string, text string, who string",
    )


def fit(chunks: DataFrame, seed: int = 11) -> Model:
    """The model, fitted on all rows: limits, language, lexicon, weights and threshold."""
    m = Model()
    m.limits, m.byte_limits = _limits(answers(chunks))
    intact = shared_table(_intact(chunks), "intact")
    texts = spread(intact.select("source", "text"))
    # the main language: answers of which usual words make at least half of what they make of most answers
    docs = fitting.counted(texts, 1, lambda s, t: (("", *set(_spoken(s, t)[0])),)).where("n0 >= 3 or word = ''").toArrow()
    times = dict(zip(docs.column(0).to_pylist(), docs.column(1).to_pylist()))
    n = times.pop("", 0)
    usual = frozenset(w for w, c in times.items() if c >= max(3, USUAL * n))

    def share(own: list[str]) -> float:
        return sum(1 for w in own if w in usual) / len(own) if own else 0.0

    half = 0.5 * fitting.middle(texts, lambda s, t: share(_spoken(s, t)[0]))

    def main(s: str, t: str) -> tuple[list[str], list[str]] | None:
        own, other = _spoken(s, t)
        return (own, other) if len(own) < 4 or share(own) >= half else None

    words = fitting.counted(texts, 3, lambda s, t: (*x, set(x[0])) if (x := main(s, t)) else ((), (), ())).toArrow()
    words = list(zip(*(words.column(k).to_pylist() for k in range(4))))
    of = lambda k: Counter({r[0]: r[k] for r in words if r[k] and r[0].isalpha()})

    def usual_evidence(x: Language) -> float:
        def one(s: str, t: str) -> float | None:
            y = main(s, t)
            total, k = x.evidence(y[0]) if y else (0.0, 0)
            return total / k if k >= 3 else None

        return fitting.middle(texts, one)

    m.language = language.fit_counts(of(1), of(2), usual_evidence)
    m.seen = frozenset(r[0] for r in words if r[3] >= max(2, SEEN * n))

    def spoken(keys: list, sources: list, answered: list, by: list) -> Iterator[tuple]:
        for key, s, t, who in zip(keys, sources, answered, by):
            cased = WORD.findall(shape(s))
            if not foreign(Side("", [w.lower() for w in cased], cased, "", [], [], 0), shape(t), m):
                yield key, s, t, who

    pairs = shared_table(arrow_rows(spread(intact), spoken, ["key", "source", "text", "who"], "key bigint, source string, text string, who string"), "pairs")
    forget(intact)
    lexical = Model(language=m.language, limits=m.limits, byte_limits=m.byte_limits)
    fit_lexicon(pairs.select("source", "text"), lexical)
    m = lexical
    rows = shared_table(arrow_rows(spread(pairs), lambda *x: _packed(_examples(*x, m, seed)), ["key", "source", "text", "who"], "x binary, y int, fold int"), "examples")
    forget(pairs)
    weights = fitting.regression(rows, BUCKETS, FOLDS, FEATURES)
    m.weights = weights[FOLDS].tolist()
    m.threshold = _cheapest(fitting.held_out(rows, weights, SCORES, FEATURES))
    forget(rows)
    return m


def _packed(examples: Iterable[tuple[list[int], int, int]], most: int = 4096) -> Iterator[tuple]:
    """(feature numbers of up to most examples one after the other, whether they were cut, their fold), of all examples."""
    held: dict[tuple[int, int], list[int]] = defaultdict(list)
    for x, *kind in examples:
        of = held[tuple(kind)]
        of += x
        if len(of) >= most * FEATURES:
            yield np.array(of, np.uint16).tobytes(), *kind
            of.clear()
    for kind, of in held.items():
        if of:
            yield np.array(of, np.uint16).tobytes(), *kind


def _examples(keys: list, sources: list, answered: list, by: list, m: Model, seed: int) -> Iterator[tuple[list[int], int, int]]:
    """(feature numbers, whether it was cut, fold) of the answers, of what is made of them by cutting them, and of intact
    variants of them. Chance goes by the key, so that the order of rows doesn't matter."""
    for key, source, t, who in zip(keys, sources, answered, by):
        rng = random.Random(key * 64 + seed)
        rows: list[tuple[list[int], int, int]] = []
        fold = zlib.crc32(b"%d" % key) % FOLDS

        def add(side: Side, text: str, label: int) -> None:
            shaped = shape(text)
            found = [w.lower() for w in WORD.findall(shaped)]
            missing = lacking(side.needs, set(found))
            if label == 0 and missing > 0.5 * len(side.needs):
                return  # not a rendering of the source, so it isn't known to be intact
            rows.append((features(side, shaped, found, len(text), len(text.encode()), who, m, missing), label, fold))  # noqa: B023

        s, limits = source_of(shape(source), m), m.limits.get(who, frozenset())
        side = _side(s, s.text, len(s.words))
        add(side, t, 0)
        bare = t.rstrip()
        if bare[-1:] == "." and rng.random() < 0.6:
            add(side, bare[:-1], 0)  # lacks nothing but its full stop
        if len(t) > 12:
            for _ in range(2):
                c = _cut(t, limits, rng)
                if c:
                    add(side, c, 1)
            if rng.random() < 0.05:  # answers without a source
                none = side_of("", m)
                add(none, t, 0)
                if c:
                    add(none, c, 1)
        shaped = shape(t)
        hits = [(w.group().lower(), w.end()) for w in WORD.finditer(shaped)]
        words, ends = [w for w, _ in hits], [x for _, x in hits]
        places = _places(s, words, m)
        for _ in range(2):
            both = _broken_off(s, shaped, words, ends, places, m, rng)
            if both:
                add(*both, 0)  # breaks off where its source does
                c = _cut(both[1], limits, rng) if len(both[1]) > 12 else None
                if c:
                    add(both[0], c, 1)
        yield from rows


def _spoken(source: str, text: str) -> tuple[list[str], list[str]]:
    """The answer's words without the source's names, and the source's words without its own."""
    words = WORD.findall(shape(source))
    names = {w.lower() for w in words if w[0].isupper()}
    return [w for w in WORD.findall(shape(text).lower()) if w not in names], [w for w in words if w.islower()]


def _threshold(held: list[tuple[float, int]]) -> float:
    """As _cheapest, of (score, whether cut) of rows held out of the training."""
    place = np.array([[np.searchsorted(SCORES, x, "right"), y] for x, y in held], np.int64).reshape(-1, 2)
    n = len(SCORES) + 1
    return _cheapest(np.array([np.bincount(place[place[:, 1] == k, 0], minlength=n) for k in (0, 1)]))


def _cheapest(held: np.ndarray) -> float:
    """The score at which rows held out of the training are told apart with the least cost, if CUT_PRIOR of all
    answers are cut; in the middle of the scores that cost at most a thousandth more. held: the rows of each label
    that score less than SCORES[0], up to SCORES[1] and so on."""
    if not held[0].sum() or not held[1].sum():
        return 0.0
    below = held.cumsum(axis=1)[:, :-1] / held.sum(axis=1, keepdims=True)
    cost = CUT_PRIOR * below[1] + (1 - CUT_PRIOR) * (1 - below[0])
    return float(SCORES[cost <= cost.min() + 1e-3].mean())


def score(s: Side, text: str, found: list[str], raw: str, producer: str, m: Model) -> float:
    """Log-odds that the text was cut."""
    w = m.weights
    return sum(w[i] for i in features(s, text, found, len(raw), len(raw.encode()), producer, m))


def names_only(s: Side, m: Model) -> bool:
    """The source is made of names, figures or signs, so it may rightly return unchanged."""
    return all(w[0].isdigit() or (c[0].isupper() and not m.renders.get(w, frozenset()) - {w} and m.known.get(w, 0) < max(400, NAMED * m.pairs)) for w, c in zip(s.words, s.cased))


def judge(s: Side, raw: str, producer: str, m: Model) -> tuple[str | None, float]:
    """(the one defect of an answer, or None; the log-odds that it was cut).

    Every answer with words is scored. What is empty, declines, copies or speaks another language lacks the source's
    words for that reason, so the score decides for the others only.
    """
    text = shape(raw)
    found = WORD.findall(text.lower())
    if not found:
        return "empty" if s.words else None, 0.0
    log_odds = score(s, text, found, raw, producer, m)
    if s.words == found and names_only(s, m):
        return None, log_odds
    have = set(found)
    kept = len(s.needs) - lacking(s.needs, have)
    if not (s.needs and kept >= 0.5 * len(s.needs)) and declines(text):
        return "refusal", log_odds
    if s.words and is_copy(s.words, found, s.text, text):
        return None if names_only(s, m) else "copy", log_odds
    if foreign(s, text, m):
        return "language", log_odds
    inside = len(left_open(text)) > s.opened and end_class(text) in "wc~"
    return "truncated" if inside or log_odds > m.threshold else None, log_odds


def defect(s: Side, raw: str, producer: str, m: Model) -> str | None:
    """The one defect of an answer, or None."""
    return judge(s, raw, producer, m)[0]


def _judged(chunks: DataFrame, m: Model) -> DataFrame:
    """(chunk_id, field, defect, cut_log_odds) of every draft and final that isn't null."""

    def run(ids: list, sources: list, drafts: list, finals: list, models: list, patchers: list) -> Iterator[tuple]:
        for i, source, draft, final, by, then in zip(ids, sources, drafts, finals, models, patchers):
            if draft is None and final is None:
                continue
            s = side_of(source or "", m)
            if draft is not None:
                of_draft = judge(s, draft, by or "", m)
                yield i, "draft", *of_draft
            if final is not None:
                # an unchanged final has its draft's defect, whoever is named as its producer
                yield i, "final", *(of_draft if final == draft else judge(s, final, then or "", m))

    return arrow_rows(
        spread(chunks.select("chunk_id", "source", "draft", "final", "model", "patcher")),
        run,
        ["chunk_id", "source", "draft", "final", "model", "patcher"],
        "chunk_id bigint, field string, defect string, cut_log_odds double",
    )


def cut_scores(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """(chunk_id, field, cut_log_odds) of every draft and final that isn't null; 0 for one without words."""
    return _judged(chunks, model or fit(chunks)).select("chunk_id", "field", "cut_log_odds")


def defects(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """(chunk_id, field, defect) of every faulty draft and final.

    Null answers are none and have no row; a null source counts as an empty one, beside which an answer can't be
    empty, a copy or unrendered. Columns other than chunk_id, source, draft, final, model, patcher aren't read.
    """
    return _judged(chunks, model or fit(chunks)).where("defect is not null").select("chunk_id", "field", "defect")


def cut_texts(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """(chunk_id, field) of the drafts and finals that were cut off inside a sentence."""
    return defects(chunks, model).where("defect = 'truncated'").select("chunk_id", "field")


def truncation_report(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """(field, producer, n_texts, n_cut, share_cut) for each model's drafts and each patcher's finals; a null producer is one."""
    cut = cut_texts(chunks, model)
    by = F.explode(F.array(F.struct(F.lit("draft").alias("field"), F.col("model").alias("producer"), F.col("draft").isNotNull().alias("there")), F.struct(F.lit("final").alias("field"), F.col("patcher").alias("producer"), F.col("final").isNotNull().alias("there"))))
    texts = chunks.select("chunk_id", by.alias("x")).select("chunk_id", "x.*").where("there").drop("there")
    marked = texts.join(cut.withColumn("cut", F.lit(1)), ["chunk_id", "field"], "left")
    out = marked.groupBy("field", "producer").agg(F.count("*").alias("n_texts"), F.count("cut").alias("n_cut"))
    return out.withColumn("share_cut", F.col("n_cut") / F.col("n_texts"))
