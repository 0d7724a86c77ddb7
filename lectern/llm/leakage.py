"""Problem 7: evaluation texts leaking into training text.

Method: CGK random-walk embedding. From a place of a text a random walk writes, at each step, the digest of the
current word and moves on by a random bit of it; stretches a few edits apart then agree in most places, so edit
distance becomes Hamming distance. Repeated bit sampling of the walks is the LSH: in each of several rounds
(WALKS walks, SAMPLES samples each) the digest of SAMPLE places, fewer in the least window, is the key. Windows are sized to the item: a third of its words
(window_of), so that a leaked half has windows of its own; a walk of the longest window holds those of the
shorter ones as its beginnings, so one walk serves every size.

Where walks begin: a place with at least half of an item in order and the edits allowed has, if the item has
RUN_ITEM words or more, at least one run of GRAM words that is the item's as well (m matched words with e edits make e + 1
runs at most). Documents are walked from such runs only, which loses no case and leaves about a tenth of the
places. Items of fewer words are too short for a walk: there each run of min(GRAM, half) words is a candidate, which is exact.
Every candidate's place is verified by exact word edit alignment over (matches, edits).

Scale: the items are a stated query set. They are read in blocks of at most BLOCK_WORDS words, one block at a time
on the driver, and a block's index (some 50 MB at most) is broadcast. Documents are read once per block of items
and not shuffled; only (doc_id, item_id) pairs leave the scan.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame

from ..runtime import arrow_rows, spread
from .textform import WORD, digests, visible

SHARE, EDITS = 0.5, 0.13
GRAM = 4
RUN_ITEM = 20  # words; shorter items are found by their runs
WALKS, SAMPLES, SAMPLE = 3, 4, 7
LEAST_WINDOW, MOST_WINDOW, STEP_UP = 6, 48, 1.3  # window sizes in words, in steps of a factor
BLOCK_WORDS = 100_000  # words of the items whose index is broadcast at once

# Page marks between the words of a text: [p. 12], (p. 12), - 12 -, a line of figures only.
_PAGE_MARK = re.compile(r"\[\s*(?:p|pp|page)\.?\s*\d+\s*\]|\(\s*(?:p|pp|page)\.?\s*\d+\s*\)|(?m:^[ \t]*[-–—]?[ \t]*\d{1,4}[ \t]*[-–—]?[ \t]*$)", re.I)
_HYPHENATED = re.compile(r"(?<=[^\W\d_])-[ \t]*\n[ \t]*(?=[a-zà-ÿ])")
_FIGURE = re.compile(r"\d")
_UNUSUAL = re.compile(r"[^\x00-\xac\xae-ɏ–-‟… ]")  # what may hide or change a letter


def comparable(text: str) -> list[str]:
    """The words as they count here: no case, punctuation, line breaks, page marks or invisible characters."""
    t = visible(text) if _UNUSUAL.search(text) else text
    if ("\n" in t or "[" in t or "(" in t) and _FIGURE.search(t):
        t = _PAGE_MARK.sub(" ", t)
    if "-\n" in t or "- " in t or "-\t" in t:
        t = _HYPHENATED.sub("", t)
    return WORD.findall(t.lower())


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(31))


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Digests of the n words from each place on that has as many; a run over a text's end has digest 0."""
    m = max(0, len(words) - n + 1)
    out, end = words[:m].copy(), words[:m] == 0
    for k in range(1, n):
        with np.errstate(over="ignore"):
            out = _mix(out, 17) * np.uint64(3) + words[k : m + k]
        end |= words[k : m + k] == 0
    out[end] = 0
    return out


# --- the walk ------------------------------------------------------------------------------------------------


def window_sizes(most: int = MOST_WINDOW) -> list[int]:
    out = [LEAST_WINDOW]
    while (x := int(out[-1] * STEP_UP + 0.5)) <= most:
        out.append(x)
    return out


def window_of(n: int) -> int:
    """The size, by its number, of the windows of an item of n words: the greatest within a third of it.

    Of an item over three times the greatest size, a leaked half has the more windows.
    """
    return max([k for k, x in enumerate(window_sizes()) if 3 * x <= n], default=0)


@lru_cache(maxsize=1)
def _salts() -> list[int]:
    return np.random.default_rng(77).integers(1, 2**62, 4096, dtype=np.int64).tolist()


@lru_cache(maxsize=1)
def _samples() -> list[list[list[np.ndarray]]]:
    """By window size, walk and sample: the places drawn."""
    rng = np.random.default_rng(78)
    return [[[np.sort(rng.choice(2 * x - 2, min(SAMPLE, x - 1), replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)] for x in window_sizes()]


def window_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: list[int]) -> np.ndarray:
    """(len(starts), len(sizes), WALKS * SAMPLES) keys of the windows that begin at the starts.

    ends: where the text of each start ends; words has a 0 there, on which a walk stays. sizes are numbers of
    window_sizes.
    """
    keys = np.empty((len(starts), len(sizes), WALKS * SAMPLES), np.uint64)
    if not len(starts) or not sizes:
        return keys
    salts, samples = _salts(), _samples()
    steps = 2 * max(window_sizes()[k] for k in sizes) - 2
    for walk in range(WALKS):
        at = starts.copy()
        written = np.empty((steps, len(starts)), np.uint64)
        for step in range(steps):
            if step % 32 == 0:
                bits = _mix(words, salts[walk + WALKS * (step // 32)])
            written[step] = words[at]
            # the walk's random bit for (step, word): one bit of the word's mixed digest
            at = np.minimum(at + ((bits[at] >> np.uint64(step % 32)) & np.uint64(1)).astype(np.int64), ends)
        for c, size in enumerate(sizes):
            for k, places in enumerate(samples[size][walk]):
                number = walk * SAMPLES + k
                h = np.full(len(starts), np.uint64(salts[1000 + size * WALKS * SAMPLES + number]))
                with np.errstate(over="ignore"):
                    for p in places:
                        h = (h ^ written[p]) * np.uint64(0x100000001B3)
                        h ^= h >> np.uint64(29)
                keys[:, c, number] = h
    return keys


# --- the index -----------------------------------------------------------------------------------------------


@dataclass
class Table:
    """Sorted keys, each with its range of (item, place) rows."""

    keys: np.ndarray
    first: np.ndarray
    count: np.ndarray
    content: np.ndarray  # a digest of the rows of each key, by which equal ranges are known
    item: np.ndarray
    place: np.ndarray
    marked: np.ndarray

    def meet(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in keys, numbers of the table's keys) where they are equal."""
        if not len(self.keys) or not len(keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.marked[_mark(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        there = self.keys[at] == keys[maybe]
        return maybe[there], at[there]


MARK_BITS = 22


def _mark(keys: np.ndarray) -> np.ndarray:
    """Where a table notes that a key may be there, so that most keys cost one look."""
    return (keys >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _table(keys: list[np.ndarray], items: list[np.ndarray], places: list[np.ndarray]) -> Table:
    k, i, p = (np.concatenate([np.empty(0, t), *x]) for x, t in ((keys, np.uint64), (items, np.int32), (places, np.int32)))
    order = np.argsort(k, kind="stable")
    k, i, p = k[order], i[order], p[order]
    unique, first, count = np.unique(k, return_index=True, return_counts=True)
    rows = _mix(i.astype(np.uint64) << np.uint64(32) | p.astype(np.uint64), 29)
    content = np.add.reduceat(rows, first) if len(first) else rows
    marked = np.zeros(1 << MARK_BITS if len(k) else 1, bool)
    if len(k):
        marked[_mark(k)] = True
    return Table(unique, first, count, content, i.astype(np.int32), p.astype(np.int32), marked)


@dataclass
class Index:
    """What a scan needs of a block of items."""

    ids: list[int]
    words: list[list[str]]
    digests: list[np.ndarray]
    walked: Table
    sizes: list[int]  # the window sizes in use
    starts: np.ndarray  # sorted digests of the runs that walks begin with
    short: dict[int, Table] = field(default_factory=dict)  # by length, the runs of short items
    pairs: np.ndarray | None = None  # sorted digests of two neighbouring words of the items
    pair_first: np.ndarray | None = None  # by pair, the range of items that have it
    pair_items: np.ndarray | None = None
    own: list[np.ndarray] = field(default_factory=list)  # by item, the sorted numbers of its pairs


def index_items(rows: Iterable[tuple[int, str]]) -> Index:
    cache: dict[str, int] = {}
    ids, texts, found = [], [], []
    for i, t in rows:
        w = comparable(t or "")
        if w:
            ids.append(i)
            texts.append(w)
            found.append(digests(w, cache))
    keys, item, place, starts = [], [], [], [np.empty(0, np.uint64)]
    short: dict[int, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))
    used = sorted({window_of(len(w)) for w in texts if len(w) >= RUN_ITEM})
    for k, d in enumerate(found):
        if len(d) >= RUN_ITEM:
            ended = np.append(d, np.uint64(0))
            at = np.arange(len(d) - GRAM + 1)
            own_keys = window_keys(ended, at, np.full(len(at), len(d)), [window_of(len(d))])[:, 0]
            keys.append(own_keys.ravel())
            item.append(np.full(own_keys.size, k, np.int32))
            place.append(np.repeat(at.astype(np.int32), own_keys.shape[1]))
            starts.append(runs(d, GRAM))
        else:
            n = min(GRAM, -(-len(d) // 2))
            r = runs(d, n)
            short[n][0].append(r)
            short[n][1].append(np.full(len(r), k, np.int32))
            short[n][2].append(np.arange(len(r), dtype=np.int32))
    of = [np.unique(runs(d, 2)) for d in found]
    pairs = np.unique(np.concatenate([np.empty(0, np.uint64), *of]))
    own = [np.searchsorted(pairs, x) for x in of]
    number = np.concatenate([np.empty(0, np.int64), *own])
    order = np.argsort(number, kind="stable")
    has = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])[order] if own else np.empty(0, np.int32)
    pair_first = np.searchsorted(number[order], np.arange(len(pairs) + 1))
    return Index(ids, texts, found, _table(keys, item, place), used, np.unique(np.concatenate(starts)), {n: _table(*x) for n, x in short.items()}, pairs, pair_first, has, own)


# --- verification --------------------------------------------------------------------------------------------


def _least_pairs(n: int) -> float:
    """A necessary condition of holds(): of m words matched in order with e edits between them, at least m - 1 - e
    neighbours are neighbours in the item as well."""
    return SHARE * n * (1 - EDITS / (1 - EDITS)) - 1


def holds(item: np.ndarray, text: np.ndarray, share: float = SHARE, edits: float = EDITS) -> bool:
    """Exact verification: some stretch of text, aligned word by word with some stretch of item, has at least the
    share of the item's words matched in order, and of matches and edits together at most the given rate are edits,
    a word changed, dropped or added being one.

    For every end of the two stretches and every number of edits that could be allowed, the most matches are
    computed; more matches for the same edits never make a case worse, so nothing is lost.
    """
    n, k = len(item), len(text)
    need = max(1.0, share * n)
    rate = edits / (1 - edits)
    most = int(rate * n + 1e-9)
    least = np.maximum(need, np.arange(most + 1) / rate - 1e-9 if rate else 0)[:, None]
    above = np.zeros((most + 1, k + 1), np.int32)
    for w in item:
        equal = text == w
        row = np.zeros((most + 1, k + 1), np.int32)
        row[:, 1:] = (above[:, :-1] + 1) * equal
        if most:
            edited = np.maximum(above[:-1, :-1], above[:-1, 1:])
            np.maximum(row[1:, 1:], edited, out=row[1:, 1:])
            for e in range(1, most + 1):
                np.maximum(row[e, 1:], row[e - 1, :-1], out=row[e, 1:])
        if (row >= least).any():
            return True
        above = row
    return False


def _in_order(item: list[str], part: list[str]) -> int:
    """Length of the longest common subsequence, with bit vectors: it bounds the matches from above."""
    n = len(item)
    places: dict[str, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << n) - 1
    v = full
    for w in part:
        m = places.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


# --- the scan ------------------------------------------------------------------------------------------------


def _blocks(items: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most block_words words, or of one item; the driver holds a block at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for i, t in items.select(item_id, item_text).where(f"`{item_id}` is not null and `{item_text}` is not null").distinct().toLocalIterator():
        n = t.count(" ") + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += n
    yield block


def leaks(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id): documents and the items they hold, whole or in part. Each pair comes once.

    Null and empty texts hold nothing, and items without words are in nothing. Half of an item of one or two words
    is one word, which any document with that word holds. Of several texts under one id any will do.
    """
    docs = spread(documents.select(id_col, text_col).where(f"`{text_col}` is not null"))
    scans = [_scan(docs, id_col, text_col, index_items(sorted(b))) for b in _blocks(items, item_id, item_text, block_words)]
    return reduce(DataFrame.unionByName, scans).distinct()


def _scan(docs: DataFrame, id_col: str, text_col: str, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(ids: list, texts: list) -> Iterator[tuple]:
        x: Index = shared.value
        cache: dict[str, int] = {}
        if not x.ids:
            return
        group: list[tuple[int, list[str]]] = []
        size = 0
        for i, t in zip(ids, texts):
            w = comparable(t)
            if w:
                group.append((i, w))
                size += len(w) + 1
            if size > 50_000:
                yield from _group(group, x, cache)
                group, size = [], 0
        if group:
            yield from _group(group, x, cache)

    return arrow_rows(docs, run, [id_col, text_col], "doc_id bigint, item_id bigint")


def _distinct_rows(*columns: np.ndarray) -> list[list[int]]:
    """The columns of the distinct rows, in order; values of any size."""
    order = np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in rows], axis=0)
    return [c[new].tolist() for c in rows]


def _members(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of the values among the sorted known ones; -1 for others."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _candidates(flat: np.ndarray, doc_of: np.ndarray, starts: np.ndarray, x: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, shift of the item's start) of every candidate, repeats included."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(table: Table, at: np.ndarray, key: np.ndarray) -> None:
        # a place that meets the same rows in several keys is taken once
        with np.errstate(over="ignore"):
            _, once = np.unique(table.content[key] + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
        at, key = at[once], key[once]
        first, times = table.first[key], table.count[key]
        row = np.repeat(first - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        d = np.repeat(doc_of[at], times)
        out.append((d, table.item[row].astype(np.int64), np.repeat(at, times) - starts[d] - table.place[row]))

    if len(x.walked.keys):
        at = np.flatnonzero(_members(runs(flat, GRAM), x.starts) >= 0)
        keys = window_keys(flat, at, starts[doc_of[at] + 1] - 1, x.sizes)
        hit, key = x.walked.meet(keys.reshape(-1))
        if len(hit):
            add(x.walked, at[hit // (keys.shape[1] * keys.shape[2])], key)
    for n, table in x.short.items():
        at, key = table.meet(runs(flat, n))
        if len(at):
            add(table, at, key)
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(3))  # type: ignore[return-value]
    return tuple(np.concatenate(c) for c in zip(*out))  # type: ignore[return-value]


def _group(group: list[tuple[int, list[str]]], x: Index, cache: dict[str, int]) -> Iterator[tuple]:
    """The leaks of some documents, whose windows are walked together."""
    lengths = np.array([len(w) + 1 for _, w in group])
    starts = np.concatenate(([0], np.cumsum(lengths)))
    flat = np.zeros(starts[-1], np.uint64)
    inside = np.ones(len(flat), bool)
    inside[starts[1:] - 1] = False  # a 0 ends each document
    flat[inside] = digests([w for _, ws in group for w in ws], cache)
    doc_of = np.repeat(np.arange(len(group)), lengths)
    d, item, shift = _candidates(flat, doc_of, starts, x)
    if not len(d):
        return
    # a document with too few of an item's pairs anywhere can't hold it
    pair = _members(runs(flat, 2), x.pairs)
    least = np.array([_least_pairs(len(w)) for w in x.words])
    keep = np.ones(len(d), bool)
    order = np.argsort(d, kind="stable")
    cuts = np.flatnonzero(np.diff(d[order], prepend=-1, append=-1))
    for a, b in zip(cuts, cuts[1:]):
        k = d[order[a]]
        own = pair[starts[k] : starts[k + 1] - 1]
        own = own[own >= 0]
        first = x.pair_first[own]
        times = x.pair_first[own + 1] - first
        row = np.repeat(first - np.concatenate(([0], np.cumsum(times)[:-1]))[: len(times)], times) + np.arange(times.sum())
        enough = np.bincount(x.pair_items[row], minlength=len(x.ids)) >= least
        keep[order[a:b]] = enough[item[order[a:b]]]
    found: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, i, s in zip(*_distinct_rows(d[keep], item[keep], shift[keep])):
        found[k, i].append(s)
    for (k, i), shifts in found.items():
        doc_id, words = group[k]
        n = len(x.words[i])
        # an alignment with all the edits allowed strays from its candidate's shift by no more than they are
        slack = int(EDITS / (1 - EDITS) * n) + 1
        ranges: list[list[int]] = []
        for s in shifts:  # in order
            a, b = max(0, s - slack), min(len(words), s + n + slack)
            if ranges and a <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], b)
            else:
                ranges.append([a, b])
        for a, b in ranges:
            here = pair[starts[k] + a : starts[k] + b - 1]
            if np.count_nonzero(_members(here[here >= 0], x.own[i]) >= 0) < least[i]:
                continue
            if _in_order(x.words[i], words[a:b]) >= SHARE * n and holds(x.digests[i], flat[starts[k] + a : starts[k] + b]):
                yield doc_id, x.ids[i]
                break
