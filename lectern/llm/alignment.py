"""Problem 6: sentence alignment in bilingual documents.

Method: shared numbers, names, cognates and, from a small lexicon, words that render each other score pairs of
sentences through an inverted index. Pairs that are each other's best are anchors, sentences of equal words in
their order; their longest increasing subsequence is the chain. Gaps between its links are aligned by local
dynamic programming over 1-1, 1-2, 2-1, 1-0 and 0-1 beads, where a bead of three pays for what its two sentences
both explain of the third; sentences that were moved, joined or divided elsewhere are then linked to the sentence
that covers them, if one does.

Scale: a document is independent of the others; only pairs of different sentences that share an anchor are scored.
A gap of any size is aligned exactly: rows of the table are vectors, and of a gap of a by b sentences some
2 sqrt(a) rows are held at once. The lexicon is fitted on all pairs, in passes over them of which counts are shuffled
(fitting.py), and travels with the function.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from ..runtime import arrow_rows, forget, shared_table, spread
from .answers import Model, end_class, fit_lexicon, shape
from .textform import WORD, sentences

LEAST = 0.5  # score of a pair of sentences that may be linked
COVERED, SHARED = 0.6, 0.5  # cover of a sentence that joins another pair, and the most that it shares with the pair's own
_COMMON = frozenset("the of and to in that it he she was had with not for on at by from his her you i but is as this there then a an un une de la le les du des et à".split())


def lexicon(pairs: DataFrame, source_col: str, final_col: str) -> Model:
    """What renders what, fitted on all pairs that differ and end alike."""

    def run(sources: list, finals: list) -> Iterator[tuple]:
        for s, t in zip(sources, finals):
            if s and t and s != t and end_class(shape(s)) == end_class(shape(t)):
                yield s, t

    m = Model()
    both = pairs.where(f"{source_col} is not null and {final_col} is not null")
    intact = shared_table(arrow_rows(spread(both), run, [source_col, final_col], "source string, text string"), "pairs")
    fit_lexicon(intact, m)
    forget(intact)
    return m


def _stem(w: str) -> str:
    """The part that cognates of two languages share, for words long enough to have one."""
    return w[:5] if len(w) >= 7 else w


def _rendering(m: Model) -> frozenset[str]:
    """All words that render some source word."""
    found = m.__dict__.get("_rendering")
    if found is None:
        found = m.__dict__["_rendering"] = frozenset(t for r in m.renders.values() for t in r)
    return found


def _scores(src: list[frozenset[str]], times: list[int], tgt: list[frozenset[str]], m: Model) -> list[list[dict[int, float]]]:
    """For each different source sentence, by different target sentence: the covered share of its weight; the reverse;
    the covered share of those of its words of which a rendering is known or there; the covered share of those of
    the target's words that some source sentence covers. times: how often each source sentence comes."""
    n, k = len(src), len(tgt)
    index: dict[str, list[int]] = defaultdict(list)
    stems: dict[str, list[int]] = defaultdict(list)
    for j, ws in enumerate(tgt):
        for w in ws:
            index[w].append(j)
            if len(w) >= 7:
                stems[_stem(w)].append(j)
    total_n = sum(times)
    df: Counter[str] = Counter()
    for ws, c in zip(src, times):
        for w in ws:
            df[w] += c
    cover: list[dict[int, float]] = []
    known: list[dict[int, float]] = []
    explained: list[dict[str, float]] = [defaultdict(float) for _ in range(k)]
    by_pair: list[dict[int, dict[str, float]]] = []
    for ws in src:
        total, sure, got, pair_words = 0.0, 0.0, defaultdict(float), defaultdict(dict)
        for w in ws:
            options = m.renders.get(w)
            if options is None:
                if w in _COMMON or w in m.common:
                    continue
                options = (w,)
            at: dict[int, str] = {}
            for o in options:
                for j in index.get(o, ()):
                    at.setdefault(j, o)
            if not at and len(w) >= 7:
                at = {j: _stem(w) for j in stems.get(_stem(w), ())}
            weight = math.log(1 + total_n / df[w]) * (1.5 if w[0].isdigit() else 1.0)
            if not at and w not in m.renders:
                weight *= 0.3  # nothing is known of this word
            else:
                sure += weight
            total += weight
            for j, o in at.items():
                got[j] += weight
                pair_words[j][o] = weight
                explained[j][o] = max(explained[j][o], weight)
        cover.append({j: v / total for j, v in got.items()} if total else {})
        known.append({j: v / sure for j, v in got.items()} if sure else {})
        by_pair.append(pair_words)
    rendering = _rendering(m)
    usual = math.log(1 + total_n)
    # words of a target sentence that should come from somewhere, but from nothing in this source, count as well
    lost = [0.6 * usual * sum(1 for w in ws if w in rendering and w not in explained[j]) for j, ws in enumerate(tgt)]
    back: list[dict[int, float]] = [{} for _ in range(n)]
    known_back: list[dict[int, float]] = [{} for _ in range(n)]
    for i in range(n):
        for j, found in by_pair[i].items():
            here, sure = sum(explained[j][o] for o in found), sum(explained[j].values())
            back[i][j] = here / (sure + lost[j])
            known_back[i][j] = here / sure
    return [cover, back, known, known_back]


def _chain(anchors: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The longest subsequence of anchors, which are in source order, whose targets increase."""
    tails: list[int] = []  # least last target of an increasing run of each length
    at: list[int] = []
    back: list[int] = []
    for k, (_, j, _) in enumerate(anchors):
        p = bisect_left(tails, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(anchors[k][:2])
        k = back[k]
    return out[::-1]


Rows = Callable[[int], np.ndarray]


def _gap(a: int, b: int, score: Rows, known: Rows, back: Rows, least: float) -> list[tuple[int, int]]:
    """Links of the best monotone alignment of a source and b target sentences, counted from 0.

    score, known and back give a source sentence's row of b values. A bead adds what its pairs score over least,
    less what its two sentences both explain of the third.
    """
    nothing = np.zeros(b)

    def beads(x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By the last target sentence, the gains of 1-1, 2-1 and 1-2 beads that end with source sentence x; 0 for none."""
        g = np.maximum(score(x) - least, 0.0)
        two = one_two = nothing
        if x:
            h = np.maximum(score(x - 1) - least, 0.0)
            two = np.where((g > 0) & (h > 0), g + h - np.maximum(back(x - 1) + back(x) - 1, 0.0), 0.0)
        if b > 1:
            c = known(x)
            joined = g[1:] + g[:-1] - np.maximum(c[1:] + c[:-1] - 1, 0.0)
            one_two = np.concatenate(([0.0], np.where((g[1:] > 0) & (g[:-1] > 0), joined, 0.0)))
        return g, two, one_two

    def row_after(x: int, last: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        g, two, one_two = beads(x)
        new = last.copy()
        np.maximum(new[1:], np.where(g > 0, last[:-1] + g, 0.0), out=new[1:])
        if before is not None:
            np.maximum(new[1:], np.where(two > 0, before[:-1] + two, 0.0), out=new[1:])
        if b > 1:
            np.maximum(new[2:], np.where(one_two[1:] > 0, last[:-2] + one_two[1:], 0.0), out=new[2:])
        return np.maximum.accumulate(new)

    every = max(2, math.isqrt(a))
    rows = {0: np.zeros(b + 1)}  # best values, by the number of source sentences; of every run of rows the first two stay
    last, before = rows[0], None
    for x in range(a):
        last, before = row_after(x, last, before), last
        if (x + 1) % every in (0, every - 1):
            rows[x + 1] = last
    out: list[tuple[int, int]] = []
    x, y = a, b
    while x and y:
        if x not in rows or (x > 1 and x - 2 not in rows) or x - 1 not in rows:
            first = max(0, (x - 2) // every * every)
            kept = {k: rows[k] for k in rows if k <= first}
            last, before = kept[first], kept.get(first - 1)
            for k in range(first, x):
                last, before = row_after(k, last, before), last
                kept[k + 1] = last
            rows = kept
        value = rows[x][y]
        g, two, one_two = (v[y - 1] for v in beads(x - 1))
        if g > 0 and rows[x - 1][y - 1] + g == value:
            dx, dy = 1, 1
        elif two > 0 and rows[x - 2][y - 1] + two == value:
            dx, dy = 2, 1
        elif one_two > 0 and rows[x - 1][y - 2] + one_two == value:
            dx, dy = 1, 2
        else:
            dx, dy = (1, 0) if rows[x - 1][y] == value else (0, 1)
        out += [(x - 1 - p, y - 1 - q) for p in range(dx) for q in range(dy)]
        x, y = x - dx, y - dy
    return out


def _classes(texts: list[str]) -> tuple[list[int], list[frozenset[str]], list[list[int]]]:
    """Each sentence's class of equal words, the classes' words, and the places of each."""
    numbers: dict[frozenset[str], int] = {}
    of = [numbers.setdefault(frozenset(WORD.findall(shape(x).lower())), len(numbers)) for x in texts]
    places: list[list[int]] = [[] for _ in numbers]
    for i, c in enumerate(of):
        places[c].append(i)
    return of, list(numbers), places


def align(source: str, final: str, m: Model, least: float = LEAST) -> list[tuple[int, int]]:
    """Pairs of 1-based sentence numbers of which one renders the other or a part of it."""
    src_of, src, src_at = _classes(sentences(source))
    tgt_of, tgt, tgt_at = _classes(sentences(final))
    n, k = len(src_of), len(tgt_of)
    if not n or not k:
        return []
    cover, back, known, known_back = _scores(src, [len(x) for x in src_at], tgt, m)
    s = [{j: 0.7 * max(cover[i][j], back[i][j]) + 0.3 * min(cover[i][j], back[i][j]) for j in cover[i]} for i in range(len(src))]
    best_of_tgt: list[tuple[float, int]] = [(0.0, -1)] * len(tgt)
    for i in range(len(src)):
        for j, v in s[i].items():
            if v > best_of_tgt[j][0]:
                best_of_tgt[j] = (v, i)
    anchors: list[tuple[int, int, float]] = []
    for i in range(len(src)):
        j = max(s[i], key=lambda j: (s[i][j], -j), default=-1)
        # sentences that come several times are anchors only if they come as often in both texts
        if j >= 0 and best_of_tgt[j][1] == i and s[i][j] >= least and len(src_at[i]) == len(tgt_at[j]):
            anchors += [(a, b, s[i][j]) for a, b in zip(src_at[i], tgt_at[j])]
    anchors.sort()
    chain = _chain(anchors)
    links = set(chain)
    targets = np.array(tgt_of)

    def rows_of(values: list[dict[int, float]], first: int, ja: int, jb: int) -> Rows:
        cache: dict[int, np.ndarray] = {}

        def row(x: int) -> np.ndarray:
            c = src_of[first + x]
            found = cache.get(c)
            if found is None:
                if len(cache) > 4:
                    cache.clear()
                by_class = np.zeros(len(tgt))
                if values[c]:
                    by_class[list(values[c])] = list(values[c].values())
                found = cache[c] = by_class[targets[ja:jb]]
            return found

        return row

    edges = [(-1, -1), *chain, (n, k)]
    for (ia, ja), (ib, jb) in zip(edges, edges[1:]):
        if ib - ia > 1 and jb - ja > 1:
            score, c, r = (rows_of(v, ia + 1, ja + 1, jb) for v in (s, known, known_back))
            links.update((ia + 1 + i, ja + 1 + j) for i, j in _gap(ib - ia - 1, jb - ja - 1, score, c, r, least))
    links.update((i, j) for i, j, _ in anchors)  # anchors off the chain were moved
    # joined, divided and moved sentences: the one that covers them holds them, unless its own link explains as much
    in_tgt, in_src = defaultdict(float), defaultdict(float)
    for i, j in links:
        in_tgt[j] += known_back[src_of[i]].get(tgt_of[j], 0.0)
        in_src[i] += known[src_of[i]].get(tgt_of[j], 0.0)
    for i in range(n):
        c = src_of[i]
        if i not in in_src and cover[c]:
            t = max(cover[c], key=lambda x: (cover[c][x], back[c][x], -x))
            j = min(tgt_at[t], key=lambda j: (in_tgt.get(j, 0.0), j))
            if cover[c][t] >= COVERED and in_tgt.get(j, 0.0) + known_back[c][t] <= 1 + SHARED:
                links.add((i, j))
                in_tgt[j] += known_back[c][t]
    by_tgt: list[dict[int, float]] = [{} for _ in tgt]
    for i in range(len(src)):
        for j, v in back[i].items():
            by_tgt[j][i] = v
    linked = {j for _, j in links}
    for j in range(k):
        t = tgt_of[j]
        if j not in linked and by_tgt[t]:
            c = max(by_tgt[t], key=lambda x: (by_tgt[t][x] * cover[x][t], -x))
            i = min(src_at[c], key=lambda i: (in_src.get(i, 0.0), i))
            if by_tgt[t][c] >= COVERED and in_src.get(i, 0.0) + known[c][t] <= 1 + SHARED:
                links.add((i, j))
                in_src[i] += known[c][t]
    return sorted((i + 1, j + 1) for i, j in links)


def sentence_pairs(sections: DataFrame, id_col: str, source_col: str, final_col: str, m: Model) -> DataFrame:
    """(section_id, src_sent, tgt_sent) of every pair; sentences count from 1. Null or empty texts give no row."""

    def run(ids: list, sources: list, finals: list) -> Iterator[tuple]:
        for i, s, t in zip(ids, sources, finals):
            for a, b in align(s, t, m):
                yield i, a, b

    both = sections.select(id_col, source_col, final_col).where(f"{source_col} is not null and {final_col} is not null")
    return arrow_rows(spread(both), run, [id_col, source_col, final_col], "section_id bigint, src_sent bigint, tgt_sent bigint")
