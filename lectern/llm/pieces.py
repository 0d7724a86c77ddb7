"""Problem 4: splitting oversized texts at natural boundaries.

Method: agglomerative merging. Atoms are sentences that fit a piece, else words, else runs of characters.
Adjacent atoms are held in a heap by the strength of the boundary between them (none, space, sentence end,
line break), and the weakest boundaries are merged first while the joined size plus the overlap fits. The
boundary that a text needs is the weakest one left when atoms are merged up to the limit without overlap.

Scale: a text is independent of all others; the size filter runs in the JVM, so only oversized texts reach
Python, and nothing is shuffled. Work is n log n in the atoms of a text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_rows, spread
from .textform import LINE, sentence_spans

LIMIT, OVERLAP = 1000, 100
LEVELS = ("none", "word", "sentence", "paragraph")
_RUN = re.compile(r"\S+")


def _atoms(text: str, fit: int) -> tuple[list[int], list[int]]:
    """Cut positions in order, from 0 to len(text), and the strength of the boundary at each inner one."""
    at: dict[int, int] = {}
    spans = sentence_spans(text)
    for k, (a, b) in enumerate(spans):
        if k:
            gap = text[spans[k - 1][1] : a]
            at[a] = 3 if LINE.search(gap) else 2
        if b - a > fit:
            for m in _RUN.finditer(text, a, b):
                if m.start() > a:
                    at[m.start()] = max(at.get(m.start(), 0), 1)
                for c in range(m.start() + fit, m.end(), fit):
                    at.setdefault(c, 0)
    # white space longer than a piece between sentences, and after the last one
    cuts = sorted(c for c in at if 0 < c < len(text))
    whole = [0, *cuts, len(text)]
    for a, b in zip(whole, whole[1:]):
        for c in range(a + fit, b, fit):
            at.setdefault(c, 0)
    cuts = sorted(c for c in at if 0 < c < len(text))
    return [0, *cuts, len(text)], [at[c] for c in cuts]


def _bare_atoms(text: str, fit: int) -> tuple[list[int], list[int]]:
    """As _atoms, with line breaks and white space as atoms of their own, so that lines, sentences and words are
    merged without what lies between them."""
    at: dict[int, int] = {}

    def chop(a: int, b: int, s: int) -> None:
        for c in range(a + fit, b, fit):
            at.setdefault(c, s)

    ends = [(m.start(), m.end()) for m in LINE.finditer(text)] + [(len(text), len(text))]
    for b, after in ends:
        at[b] = at[after] = 3
    last = 0
    for a, b in [*sentence_spans(text), (len(text), len(text))]:
        at[a], at[b] = max(at.get(a, 0), 2), max(at.get(b, 0), 2)
        chop(last, a, 2)
        if b - a > fit:
            end = a
            for m in _RUN.finditer(text, a, b):
                chop(end, m.start(), 1)
                for c in (m.start(), m.end()):
                    at[c] = max(at.get(c, 0), 1)
                chop(m.start(), m.end(), 0)
                end = m.end()
        last = b
    cuts = sorted(c for c in at if 0 < c < len(text))
    return [0, *cuts, len(text)], [at[c] for c in cuts]


def _merge(at: list[int], strength: list[int], fit: int) -> list[tuple[int, int, int]]:
    """Atoms between the cuts at, merged over the weakest boundaries first: (start, end, strength before it) of the parts."""
    n = len(at) - 1
    right = list(range(1, n + 1))  # start of the next part, by the part's first atom
    left = list(range(-1, n - 1))
    alive = [True] * n
    size = [at[i + 1] - at[i] for i in range(n)]
    heap = [(strength[i], size[i] + size[i + 1], i, i + 1) for i in range(n - 1) if size[i] + size[i + 1] <= fit]
    heapq.heapify(heap)
    while heap:
        _, both, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or right[i] != j or size[i] + size[j] != both:
            continue
        alive[j] = False
        size[i] = both
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            if both + size[right[i]] <= fit:
                heapq.heappush(heap, (strength[right[i] - 1], both + size[right[i]], i, right[i]))
        if (p := left[i]) >= 0 and size[p] + both <= fit:
            heapq.heappush(heap, (strength[i - 1], size[p] + both, p, i))
    out, i = [], 0
    while i < n:
        out.append((at[i], at[right[i]], strength[i - 1] if i else 3))
        i = right[i]
    return out


def needed_boundary(text: str, limit: int = LIMIT) -> str:
    """The coarsest boundary that suffices, overlap left aside: the weakest that merging up to the limit leaves."""
    return LEVELS[min((s for _, _, s in _merge(*_bare_atoms(text, limit), limit)), default=3)]


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary before it) of each piece's own part; the parts tile the text."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    if len(text) <= limit:
        return [(0, len(text), 3)]
    return _merge(*_atoms(text, limit - overlap), limit - overlap)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start with overlap, own start, end, boundary) of each piece; end - start <= limit."""
    out = []
    for a, b, s in cut_points(text, limit, overlap):
        start = max(0, a - overlap) if a else 0
        if 0 < start and not text[start - 1].isspace():  # begin the overlap at a word, where there is one
            m = re.compile(r"\s\S").search(text, start, a)
            start = m.start() + 1 if m else start
        out.append((start, a, b, LEVELS[s]))
    return out


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(row_id, boundary, piece_no, own_start, cut_at, piece) for each text over the limit.

    boundary is the coarsest that suffices for the text; cut_at is the boundary before the piece. Texts that
    fit, and nulls, have no row. piece_no counts from 1, and piece[own_start:] of all pieces tile the text.
    """

    def run(ids: list, texts: list) -> Iterator[tuple]:
        for i, t in zip(ids, texts):
            level = needed_boundary(t, limit)
            for k, (start, own, end, s) in enumerate(split_text(t, limit, overlap), 1):
                yield i, level, k, own - start, s, t[start:end]

    long = spread(df.select(id_col, text_col).where(F.length(text_col) > limit))
    schema = "row_id bigint, boundary string, piece_no int, own_start int, cut_at string, piece string"
    return arrow_rows(long, run, [id_col, text_col], schema)
