"""Fitting over whole tables: word counts, the greedy cover of a lexicon and a logistic regression, in passes over all
rows of which only sums come to the driver.

Words are counted by task and summed. For the lexicon, pairs are written once as numbers of words; a round of the
greedy cover counts, over the pairs not covered yet, only those target words that are frequent enough to be chosen, which
leaves no other choice. The regression is fitted by L-BFGS on the gradients of all examples, whose feature numbers are
written once. No result depends on the order of rows, but for the last digits of sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import forget, shared_table

HELD = 500_000  # words that a task counts before it passes them on; of pairs of words, eight times as many
ROUNDS = 8  # words that render one
STEPS, MEMORY = 30, 8  # of L-BFGS
PRIOR = 0.05  # that weights are 0, as half so many examples a square


def counted(df: DataFrame, slots: int, fn: Callable[..., tuple[Iterable[str], ...]]) -> DataFrame:
    """(word, n0, n1, …): how often each word comes in the slots that fn(*row) gives, over all rows."""
    names = [f"n{k}" for k in range(slots)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            words = list(set().union(*totals))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in totals)], names=["word", *names])

        totals: list[Counter[str]] = [Counter() for _ in names]
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                for c, found in zip(totals, fn(*row)):
                    c.update(found)
            if max(map(len, totals)) > HELD:
                yield flush()
                totals = [Counter() for _ in names]
        yield flush()

    rows = df.mapInArrow(run, "word string, " + ", ".join(f"{n} bigint" for n in names))
    return rows.groupBy("word").agg(*(F.sum(n).alias(n) for n in names))


def middle(df: DataFrame, fn: Callable[..., float | None]) -> float:
    """The middle value of fn(*row) over all rows, to four places; rows without a value don't count."""
    n = counted(df, 1, lambda *row: (() if (x := fn(*row)) is None else (str(round(x * 10_000)),),)).collect()
    values = sorted((int(r.word), r.n0) for r in n)
    half, before = sum(c for _, c in values) // 2, 0
    for v, c in values:
        before += c
        if before > half:
            return v / 10_000
    return 0.0


def _merged(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, at = np.unique(codes, return_inverse=True)
    return each, np.bincount(at, n, len(each)).astype(np.int64)


def cover(pairs: DataFrame, words: Callable[..., tuple[Iterable[str], Iterable[str]]], active: dict[str, int], targets: dict[str, int], n: int) -> dict[str, tuple[frozenset[str], int]]:
    """By source word: the target words that a greedy cover of its pairs picks, and how many pairs they leave.

    active and targets: words and the pairs they are in; n: all pairs. The word most particular to the pairs that hold w
    is picked, then the one most particular to those not covered yet, and so on.
    """
    if not active or not targets:
        return {}
    spark = pairs.sparkSession
    s_words, t_words = sorted(active), sorted(targets)
    c, n_t, width = np.array([active[w] for w in s_words], np.int64), np.array([targets[w] for w in t_words], np.int64), len(t_words)
    numbers = spark.sparkContext.broadcast(({w: k for k, w in enumerate(s_words)}, {w: k for k, w in enumerate(t_words)}))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_s, number_t = numbers.value
        for batch in batches:
            s, t = [], []
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                a, b = words(*row)
                s.append([number_s[w] for w in a if w in number_s])
                t.append([number_t[w] for w in b if w in number_t])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())) for x in (s, t)], names=["s", "t"])

    coded = shared_table(pairs.mapInArrow(encode, "s array<int>, t array<int>").where("size(s) > 0 and size(t) > 0"), "coded-pairs")
    picked: list[list[int]] = [[] for _ in s_words]
    left, alive = c.copy(), np.ones(len(c), bool)
    for _ in range(ROUNDS):
        if not alive.any():
            break
        chosen = np.sort(np.array([w * width + t for w, ts in enumerate(picked) for t in ts], np.int64))
        state = spark.sparkContext.broadcast((alive, left, n_t, chosen, np.array([bool(x) for x in picked])))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            alive, left, n_t, chosen, more = state.value  # noqa: B023
            codes, counts, held = [], [], 0
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    part = whole.slice(at, 2048)
                    s, t = part.column(0), part.column(1)
                    t_from, t_n = t.offsets.to_numpy()[:-1].astype(np.int64), np.diff(t.offsets.to_numpy())
                    t_from = t_from - t.offsets[0].as_py()
                    w, flat = s.flatten().to_numpy().astype(np.int64), t.flatten().to_numpy().astype(np.int64)
                    pair = np.repeat(np.arange(len(t_n)), np.diff(s.offsets.to_numpy()))
                    go = alive[w]
                    w, pair = w[go], pair[go]
                    size = t_n[pair]
                    entry = np.repeat(np.arange(len(w)), size)
                    other = flat[np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(t_from[pair], size)]
                    code = w[entry] * width + other
                    if len(chosen):
                        k = np.minimum(np.searchsorted(chosen, code), len(chosen) - 1)
                        done = np.zeros(len(w), bool)
                        done[entry[chosen[k] == code]] = True
                        keep = ~done[entry]
                        code, entry, other = code[keep], entry[keep], other[keep]
                    own = w[entry]
                    enough = (n_t[other] >= 0.08 * left[own]) & (more[own] | (n_t[other] >= 3))
                    code, k = np.unique(code[enough], return_counts=True)
                    codes.append(code)
                    counts.append(k)
                    held += len(code)
                    if held > 8 * HELD:
                        code, k = _merged(np.concatenate(codes), np.concatenate(counts))
                        codes, counts, held = [code], [k], len(code)
                        if held > 4 * HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(k)], names=["code", "k"])
                            codes, counts, held = [], [], 0
            if codes:
                code, k = _merged(np.concatenate(codes), np.concatenate(counts))
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(k)], names=["code", "k"])

        def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, left, n_t, _, more = state.value  # noqa: B023
            for batch in batches:
                code, k = (batch.column(i).to_numpy() for i in (0, 1))
                w, t = code // width, code % width
                fit = (k * float(n) >= 3.0 * n_t[t] * left[w]) & (k >= 0.08 * left[w]) & ((k >= 3) | more[w])
                w, t, k = w[fit], t[fit], k[fit]
                x = k / left[w] * np.log(k * float(n) / (left[w] * n_t[t].astype(float)))
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(x), pa.array(-t), pa.array(k)], names=["w", "x", "t", "k"])

        sums = coded.mapInArrow(count, "code bigint, k bigint").groupBy("code").agg(F.sum("k").alias("k"))
        best = sums.mapInArrow(worth, "w bigint, x double, t bigint, k bigint").groupBy("w").agg(F.max(F.struct("x", "t", "k")).alias("b")).collect()
        found = np.zeros(len(c), bool)
        for r in best:
            picked[r.w].append(-r.b.t)
            left[r.w] -= r.b.k
            found[r.w] = True
        alive = found & (left > 0.03 * c)
        state.unpersist()
    forget(coded)
    numbers.unpersist()
    return {w: (frozenset(t_words[t] for t in picked[k]), int(left[k])) for k, w in enumerate(s_words) if picked[k]}


def _unpacked(batches: Iterator[pa.RecordBatch], width: int, most: int = 16_384) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, fold) of up to most examples at once; x: (width, examples). Without width, each row is one example."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column, y, fold = batch.column(0), *(batch.column(k).to_numpy() for k in (1, 2))
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + batch.num_rows + 1] // 2
        flat = np.frombuffer(column.buffers()[2], np.uint16)[at[0] : at[-1]]
        n = np.diff(at)
        x = flat.reshape(-1, width or n[0])
        y, fold = (np.repeat(v, n // x.shape[1]) for v in (y, fold))
        for a in range(0, len(x), most):
            yield np.ascontiguousarray(x[a : a + most].T).astype(np.int64), y[a : a + most], fold[a : a + most]


def regression(examples: DataFrame, buckets: int, folds: int, width: int = 0) -> np.ndarray:
    """(folds + 1, buckets) weights of a logistic regression with a weak prior: without the examples of each fold, and of all.

    examples: (x binary, y int, fold int), x the 16-bit feature numbers, as many in each; with width, of examples of one
    y and fold one after the other, of so many feature numbers each.
    """

    examples = examples.coalesce(2 * examples.sparkSession.sparkContext.defaultParallelism)

    def loss(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = examples.sparkSession.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            total, grad, there = np.zeros(len(w)), np.zeros(w.shape), False
            for x, y, fold in _unpacked(batches, width):
                there = True
                for k in range(len(w)):
                    z = np.zeros(len(y))
                    for numbers in x:
                        z += w[k].take(numbers)
                    own, small = fold != k, np.exp(-np.abs(z))  # no example is of the last fold
                    total[k] += ((np.maximum(np.where(y == 1, -z, z), 0) + np.log1p(small)) * own).sum()
                    off = (np.where(z >= 0, 1, small) / (1 + small) - y) * own
                    for numbers in x:
                        grad[k] += np.bincount(numbers, off, buckets)
            if there:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([grad.tobytes()])], names=["loss", "grad"])

        total, grad = 0.5 * PRIOR * (w * w).sum(axis=1), PRIOR * w
        for r in examples.mapInArrow(run, "loss binary, grad binary").collect():
            total += np.frombuffer(r.loss)
            grad += np.frombuffer(r.grad).reshape(w.shape)
        shared.unpersist()
        return total, grad

    w = np.zeros((folds + 1, buckets))
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    length = np.ones(len(w))
    for step in range(STEPS):
        d, used = grad.copy(), []
        for s, y in reversed(past):
            curve = np.maximum((s * y).sum(axis=1), 1e-12)
            a = (s * d).sum(axis=1) / curve
            d -= a[:, None] * y
            used.append((s, y, curve, a))
        if past:
            s, y = past[-1]
            d *= (np.maximum((s * y).sum(axis=1), 1e-12) / np.maximum((y * y).sum(axis=1), 1e-12))[:, None]
        else:
            d /= np.maximum(1.0, np.abs(d).sum(axis=1))[:, None]
        for s, y, curve, a in reversed(used):
            d += (a - (y * d).sum(axis=1) / curve)[:, None] * s
        length[:] = 1.0
        slope = (grad * d).sum(axis=1)
        for _ in range(12):  # each model halves its own step until its loss falls
            new = w - length[:, None] * d
            new_value, new_grad = loss(new)
            bad = new_value > value - 1e-4 * length * slope
            if not bad.any():
                break
            length[bad] *= 0.5
        length[bad] = 0.0
        new = np.where(bad[:, None], w, new)
        new_grad, new_value = np.where(bad[:, None], grad, new_grad), np.where(bad, value, new_value)
        gain = value - new_value
        past = [*past, (new - w, new_grad - grad)][-MEMORY:]
        w, value, grad = new, new_value, new_grad
        if (gain <= 3e-4 * np.maximum(1.0, value)).all():
            break
    return w


def held_out(examples: DataFrame, w: np.ndarray, at: np.ndarray, width: int = 0) -> np.ndarray:
    """(2, len(at) + 1): by label, how many examples score less than at[0], up to at[1] and so on, by their fold's weights;
    examples and width as in regression."""
    shared = examples.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, len(at) + 1), np.int64)
        for x, y, fold in _unpacked(batches, width):
            place = np.searchsorted(at, sum(shared.value[fold, numbers] for numbers in x), "right")
            out += np.bincount(y.astype(np.int64) * out.shape[1] + place, minlength=out.size).reshape(out.shape)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["n"])

    return sum((np.frombuffer(r.n, np.int64).reshape(2, -1) for r in examples.mapInArrow(run, "n binary").collect()), np.zeros((2, len(at) + 1), np.int64))
