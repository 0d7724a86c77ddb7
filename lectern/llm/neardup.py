"""Problem 5: near-duplicate records with small edits.

Method: HyperMinHash. One hash a word is split: some bits choose one of BUCKETS buckets, and each bucket holds, of the
least hash that falls to it, the count of leading zeros and some mantissa bits, compressed to 16 bits. A bucket
that no word falls to takes the register of another, by a fixed sequence of tries (optimal densification), so
that equal registers still come with the probability of the Jaccard similarity. Bands of BAND_ROWS compressed
registers are the LSH keys; candidates pass a Jaccard estimate corrected for accidental register collisions, then
exact verification. In simulations with 8 registers a band and 60 bands, a pair at 0.75 is found with probability
0.99, at 0.8 with 0.999.

Scale: records are first reduced to classes of equal word sets, so exact repeats, however many, are one row of the
similarity join. Band keys are shuffled once, as 64-bit digests without texts, and read as a sorted stream. A key of more than CROWD
records, such as those of a common template, is not expanded: its records go through an exact join on their rarest
words instead (crowded_candidates), whose rows don't grow with the square of the key's records. A candidate first meets one bit of each of 128 registers, then the registers
themselves, then, once, the digests of its words. Membership brings records back in, so a class of a third of all
rows costs one row of the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shared_table, spread
from .textform import WORD, digests

THRESHOLD = 0.75
BAND_ROWS, BANDS = 8, 60
BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10  # with 6 bits for the count of leading zeros
KEPT = 128  # registers that go along to verification; the bands are keyed before
CROWD = 200  # records of a band key that are paired with each other
RARITY_BITS = 16  # words are counted in so many buckets to order them by rarity; any order gives the same result
_EMPTY = np.uint16(0xFFFF)  # no register: 63 leading zeros and a full mantissa don't come with the hash's 56 bits


@lru_cache(maxsize=8)
def _tries(n: int) -> np.ndarray:
    """For each bucket, the buckets that it takes a register from, in order of trying."""
    return np.random.default_rng(20240229).integers(0, BUCKETS, (n, BUCKETS))


@lru_cache(maxsize=8)
def _bands(band_rows: int, bands: int) -> np.ndarray:
    """The registers of each band."""
    rng = np.random.default_rng(20240301)
    return np.array([rng.choice(BUCKETS, band_rows, replace=False) for _ in range(bands)])


def registers(hashes: np.ndarray, record: np.ndarray, n: int) -> np.ndarray:
    """(n, BUCKETS) compressed registers of n records; hashes are word digests and record the number of each one's record."""
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    low = np.full(n * BUCKETS, ~np.uint64(0))
    np.minimum.at(low, record * BUCKETS + bucket, hashes << np.uint64(BUCKET_BITS))
    there = low != ~np.uint64(0)
    out = np.full(n * BUCKETS, _EMPTY)
    top = np.maximum(low[there], np.uint64(1))
    # leading zeros of a 64-bit number: its exponent as a double, after the low bits that could round it up are cut
    exponent = np.frexp((top >> np.uint64(11)).astype(np.float64))[1] + 11
    zeros = np.minimum(64 - exponent, 63).astype(np.uint64)
    shifted = (top << zeros) << np.uint64(1)  # drops the leading one
    out[there] = ((zeros << np.uint64(MANTISSA_BITS)) | (shifted >> np.uint64(64 - MANTISSA_BITS))).astype(np.uint16)
    todo = np.flatnonzero(~there)
    base, column = todo // BUCKETS * BUCKETS, todo % BUCKETS
    for row in _tries(8 * BUCKETS):
        if not len(todo):
            break
        look = base + row[column]
        found = there[look]
        out[todo[found]] = out[look[found]]
        todo, base, column = todo[~found], base[~found], column[~found]
    for at in todo.tolist():  # after all tries, the next full bucket; a record without words has none
        own = np.flatnonzero(there[at // BUCKETS * BUCKETS : (at // BUCKETS + 1) * BUCKETS])
        if len(own):
            out[at] = out[at // BUCKETS * BUCKETS + own[np.searchsorted(own, at % BUCKETS) % len(own)]]
    return out.reshape(n, BUCKETS)


def band_keys(r: np.ndarray, band_rows: int = BAND_ROWS, bands: int = BANDS) -> np.ndarray:
    """(records, bands) 64-bit digests of each band's number and registers."""
    part = r[:, _bands(band_rows, bands)].astype(np.uint64)
    h = np.broadcast_to(np.random.default_rng(5).integers(1, 2**63, bands, dtype=np.uint64), part.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(band_rows):
            h = (h ^ part[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _last_bits(r: np.ndarray) -> np.ndarray:
    """(2, records): the last bits of the first 128 registers."""
    bits = (r[:, :128] & 1).astype(np.uint64).reshape(len(r), 2, 64) << np.arange(64, dtype=np.uint64)
    return np.bitwise_or.reduce(bits, axis=2).T.view(np.int64)


def accidental(size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Probability that the registers of two disjoint sets of these sizes are equal.

    Both minima must have the same leading zeros z and the same mantissa: summed over z, with the density of
    the minimum of the n uniform numbers of a bucket, n exp(-n x), taken at the middle of each cell of width 2^-(z+1+bits).
    """
    m = 1 << MANTISSA_BITS
    size_a, size_b = (np.maximum(1.0, s / BUCKETS) for s in (size_a, size_b))
    total = np.zeros(np.broadcast(size_a, size_b).shape)
    for z in range(0, 24):
        width = 2.0 ** -(z + 1) / m
        mid = 2.0 ** -(z + 1) * 1.5
        total += m * (size_a * width * np.exp(-size_a * mid)) * (size_b * width * np.exp(-size_b * mid))
    return total


def estimate(equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the share of equal registers, less the expected accidental collisions."""
    by_chance = accidental(size_a.astype(float), size_b.astype(float))
    return np.clip((equal - by_chance) / (1 - by_chance), 0, 1)


def sketches(df: DataFrame, id_col: str, text_cols: list[str], band_rows: int = BAND_ROWS, bands: int = BANDS) -> DataFrame:
    """(id, size, words, sketch, bits, more_bits, keys): sorted word digests, the first registers as bytes, the last bit
    of each of these, and band keys of each record.

    The words of all text columns are taken together; null texts have none. Records without words are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                cols = [part.column(i).to_pylist() for i in range(part.num_columns)]
                ids, sets = [], []
                for i, *texts in zip(*cols):
                    found = {w for t in texts if t for w in WORD.findall(t.lower())}
                    if found and i is not None:
                        ids.append(i)
                        sets.append(np.sort(digests(found, cache)))
                sizes = np.array([len(x) for x in sets], np.int32)
                flat = np.concatenate([np.empty(0, np.uint64), *sets])
                r = registers(flat, np.repeat(np.arange(len(ids)), sizes), len(ids))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands), pa.array(band_keys(r, band_rows, bands).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() for x in r[:, :KEPT]], pa.binary()), *map(pa.array, _last_bits(r)), keys],
                    names=["id", "size", "words", "sketch", "bits", "more_bits", "keys"],
                )

    return spread(df.select(id_col, *text_cols)).mapInArrow(
        run, "id bigint, size int, words binary, sketch binary, bits bigint, more_bits bigint, keys array<bigint>"
    )


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many records hold a word of each of 2^RARITY_BITS buckets of digests: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            counts += np.bincount((flat >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    out = np.zeros(1 << RARITY_BITS, np.int64)
    for r in sets.select("words").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def crowded_candidates(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rep_a, rep_b), rep_a < rep_b: pairs of which all at or over the threshold are among them; sets is (id, size, words).

    An exact join on prefixes. With each record's words in one order, rarest first, two records with at least t of
    the words of either in both share a word among the first n - ceil(2tn / (1 + t)) + 1 of the smaller and the first
    n - ceil(tn) + 1 of the larger; the first word they share leaves enough words after it in both.
    """
    counts = _rarity(sets)
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    t = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            for i, n, w in zip(*(batch.column(k).to_pylist() for k in range(3))):
                x = np.frombuffer(w, np.uint64)
                x = x[np.lexsort((x, rarity[(x >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]))]
                most = n - math.ceil(t * n - 1e-9) + 1
                least = n - math.ceil(2 * t / (1 + t) * n - 1e-9) + 1
                for c, v in zip(cols, (x[:most].view(np.int64), np.full(most, i), np.full(most, n), np.arange(most), np.arange(most) < least)):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["word", "id", "n", "at", "index"])

    rows = sets.select("id", "size", "words").mapInArrow(run, "word bigint, id bigint, n bigint, at bigint, index boolean")
    side = lambda x: rows.select("word", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "at", "index")))
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    enough = (1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - 1) >= t / (1 + t) * (F.col("n_a") + F.col("n_b")) - 1e-9
    met = side("a").where("index_a").join(side("b"), "word").where(ordered & (F.col("n_a") >= t * F.col("n_b") - 1e-9) & enough)
    return met.select(F.least("id_a", "id_b").alias("rep_a"), F.greatest("id_a", "id_b").alias("rep_b"))


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of representatives whose words agree at the threshold; the estimate from the kept registers is a first,
    generous sieve, five standard errors wide."""
    slack = 5 * (threshold * (1 - threshold) / min(KEPT, 48)) ** 0.5  # of so many registers at least that aren't copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            a, b = (np.frombuffer(b"".join(col[x].to_pylist()), dtype=np.uint16).reshape(-1, KEPT) for x in ("sketch_a", "sketch_b"))
            na, nb = (col[x].to_numpy(zero_copy_only=False) for x in ("size_a", "size_b"))
            near = np.flatnonzero(estimate((a == b).mean(axis=1), na, nb) >= threshold - slack)
            wa, wb = col["words_a"], col["words_b"]
            keep, values = [], []
            for i in near.tolist():
                x = np.frombuffer(wa[i].as_py(), dtype=np.uint64)
                y = np.frombuffer(wb[i].as_py(), dtype=np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                j = both / (len(x) + len(y) - both)
                if j >= threshold:
                    keep.append(i)
                    values.append(j)
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [col["rep_a"].take(pa.array(keep)), col["rep_b"].take(pa.array(keep)), pa.array(values, pa.float64())],
                    names=["rep_a", "rep_b", "jaccard"],
                )

    return pairs.mapInArrow(run, "rep_a bigint, rep_b bigint, jaccard double")


def _in_keys(keys: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(rep_a, rep_b), rep_a < rep_b, of all records of a key, repeats included; keys is (key, id). Of a key of more than
    crowd rows, its records with a null instead."""

    def alone(ids: np.ndarray) -> pa.RecordBatch:
        ids = np.unique(ids)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64())], names=["rep_a", "rep_b"])

    def pairs(key: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of runs of equal keys: each record with the one that comes k places later, for every k."""
        if not len(key):
            return
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(first, len(key)))
        many = np.repeat(n > crowd, n)
        if many.any():
            yield alone(ids[many])
            key, ids = key[~many], ids[~many]
        k = 1
        at = np.flatnonzero(key[1:] == key[:-1])
        while len(at):
            a, b = ids[at], ids[at + k]
            new = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["rep_a", "rep_b"])
            k += 1
            at = at[at + k < len(key)]
            at = at[key[at + k] == key[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, open_key = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            key, ids = (np.concatenate((x, batch.column(i).to_numpy())) for i, x in enumerate((key, ids)))
            if open_key is not None:  # a crowded key's further records aren't held
                done = np.searchsorted(key, open_key, "right")
                yield alone(ids[:done])
                key, ids = key[done:], ids[done:]
            if len(key):
                done = np.searchsorted(key, key[-1])  # the last key may go on in the next batch
                yield from pairs(key[:done], ids[:done])
                key, ids, open_key = key[done:], ids[done:], None
                if len(key) > crowd:
                    yield alone(ids)
                    key, ids, open_key = key[:0], ids[:0], key[0]
        yield from pairs(key, ids)

    return keys.select("key", "id").repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "rep_a bigint, rep_b bigint")


def near_duplicates(
    df: DataFrame, id_col: str, text_cols: list[str], threshold: float = THRESHOLD, band_rows: int = BAND_ROWS, bands: int = BANDS, crowd: int = CROWD
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, rep) gives each record's class of equal word sets by its least id; links
    (rep_a, rep_b, jaccard), rep_a < rep_b, are the pairs of classes at or over the threshold.

    Nulls and empty texts have no words; a record without words is in neither table. A row that comes twice is
    twice in members, and an id is never paired with itself.
    """
    all_rows = shared_table(sketches(df, id_col, text_cols, band_rows, bands), "sketches")
    # equal words, equal digests: a class is known by two 64-bit digests and the size
    by_set = [F.xxhash64("words"), F.xxhash64("words", F.lit(7)), F.col("size")]
    slim = all_rows.select("id", by_set[0].alias("w1"), by_set[1].alias("w2"), "size")
    reps = slim.groupBy("w1", "w2", "size").agg(F.min("id").alias("rep"))
    members = shared_table(slim.join(reps, ["w1", "w2", "size"]).select("id", "rep"), "members")
    rep_rows = all_rows.join(members.where("id <> rep").select("id"), "id", "left_anti")
    met = shared_table(_in_keys(rep_rows.select("id", F.explode("keys").alias("key")), crowd).distinct(), "met")
    crowded, candidates = met.where("rep_b is null").select(F.col("rep_a").alias("id")), met.where("rep_b is not null")
    if crowded.head(1):
        sets = shared_table(rep_rows.select("id", "size", "words").join(crowded, "id", "left_semi").dropDuplicates(["id"]), "crowded")
        candidates = candidates.unionByName(crowded_candidates(sets, threshold)).distinct()
    # a bit of each register: half of the accidental ones agree; four standard errors of 128 bits below the threshold
    apart = int(128 * (1 - (1 + threshold) / 2 + 4 * ((1 - threshold**2) / 4 / 64) ** 0.5))
    signs = rep_rows.select("id", "size", "bits", "more_bits")
    side = lambda df, x: df.select(*(F.col(c).alias(f"{'rep' if c == 'id' else c}_{x}") for c in df.columns))
    differ = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) + F.bit_count(F.col("more_bits_a").bitwiseXOR(F.col("more_bits_b")))
    near = candidates.join(side(signs, "a"), "rep_a").join(side(signs, "b"), "rep_b")
    near = near.where((differ <= apart) & (F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9)).select("rep_a", "rep_b")
    near = shared_table(near, "candidates")
    ends = near.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
    data = rep_rows.select("id", "size", "words", "sketch").join(ends, "id", "left_semi")
    pairs = near.join(side(data, "a"), "rep_a").join(side(data, "b"), "rep_b")
    links = shared_table(_verify(pairs, threshold).distinct(), "links")  # a record's row that came twice made its pairs twice
    return members, links


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(entry_a, entry_b), entry_a < entry_b: all pairs of records, exact repeats included, from the classes."""
    m = members
    a, b = m.select(F.col("id").alias("x"), F.col("rep").alias("rep_a")), m.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    across = links.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select("x", "y")
    within = a.join(b, F.col("rep_a") == F.col("rep_b")).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("entry_a"), F.greatest("x", "y").alias("entry_b"))


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, n_copies, n_links): one row a record; n_links counts near-duplicate classes, not copies."""
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    copies = members.groupBy("rep").agg(F.count("*").alias("n_copies"))
    by_class = copies.join(ends, "rep", "left").na.fill(0, ["n_links"])
    return members.join(by_class, "rep").select("id", F.col("rep").alias("class_id"), "n_copies", "n_links")
