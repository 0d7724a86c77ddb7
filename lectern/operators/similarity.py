"""Set, vector and n-gram similarity, as equi-joins on tokens rather than comparisons of all pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import quality as Q
from ..functions import text as T
from ..runtime import arrow_rows, shared_table, spread

BLOCK_MB = 32  # of a block of vectors that is sent to every task
RARITY_BITS = 16  # tokens are counted in so many buckets to order them by rarity; any order gives the same result
BLOCK_ROWS = 128  # rows of a frequent token that are compared with its others at once
SIGN_WORDS = 8  # 64-bit words of a signature; sets of some 60 tokens would agree by chance in two


def shared_tokens(left: DataFrame, left_id: str, right: DataFrame, right_id: str, text_col: str) -> DataFrame:
    """(left_id, right_id, inter, n_left, n_right) of all pairs that share a content token."""
    a = left.select(left_id, F.explode(T.content_tokens(F.col(text_col))).alias("token"))
    b = right.select(right_id, F.explode(T.content_tokens(F.col(text_col))).alias("token"))
    na = left.select(left_id, F.size(T.content_tokens(F.col(text_col))).alias("n_left"))
    nb = right.select(right_id, F.size(T.content_tokens(F.col(text_col))).alias("n_right"))
    pairs = a.join(b, "token").groupBy(left_id, right_id).agg(F.count("*").alias("inter"))
    return pairs.join(na, left_id).join(nb, right_id)


def similar_above(left: DataFrame, left_id: str, right: DataFrame, right_id: str, text_col: str, num: int, den: int) -> DataFrame:
    """(left_id, right_id, inter, union) of all pairs with Jaccard >= num/den of their content tokens; see similar_tokens."""
    tokens = lambda df, i: df.select(F.col(i), T.content_tokens(F.col(text_col)).alias("tokens")).where("size(tokens) > 0")
    return similar_tokens(tokens(left, left_id), left_id, tokens(right, right_id), right_id, num, den)


def similar_tokens(a: DataFrame, left_id: str, b: DataFrame, right_id: str, num: int, den: int) -> DataFrame:
    """(left_id, right_id, inter, union) of all pairs with Jaccard >= num/den; a and b are (id, tokens), not empty, distinct.

    Candidates by prefix_candidates, verified with their tokens.
    """
    cand = shared_table(prefix_candidates(a.select(left_id, "tokens"), b.select(right_id, "tokens"), num, den), "candidates")
    return _verified(cand, left_id, a, right_id, b, num, den)


def _verified(cand: DataFrame, left_id: str, a: DataFrame, right_id: str, b: DataFrame, num: int, den: int) -> DataFrame:
    """(left_id, right_id, inter, union) of the candidates (_l, _r) with Jaccard >= num/den; a and b are (id, tokens)."""
    c = cand.withColumnsRenamed({"_l": left_id, "_r": right_id})
    of = lambda df, i, x: df.select(i, F.col("tokens").alias(x)).join(c.select(i).distinct(), i, "left_semi")
    both = c.join(of(a, left_id, "ta"), left_id).join(of(b, right_id, "tb"), right_id)
    out = both.select(left_id, right_id, F.size(F.array_intersect("ta", "tb")).alias("inter"), F.size(F.array_union("ta", "tb")).alias("union"))
    return out.where(F.col("inter") * den >= F.col("union") * num)


def _hashed(df: DataFrame) -> DataFrame:
    """(id, hashes) of (id, tokens)."""
    return df.select(F.col(df.columns[0]).alias("id"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes")).where(F.col("id").isNotNull() & (F.size("hashes") > 0))


def _rarity(hashes: DataFrame) -> np.ndarray:
    """How many tokens fall to each of 2^RARITY_BITS buckets: a table of fixed size that orders tokens by rarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy().view(np.uint64)
            counts += np.bincount((flat >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    out = np.zeros(1 << RARITY_BITS, np.int64)
    for r in hashes.select("hashes").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def prefix_candidates(a: DataFrame, b: DataFrame | None, num: int, den: int) -> DataFrame:
    """(_l, _r), distinct: pairs of which all with Jaccard >= num/den are among them; a and b are (id, tokens).

    Of one table (b is None) each pair comes once, _l < _r, otherwise _l is of a and _r of b. Prefix filtering: with
    tokens in one order, rarest first, a pair at t = num/den shares one of the first n - ceil(2tn / (1 + t)) + 1 of the
    smaller and the first n - ceil(tn) + 1 of the larger. Rows of these tokens are shuffled once, with the size and a
    signature of SIGN_WORDS words; the pairs of a token are compared where they meet, in the order of their sizes, first by
    their signatures folded to 128 bits, and only those leave whose signatures differ in no more places than the sets may
    differ in tokens.
    """
    sides = [_hashed(x) for x in (a, b) if x is not None]
    kind, one_table = a.schema[0].dataType, b is None
    shared = a.sparkSession.sparkContext.broadcast(_rarity(sides[-1]))
    words = [f"s{w}" for w in range(SIGN_WORDS)]

    def prefixes(side: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rarity = shared.value
            for batch in batches:
                lists = batch.column(1)
                if not len(lists):
                    continue
                n = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy().view(np.uint64)
                record, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
                at, bit = (flat >> np.uint64(6)) % np.uint64(SIGN_WORDS), np.uint64(1) << (flat & np.uint64(63))
                signs = [np.bitwise_xor.reduceat(np.where(at == w, bit, np.uint64(0)), begin).view(np.int64) for w in range(SIGN_WORDS)]
                order = np.lexsort((flat, rarity[(flat >> np.uint64(64 - RARITY_BITS)).astype(np.int64)], record))
                place = np.arange(len(flat)) - np.repeat(begin, n)
                probe, index = n + (-n * num // den) + 1, n + (-2 * n * num // (num + den)) + 1
                keep = np.flatnonzero(place < probe[record])
                r = record[keep]
                info = n[r].astype(np.int64) * 4 + (place[keep] < index[r]) * 2 + side
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[order][keep].view(np.int64)), pa.array(info), batch.column(0).take(pa.array(r)), *(pa.array(x[r]) for x in signs)],
                    names=["token", "info", "id", *words],
                )

        return run

    schema = f"token bigint, info bigint, id {kind.simpleString()}, " + ", ".join(f"{w} bigint" for w in words)
    rows = sides[0].mapInArrow(prefixes(0), schema)
    if b is not None:
        rows = rows.unionByName(sides[1].mapInArrow(prefixes(1), schema))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3 + SIGN_WORDS)]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            if len(held[0]):
                done = np.searchsorted(held[0], held[0][-1])  # the last token may go on in the next batch
                yield from out(*(x[:done] for x in held))
                held = [x[done:] for x in held]
        if held:
            yield from out(*held)

    id_type = pa.from_numpy_dtype(np.int64) if kind.simpleString() == "bigint" else None

    def out(token, info, ids, *signs) -> Iterator[pa.RecordBatch]:
        n, signs = info >> 2, [x.view(np.uint64) for x in signs]  # bits of signed numbers would be those of their absolute values
        for i, j in _near(token, n, (info & 2) > 0, *(np.bitwise_xor.reduce(signs[w::2]) for w in (0, 1)), num, den):
            d = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in signs)
            ok = d * (den + num) <= (den - num) * (n[i] + n[j])
            i, j = i[ok], j[ok]
            if one_table:
                i, j = i[ids[i] != ids[j]], j[ids[i] != ids[j]]
                least = ids[i] < ids[j]
            else:
                i, j = i[(info[i] ^ info[j]) & 1 == 1], j[(info[i] ^ info[j]) & 1 == 1]
                least = info[i] & 1 == 0
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.where(least, ids[i], ids[j]), id_type), pa.array(np.where(least, ids[j], ids[i]), id_type)], names=["_l", "_r"])

    pairs = rows.repartition("token").sortWithinPartitions("token", "info").mapInArrow(meet, f"_l {kind.simpleString()}, _r {kind.simpleString()}")
    return pairs.distinct()


def _near(token: np.ndarray, n: np.ndarray, index: np.ndarray, s0: np.ndarray, s1: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of one token, i an index row, that sizes and signatures allow; rows are sorted by token and size."""

    def allowed(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j])
        ok = (d * (den + num) <= (den - num) * (n[i] + n[j])) & (n[j] * num <= n[i] * den)
        return i[ok], j[ok]

    if not len(token):
        return
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    ends = np.concatenate((first[1:], [len(token)]))
    end = np.repeat(ends, ends - first)
    many = np.repeat(ends - first > 2 * BLOCK_ROWS, ends - first)
    k, at = 1, np.flatnonzero(index & ~many)
    while True:  # of few rows each with the one that comes k places later, for every k
        at = at[at + k < end[at]]
        at = at[n[at + k] * num <= n[at] * den]
        if not len(at):
            break
        yield allowed(at, at + k)
        k += 1
    for a, z in zip(first[ends - first > 2 * BLOCK_ROWS].tolist(), ends[ends - first > 2 * BLOCK_ROWS].tolist()):
        for x in range(a, z, BLOCK_ROWS):
            own = x + np.flatnonzero(index[x : min(z, x + BLOCK_ROWS)])
            if not len(own):
                continue
            last = a + int(np.searchsorted(n[a:z], n[own[-1]] * den // num, "right"))
            most = np.minimum(255, (den - num) * (n[own[-1]] + n[x:last]) // (den + num)).astype(np.uint8)
            d = np.bitwise_count(s0[own, None] ^ s0[x:last])
            d += np.bitwise_count(s1[own, None] ^ s1[x:last])
            i, j = np.nonzero(d <= most)
            i, j = own[i], x + j
            yield allowed(i[i < j], j[i < j])


def prefix_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(_l, _r, inter, union), _l < _r: the pairs of different rows of (id, tokens) with Jaccard >= num/den, each once.

    As prefix_candidates of one table, but rows of a prefix take their whole set along, as 64-bit digests, so that pairs
    are verified where they meet, at the first token that both have. No candidate is written or shuffled: what is
    shuffled grows with the rows, and what is left with the result.
    """
    side = _hashed(sets)
    shared = sets.sparkSession.sparkContext.broadcast(_rarity(side))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            lists = batch.column(1)
            if not len(lists):
                continue
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().view(np.uint64)
            record, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            at, bit = flat & np.uint64(127), np.uint64(1) << (flat & np.uint64(63))
            signs = [np.bitwise_xor.reduceat(np.where(at >> np.uint64(6) == w, bit, np.uint64(0)), begin).view(np.int64) for w in (0, 1)]
            flat = flat[np.lexsort((flat, rarity[(flat >> np.uint64(64 - RARITY_BITS)).astype(np.int64)], record))]
            place = np.arange(len(flat)) - np.repeat(begin, n)
            probe, index = n + (-n * num // den) + 1, n + (-2 * n * num // (num + den)) + 1
            keep = np.flatnonzero(place < probe[record])
            r = record[keep]
            info = n[r].astype(np.int64) * 4 + (place[keep] < index[r]) * 2
            whole = pa.array([flat[a : a + k].tobytes() for a, k in zip(begin.tolist(), n.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[keep].view(np.int64)), pa.array(info), batch.column(0).take(pa.array(r)), *(pa.array(x[r]) for x in signs), whole.take(pa.array(r))],
                names=["token", "info", "id", "s0", "s1", "whole"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            if len(held[0]):
                done = np.searchsorted(held[0], held[0][-1])  # the last token may go on in the next batch
                yield from out(*(x[:done] for x in held))
                held = [x[done:] for x in held]
        if held:
            yield from out(*held)

    def out(token, info, ids, s0, s1, whole) -> Iterator[pa.RecordBatch]:
        n = info >> 2
        for i, j in _near(token, n, (info & 2) > 0, s0.view(np.uint64), s1.view(np.uint64), num, den):
            for at in range(0, len(i), 20_000):
                a, b = i[at : at + 20_000], j[at : at + 20_000]
                inter, first = _common(whole[a], n[a], whole[b], n[b])
                union = n[a] + n[b] - inter
                ok = (inter * den >= union * num) & (first == token[a]) & (ids[a] != ids[b])
                if ok.any():
                    x, y = ids[a[ok]], ids[b[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(inter[ok].astype(np.int32)), pa.array(union[ok].astype(np.int32))], names=["_l", "_r", "inter", "union"])

    rows = side.mapInArrow(prefixes, "token bigint, info bigint, id bigint, s0 bigint, s1 bigint, whole binary")
    return rows.repartition("token").sortWithinPartitions("token", "info").mapInArrow(meet, "_l bigint, _r bigint, inter int, union int")


def _common(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sets as bytes of digests, in one order: the number of common digests, and the first of them, 0 if none."""
    x, y = (np.frombuffer(b"".join(v), np.int64) for v in (a, b))
    pair = np.concatenate((np.repeat(np.arange(len(a)), n_a), np.repeat(np.arange(len(a)), n_b)))
    both = np.concatenate((x, y))
    order = np.lexsort((both, pair))  # stable, so of equal digests that of a comes first
    same = (both[order[1:]] == both[order[:-1]]) & (pair[order[1:]] == pair[order[:-1]])
    at = np.sort(order[:-1][same])
    inter = np.bincount(pair[at], minlength=len(a))
    first = np.zeros(len(a), np.int64)
    first[pair[at[::-1]]] = x[at[::-1]]  # the least place is assigned last
    return inter, first


def similar_classes(df: DataFrame, key: str, text_col: str, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (key, rep) gives each row's class of equal content tokens by its least key; links
    (rep_a, rep_b, inter, union), both ways, are the pairs of different classes with Jaccard >= num/den.

    Rows without tokens are in neither. Copies, however many, are one row of the join.
    """
    t = df.select(F.col(key).alias("key"), F.array_sort(T.content_tokens(F.col(text_col))).alias("tokens")).where("size(tokens) > 0")
    # a class is known by two 64-bit digests
    t = shared_table(t.select("key", "tokens", F.xxhash64("tokens").alias("_1"), F.xxhash64("tokens", F.lit(7)).alias("_2")), "tokens")
    classes = t.groupBy("_1", "_2").agg(F.min("key").alias("rep"))
    members = shared_table(t.select("key", "_1", "_2").join(classes, ["_1", "_2"]).select("key", "rep"), "members")
    sets = t.join(members.where("key <> rep").select("key"), "key", "left_anti").select(F.col("key").alias("rep"), "tokens")
    links = shared_table(prefix_links(sets, num, den).withColumnsRenamed({"_l": "rep_a", "_r": "rep_b"}), "links")
    back = links.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b"), "inter", "union")
    return members.withColumnRenamed("key", key), links.unionByName(back)


def class_examples(members: DataFrame, key: str, links: DataFrame, k: int = L.MEMORY_EXAMPLES) -> DataFrame:
    """(key, other, rank): for each row its k most similar others, by Jaccard, then by key; members and links of similar_classes.

    Of each class only the k + 1 least keys can be among them, so copies aren't expanded into pairs.
    """
    w = Window.partitionBy("rep").orderBy(key)
    # least keys of a class by partial aggregates first, so that a class of many copies is no window
    least = members.groupBy("rep", F.pmod(F.xxhash64(key), F.lit(64)).alias("_salt")).agg(F.slice(F.array_sort(F.collect_set(key)), 1, k + 1).alias("_o"))
    least = least.select("rep", F.explode("_o").alias(key)).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k + 1)
    others = least.select(F.col("rep").alias("rep_b"), F.col(key).alias("other"))
    near = links.select("rep_a", "rep_b", (F.col("inter") / F.col("union")).alias("similarity"))
    own = members.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.lit(1.0).alias("similarity")).distinct()
    best = near.unionByName(own).join(others, "rep_b")
    by_class = Window.partitionBy("rep_a").orderBy(F.col("similarity").desc(), "other")
    best = best.withColumn("_k", F.row_number().over(by_class)).where(F.col("_k") <= k + 1).select("rep_a", "other", "similarity")
    j = members.select(key, F.col("rep").alias("rep_a")).join(best, "rep_a").where(F.col(key) != F.col("other"))
    mine = Window.partitionBy(key).orderBy(F.col("similarity").desc(), "other")
    return j.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k).select(key, "other", "rank")


def memory_similar(records: DataFrame, key: str, memory: DataFrame | None, other: str, threshold: float = L.MEMORY_THRESHOLD) -> DataFrame:
    """(key, other, similarity) of all pairs whose similarity is at least the threshold.

    records, memory: (…, source, draft, register_hint). With Js and Jd the Jaccard of the content tokens of the
    normalised sources and drafts, it is max(Js, 0.65 Js + 0.35 Jd), with 0.05 more for the same register, 1 at most. As
    the first part is a weighted mean or Js, one of Js and Jd is at least the threshold less the bonus: pairs come
    from the prefixes of both and are then computed in full. Without memory, records are compared with each other, each
    pair once, and come both ways; a record isn't paired with itself.
    """
    least = round((threshold - 0.05) * 100)
    tokens = lambda c: T.content_tokens(T.memory_text(F.coalesce(F.col(c), F.lit(""))))
    # normalisation may be Python's, so each text is normalised once
    tables = [shared_table(spread(df).select(F.col(i).alias("id"), tokens("source").alias("source"), tokens("draft").alias("draft"), "register_hint"), "memory-tokens") for df, i in ((records, key), (memory, other)) if df is not None]
    sets = lambda t, c: t.select("id", F.col(c).alias("tokens"))
    near = [prefix_candidates(sets(tables[0], c), sets(tables[1], c) if len(tables) > 1 else None, least, 100) for c in ("source", "draft")]
    cand = shared_table(near[0].unionByName(near[1]).distinct(), "candidates").withColumnsRenamed({"_l": key, "_r": other})
    named = lambda df, i, x: df.select(F.col("id").alias(i), F.col("source").alias(f"_s{x}"), F.col("draft").alias(f"_d{x}"), F.col("register_hint").alias(f"_r{x}")).join(cand.select(i).distinct(), i, "left_semi")
    both = cand.join(named(tables[0], key, "a"), key).join(named(tables[-1], other, "b"), other)
    js, jd = T.jaccard(F.col("_sa"), F.col("_sb")), T.jaccard(F.col("_da"), F.col("_db"))
    bonus = F.when((F.col("_ra") != "") & (F.col("_ra") == F.col("_rb")), 0.05).otherwise(0.0)
    s = F.least(F.lit(1.0), F.greatest(js, F.lit(0.65) * js + F.lit(0.35) * jd) + bonus)
    out = both.select(key, other, s.alias("similarity")).where(F.col("similarity") >= threshold)
    if memory is not None:
        return out
    out = shared_table(out, "similar")
    return out.unionByName(out.select(F.col(other).alias(key), F.col(key).alias(other), "similarity"))


def top_examples(pairs: DataFrame, key: str, other: str, similarity: Column, k: int = L.MEMORY_EXAMPLES) -> DataFrame:
    """pairs with similarity and rank of the k best of each key; ties by other."""
    w = Window.partitionBy(key).orderBy(F.col("similarity").desc(), other)
    return pairs.withColumn("similarity", similarity).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def latest_exact(records: DataFrame, key: str, memory: DataFrame, seq: str, flags: Column | None = None) -> DataFrame:
    """(key, entry columns): the newest entry of memory with the record's normalised source, a near enough draft and
    a final without flags.

    records, memory: (…, source, draft). Drafts agree if either is empty or their Jaccard is 0.85 or more. flags: those
    of candidate against a record's columns; all checks of source and draft by default.
    """
    a = records.select(key, T.memory_text(F.coalesce("source", F.lit(""))).alias("_norm"), T.content_tokens(T.memory_text(F.coalesce("draft", F.lit("")))).alias("_da"), T.memory_text(F.coalesce("draft", F.lit(""))).alias("_d"))
    m = memory.where("source <> '' and final <> ''").select(
        F.col(seq).alias("_seq"), T.strip(F.col("final")).alias("candidate"),
        T.memory_text(F.col("source")).alias("_norm"), T.content_tokens(T.memory_text(F.coalesce("draft", F.lit("")))).alias("_db"), T.memory_text(F.coalesce("draft", F.lit(""))).alias("_e"),
    ).where("candidate <> ''")
    inter, union = F.size(F.array_intersect("_da", "_db")), F.size(F.array_union("_da", "_db"))
    near = (F.col("_d") == "") | (F.col("_e") == "") | ((inter > 0) & (inter * 100 >= union * int(L.MEMORY_DRAFT * 100)))
    # copies of one source are one row by (source, draft, final) on the memory's side before they meet the records
    m = m.groupBy("_norm", "_e", "candidate").agg(F.max_by(F.struct("_seq", "_db"), "_seq").alias("_m")).select("_norm", "_e", "candidate", "_m.*")
    found = a.join(m, "_norm").where(near).select(key, "_seq", "candidate")
    flags = Q.all_flags(F.col("source"), F.col("draft"), F.col("candidate")) if flags is None else flags
    j = found.join(records, key).where(F.size(flags) == 0)
    return j.groupBy(key).agg(F.max_by(F.struct(F.col("_seq").alias("entry"), "candidate"), "_seq").alias("x")).select(key, "x.*")


def knn(queries: DataFrame, query_id: str, base: DataFrame, base_id: str, vec: str, k: int, threshold: float = -1.0) -> DataFrame:
    """(query_id, base_id, similarity, rank): the k nearest base rows of every query by inner product of normalised vectors.

    Exact: all base rows are scanned once per block of queries (a stated query set in blocks of BLOCK_MB, whose
    size is checked), each task keeps its own k best, and only those are shuffled. Ties by base_id.
    """
    q = queries.select(query_id, vec).where(F.col(vec).isNotNull())
    dim = q.select(F.max(F.size(vec)).alias("d"), F.count("*").alias("n")).first()
    if not dim or not dim.n:
        return queries.sparkSession.createDataFrame([], f"{query_id} bigint, {base_id} bigint, similarity double, rank int")
    per_block = max(1, BLOCK_MB * 1_000_000 // (8 * dim.d))
    n_blocks = -(-dim.n // per_block)
    numbered = q.withColumn("_block", F.pmod(F.xxhash64(query_id), F.lit(n_blocks)))
    parts = []
    for b in range(n_blocks):
        rows = numbered.where(F.col("_block") == b).select(query_id, vec).collect()
        if rows:
            parts.append(_scan(queries.sparkSession, rows, base, query_id, base_id, vec, k, threshold))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy(query_id).orderBy(F.round("similarity", 4).desc(), base_id)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _scan(spark, rows, base: DataFrame, query_id: str, base_id: str, vec: str, k: int, threshold: float) -> DataFrame:
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    shared = spark.sparkContext.broadcast((ids, _unit(np.array([r[1] for r in rows], dtype=np.float64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        top_v = np.full((len(qid), k), -np.inf)
        top_i = np.full((len(qid), k), -1, dtype=np.int64)
        for batch in batches:
            keep = [i for i, v in enumerate(batch.column(1).to_pylist()) if v is not None and len(v) == q.shape[1]]
            if not keep:
                continue
            part = batch.take(pa.array(keep))
            b = np.asarray(part.column(0).to_pylist(), dtype=np.int64)
            m = _unit(np.asarray(part.column(1).to_pylist(), dtype=np.float64))
            for a in range(0, len(b), 512):
                s = np.round(q @ m[a : a + 512].T, 4)
                v = np.hstack([top_v, s])
                i = np.hstack([top_i, np.broadcast_to(b[a : a + 512], s.shape)])
                order = np.lexsort((i, -v), axis=1)[:, :k]
                top_v, top_i = np.take_along_axis(v, order, 1), np.take_along_axis(i, order, 1)
        r, c = np.nonzero((top_i >= 0) & (top_v >= threshold))
        yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(top_i[r, c]), pa.array(top_v[r, c])], names=[query_id, base_id, "similarity"])

    return base.select(base_id, vec).mapInArrow(run, f"{query_id} bigint, {base_id} bigint, similarity double")


def ngram_overlap(pairs: DataFrame, keys: list[str], candidate: str, reference: str, orders: int = 6) -> DataFrame:
    """(keys, width, overlap, n_cand, n_ref): clipped overlap of character n-grams of each pair and width.

    Texts are lower-cased with runs of white space as one space; a text shorter than the width is one gram. Pairs
    with an empty or null side have no row. Grams are counted within the row of their pair, in Arrow batches:
    exploding them would shuffle some thousand rows a pair for six numbers.
    """
    norm = lambda c: T.squeeze(F.lower(F.coalesce(c, F.lit(""))))
    p = pairs.select(*keys, norm(candidate).alias("_c"), norm(reference).alias("_r")).where("_c <> '' and _r <> ''")
    fields = {f.name: f.dataType.simpleString() for f in p.schema}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", width int, overlap bigint, n_cand bigint, n_ref bigint"

    def grams(t: str, w: int) -> Counter[str]:
        return Counter(t[k : k + w] for k in range(len(t) - w + 1)) if len(t) >= w else Counter((t,))

    def run(*columns: list) -> Iterator[tuple]:
        for *key, c, r in zip(*columns):
            for w in range(1, orders + 1):
                a, b = grams(c, w), grams(r, w)
                yield *key, w, sum(min(n, b[g]) for g, n in a.items() if g in b), a.total(), b.total()

    return arrow_rows(spread(p), run, [*keys, "_c", "_r"], schema)


def chrf(overlaps: DataFrame, keys: list[str], beta: float = 2.0) -> DataFrame:
    """(keys, chrf): mean of the F-beta over the widths, times 100."""
    p, r = F.col("overlap") / F.greatest(F.lit(1), F.col("n_cand")), F.col("overlap") / F.greatest(F.lit(1), F.col("n_ref"))
    f = F.when(p + r == 0, 0.0).otherwise((1 + beta**2) * p * r / (beta**2 * p + r))
    return overlaps.withColumn("_f", f).groupBy(*keys).agg((F.avg("_f") * 100).alias("chrf"))
