"""Problem 8: mixing sources to target weights.

Method: the tokens of each source are packed into blocks of BLOCK tokens. A source has as many slots, one block a
slot, as its blocks take to give its share of tokens. The output is cut into shards of some SHARD_SLOTS slots; the
sources' slot counts of a shard are a multinomial draw, conditioned on the quotas of the whole so that these are
met exactly. The k-th slot of a source takes block permutation(k mod blocks) of its pass k div blocks, by a
pseudorandom permutation of the source's block numbers (a Feistel network with cycle walking), and slots and blocks
are joined by (source, block number).

A slot whose pass is beyond the source's max_repeats stays empty. A source with empty slots can't reach its share:
that, counted over the filled slots, is what the report calls short. A token is a run without white space, or
whatever the caller's counts column holds, such as the tokens of a public tokenizer (token_counts).

Scale: packing is a running sum over (source, bucket), with buckets by a hash of the id, so that a source of a
third of all rows is spread over many tasks; only one total per bucket goes through the small second sum. Shards
grow in number, not in size; the driver draws for at most GROUPS groups of shards, and the draw of a group's own
shards is made where its slots are. Slots are numbered by a range and never collected; the join moves one row of
some 60 bytes per piece of a document, never a text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..runtime import arrow_rows, shared_table, spread

BLOCK = 512  # tokens in a block
SHARD_SLOTS = 1 << 16  # slots of an output shard, about; 34 million tokens
GROUPS = 1024  # groups of shards for which the driver draws, at most
BUCKET_ROWS = 100_000  # documents in a hash bucket over which a source is packed, about
MAX_SOURCES = 10_000  # of the targets, whose quotas the driver draws


@dataclass
class Mixture:
    """report: one row a source; draws: (shard, slot, source, pass_no, block, doc_id, first_token, last_token)."""

    report: DataFrame
    draws: DataFrame


def space_tokens(text: str) -> F.Column:
    """The number of runs without white space of any kind."""
    spaces = F.regexp_replace(F.col(text), r"[\s\x1c-\x1f\x85\p{Z}]+", " ")
    bare = F.trim(spaces)
    return F.when(F.length(bare) > 0, F.size(F.split(bare, " ")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def token_counts(documents: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """(id, n_tokens) by a public tokenizer whose file is named by path; null texts have none."""

    def run(ids: list, texts: list) -> Iterator[tuple]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        t.encode_special_tokens = True
        for i, e in zip(ids, t.encode_batch([x or "" for x in texts], add_special_tokens=False)):
            yield i, len(e.ids)

    return arrow_rows(spread(documents.select(id_col, text_col)), run, [id_col, text_col], "id bigint, n_tokens bigint")


def _permuted(k: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at k: four Feistel rounds over the next even number of bits, walked until inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = k.astype(np.uint64)
    out = x.copy()
    todo = np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x >> half, x & mask
            for r in range(4):
                f = (right ^ (seed + np.uint64(r * 7919))) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, (left ^ (f >> np.uint64(32))) & mask
            x = (left << half) | right
            landed = todo & (x < n)
            out[landed] = x[landed]
            todo &= ~landed
    return out.astype(np.int64)


@F.pandas_udf(LongType())
def _block_of(k: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(_permuted(k.to_numpy(np.int64), n.to_numpy(np.uint64), seed.to_numpy(np.int64).astype(np.uint64)))


def pack(counted: DataFrame, buckets: int) -> DataFrame:
    """(source, doc_id, n_tokens, at): at is the place of the document's first token among its source's tokens.

    Documents are laid out by a hash of the id. counted has (source, doc_id, n_tokens).
    """
    b = counted.where("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    totals = b.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("total"))
    before = totals.withColumn(
        "before", F.sum("total").over(Window.partitionBy("source").orderBy("bucket")) - F.col("total")
    ).drop("total")
    inner = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    laid = b.withColumn("upto", F.sum("n_tokens").over(inner))
    at = F.col("before") + F.col("upto") - F.col("n_tokens")
    return laid.join(before, ["source", "bucket"]).select("source", "doc_id", "n_tokens", at.alias("at"))


def pieces_of(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, block, doc_id, first_token, last_token, opens): each document cut at block ends; tokens count from 0.

    opens: whether the piece is the first of its block; each block has one that is.
    """
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n_tokens") - 1) / block)
    cut = packed.select("*", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.lit(0), F.col("block") * block - F.col("at"))
    high = F.least(F.col("n_tokens"), (F.col("block") + 1) * block - F.col("at")) - 1
    opens = F.col("at") <= F.col("block") * block
    return cut.select("source", "block", "doc_id", low.alias("first_token"), high.alias("last_token"), opens.alias("opens"))


def _slots_needed(target: float, tokens: int, block: int) -> int:
    """Slots that a source takes to give the target: whole passes of its blocks, then blocks of one more.

    They are more than its blocks in max_repeats passes just if its tokens in as many passes are under the target.
    """
    if not tokens:
        return math.ceil(target / block)
    passes = math.floor(target / tokens)
    return passes * math.ceil(tokens / block) + math.ceil((target - passes * tokens) / block)


def _layout(spark: SparkSession, names: list[str], quotas: list[int], shards: int, seed: int) -> DataFrame:
    """(shard, first_slot, source, first_use, n): the slots of each source in each shard.

    The driver draws for groups of shards, and each group's draw is split among its shards where it is needed.
    """
    slots, groups = sum(quotas), min(shards, GROUPS)
    rng = np.random.default_rng(seed)
    left, done = np.array(quotas, np.int64), np.zeros(len(quotas), np.int64)
    rows = []
    for g in range(groups):
        a, b = shards * g // groups, shards * (g + 1) // groups
        drawn = _draw(rng, left, slots * b // shards - slots * a // shards)
        rows.append((g, a, b, drawn.tolist(), done.tolist()))
        left, done = left - drawn, done + drawn

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                own = np.random.default_rng([seed, r.g])
                here, used = np.array(r.drawn, np.int64), np.array(r.done, np.int64)
                out = []
                for shard in range(r.a, r.b):
                    start = slots * shard // shards
                    drawn = _draw(own, here, slots * (shard + 1) // shards - start)
                    for k in np.flatnonzero(drawn).tolist():
                        out.append((shard, start, names[k], int(used[k]), int(drawn[k])))
                        start += int(drawn[k])
                    here, used = here - drawn, used + drawn
                yield pd.DataFrame(out, columns=["shard", "first_slot", "source", "first_use", "n"])

    plan = spark.createDataFrame(rows, "g bigint, a bigint, b bigint, drawn array<bigint>, done array<bigint>")
    return plan.repartition(min(groups, spark.sparkContext.defaultParallelism)).mapInPandas(split, "shard bigint, first_slot bigint, source string, first_use bigint, n bigint")


def mix(
    documents: DataFrame, id_col: str, text_col: str, source_col: str, targets: DataFrame,
    counts: DataFrame | None = None, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 13,
) -> Mixture:
    """The mixture of as many tokens as all documents have, null sources included, to the targets' shares.

    targets: (source, target_share, max_repeats); its sources are unique and not null. counts: (id, n_tokens) in
    place of space_tokens. Null and empty texts have no tokens; sources without target give none; a target
    without documents is reported as short. An empty documents table gives a report of zeros, none of them short.
    """
    spark = documents.sparkSession
    if counts is None:
        counted = documents.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), F.coalesce(space_tokens(text_col), F.lit(0)).alias("n_tokens"))
    else:
        n = counts.select(F.col("id").alias("doc_id"), "n_tokens")
        counted = documents.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id")).join(n, "doc_id", "left").na.fill(0, ["n_tokens"])
    counted = shared_table(counted, "tokens")
    plan = targets.where("source is not null").select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(plan) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to mix")
    plan = sorted(plan)
    # one row a source that has a target, and one for the rest
    sums = counted.join(F.broadcast(targets.select("source", F.lit(1).alias("known"))), "source", "left")
    sums = sums.groupBy(F.when(F.col("known") == 1, F.col("source")).alias("source")).agg(F.sum("n_tokens").alias("n"))
    held = {r.source: r.n or 0 for r in sums.collect()}
    total = sum(held.values())
    targets_of = [max(0.0, float(r.target_share or 0)) * total for r in plan]
    quotas = [_slots_needed(t, held.get(r.source, 0), block) for t, r in zip(targets_of, plan)]
    shards = max(1, math.ceil(sum(quotas) / shard_slots))
    layout = _layout(spark, [r.source for r in plan], quotas, shards, seed)
    facts = spark.createDataFrame(
        [(r.source, held.get(r.source, 0), math.ceil(held.get(r.source, 0) / block), int(r.max_repeats or 0), float(r.target_share or 0), targets_of[k], quotas[k], k + 1) for k, r in enumerate(plan)],
        "source string, tokens bigint, blocks bigint, max_repeats int, target_share double, target_tokens double, slots bigint, seed bigint",
    )
    # one row a shard and source is exploded into slots, in runs of at most 4,096, spread over the cluster
    runs = layout.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 4096))).alias("run")).repartition(spark.sparkContext.defaultParallelism)
    step = F.explode(F.sequence(F.col("run") * 4096, F.least(F.col("n"), (F.col("run") + 1) * 4096) - 1)).alias("i")
    uses = runs.select("*", step).select("shard", (F.col("first_slot") + F.col("i")).alias("slot"), "source", (F.col("first_use") + F.col("i")).alias("use"))
    slot = uses.join(F.broadcast(facts), "source").where("blocks > 0")
    slot = slot.withColumn("pass_no", F.floor(F.col("use") / F.col("blocks"))).where("pass_no < max_repeats")
    own = (F.col("seed") * 1_000_003 + F.lit(seed)).alias("own")
    slot = slot.select("shard", "slot", "source", "pass_no", _block_of((F.col("use") % F.col("blocks")), "blocks", own).alias("block"))
    buckets = int(min(1 << 20, max(16, counted.count() // BUCKET_ROWS)))
    blocks = pieces_of(pack(counted.join(F.broadcast(facts.select("source")), "source", "left_semi"), buckets), block)
    # (source, block) has at most max_repeats slots and block pieces; the key is as fine as the data, so no source is hot
    met = slot.join(blocks, ["source", "block"])
    draws = met.select("shard", "slot", "source", "pass_no", "block", "doc_id", "first_token", "last_token")
    given = met.groupBy("source").agg(F.sum(F.col("last_token") - F.col("first_token") + 1).alias("drawn"), F.sum(F.col("opens").cast("bigint")).alias("filled"))
    drawn = F.coalesce("drawn", F.lit(0))
    report = facts.join(given, "source", "left").withColumn("empty_slots", F.col("slots") - F.coalesce("filled", F.lit(0))).select(
        "source",
        "tokens",
        "target_share",
        "max_repeats",
        drawn.alias("drawn_tokens"),
        (drawn / F.greatest(F.lit(1), F.sum(drawn).over(Window.partitionBy()))).alias("reached_share"),
        "target_tokens",
        "slots",
        "empty_slots",
        (F.col("empty_slots") > 0).alias("short"),
    )
    return Mixture(report, draws)


def _draw(rng: np.random.Generator, left: np.ndarray, size: int) -> np.ndarray:
    """A multinomial draw of size slots by what is left of the quotas, as one binomial a source, each kept within
    what it and the sources after it have left. So quotas of any size are met exactly."""
    out = np.zeros(len(left), np.int64)
    rest = int(left.sum())
    size = min(size, rest)
    for k, n in enumerate(left.tolist()):
        if not size:
            break
        x = int(rng.binomial(size, n / rest)) if n else 0
        out[k] = x = min(n, size, max(x, size - (rest - n)))
        size, rest = size - x, rest - n
    return out
