"""Choosing among candidates: a long table of candidates, hard flags first, then the score, then the order given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import text as T


def candidates(chunks: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """(keys, source, draft, more, ord, name, text): the current text, the draft and the alternatives by model name.

    Order: current 0, draft 1, alternatives from 2 by name. Null and empty texts aren't candidates.
    """
    current = F.coalesce(F.nullif("final", F.lit("")), "draft")
    alts = F.transform(F.array_sort(F.map_keys(F.coalesce("alt_drafts", F.create_map().cast("map<string,string>")))), lambda k, i: F.struct((i + 2).alias("ord"), k.alias("name"), F.element_at("alt_drafts", k).alias("text")))
    pool = F.concat(
        F.array(
            F.struct(F.lit(0).alias("ord"), F.lit("current").alias("name"), current.alias("text")),
            F.struct(F.lit(1).alias("ord"), F.lit("draft").alias("name"), F.col("draft").alias("text")),
        ),
        alts,
    )
    return chunks.select(*keys, "source", "draft", *more, F.explode(pool).alias("c")).select(*keys, "source", "draft", *more, "c.*").where("text <> ''")


def scored(cands: DataFrame, names: Column | None = None, full: bool = True, glossary: Column | None = None, w: Column | None = None) -> DataFrame:
    """cands with flags, hard and score10; names, glossary and w as in all_flags."""
    flags = Q.all_flags(F.col("source"), F.col("draft"), F.col("text"), names, glossary, w) if full else Q.base_flags(F.col("source"), F.col("draft"), F.col("text"), names)
    c = cands.withColumn("flags", flags)
    return c.withColumn("hard", Q.hard_flags(F.col("flags"))).withColumn("score10", Q.score10(F.col("source"), F.col("text"), F.col("flags")))


def best(cands: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key by the order; a partial minimum, so a hot key never meets in one task whole."""
    rest = [c for c in cands.columns if c not in keys]
    rank = F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)))
    b = cands.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return b.select(*keys, "_row.*")


def rerank(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Fewest hard flags, then the best score; the first of equals."""
    return best(cands, keys, [F.col("hard"), -F.col("score10"), F.col("ord")])


def choose_estimated(cands: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The highest value; the first of equals."""
    return best(cands, keys, [-F.col(value), F.col("ord")])


def best_hypothesis(cands: DataFrame, keys: list[str], names: Column) -> DataFrame:
    """Candidates that keep all names of the source first, then the best score, then the order."""
    want, have = T.words(F.coalesce("source", F.lit(""))), T.words(F.col("text"))
    complete = F.forall(names, lambda n: ~F.array_contains(want, n) | F.array_contains(have, n))
    return best(cands.withColumn("complete", complete), keys, [(~F.col("complete")).cast("int"), -F.col("score10"), F.col("ord")])


def accept(cands: DataFrame, keys: list[str], base_ord: int = 1, strict: bool = True) -> DataFrame:
    """cands with accepted: whether each may replace the candidate of base_ord."""
    base = cands.where(F.col("ord") == base_ord).select(*keys, F.col("hard").alias("_hard"), F.col("score10").alias("_score"))
    ok = Q.accepted(F.col("_hard"), F.col("_score"), F.col("hard"), F.col("score10"), strict)
    return cands.join(base, keys).withColumn("accepted", ok).drop("_hard", "_score")
