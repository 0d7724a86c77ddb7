"""Reports over validated chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

GROUPS = ("address_name_lost_", "scene_name_lost_", "missing_name_", "glossary_missing_", "glossary_forbidden_", "english_leak_", "hallucinated_")


def flag_histogram(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, flag, n): flags of chunks, those that carry a name or number by their prefix."""
    flag = F.col("flag")
    group = F.lit(None).cast("string")
    for g in GROUPS:
        group = F.when(F.startswith(flag, F.lit(g)), F.lit(g.rstrip("_"))).otherwise(group)
    e = flagged.select(*keys, F.explode("flags").alias("flag"))
    return e.select(*keys, F.coalesce(group, flag).alias("flag")).groupBy(*keys, "flag").agg(F.count("*").alias("n"))


def chapter_report(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """One row a chapter: chunks, flagged chunks, hard ones, guillemets and straight quotes of the current text, and flags as a map."""
    current = T.strip_markers(F.coalesce(F.nullif("final", F.lit("")), "draft", F.lit("")))
    n = lambda sign: F.length(current) - F.length(F.replace(current, F.lit(sign), F.lit("")))
    base = flagged.groupBy(*keys).agg(
        F.count("*").alias("chunks"),
        F.sum((F.size("flags") > 0).cast("int")).alias("flagged"),
        F.sum(n("«") + n("»")).alias("guillemets"),
        F.sum(n('"')).alias("ascii_quotes"),
    )
    flags = flag_histogram(flagged, keys).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n")))).alias("flag_counts"))
    return base.join(flags, keys, "left")


def flag_rollup(flagged: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by (outer, inner) with subtotals; an extension."""
    return flagged.select(outer, inner, F.explode("flags").alias("flag")).rollup(outer, inner).agg(F.count("*").alias("n"))


def alignment_stats(pairs: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """(keys, n_words, n_matched, shift): source words of three letters or more that the target has, and the difference in words."""
    s = F.array_distinct(F.filter(T.word_tokens(F.coalesce(source, F.lit(""))), lambda w: F.length(w) >= 3))
    t = T.word_tokens(F.coalesce(target, F.lit("")))
    shift = F.size(t) - F.size(T.word_tokens(F.coalesce(source, F.lit(""))))
    return pairs.select(*keys, F.size(s).alias("n_words"), F.size(F.array_intersect(s, t)).alias("n_matched"), shift.alias("shift"))


def running_totals(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and rate of appended statistics rows (keys, done, failed, seconds)."""
    g = stats.groupBy(*keys).agg(F.sum("done").alias("done"), F.sum("failed").alias("failed"), F.sum("seconds").alias("seconds"))
    return g.withColumn("rate", F.col("done") / F.nullif("seconds", F.lit(0)))


def last_rows(log: DataFrame, order: str, most: int = 100) -> DataFrame:
    """The newest rows of a log."""
    return log.orderBy(F.col(order).desc()).limit(most)


def term_counts(blocks: DataFrame, most: int = 20) -> DataFrame:
    """The most frequent words of three letters or more without stopwords; ties by word."""
    w = blocks.select(F.explode(T.ascii_words(F.coalesce("text", F.lit("")), 3)).alias("word")).where(~F.col("word").isin(*L.STOPWORDS))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(most)


def prefix_matches(pairs: DataFrame, keys: list[str], a: str, b: str, most: int = 100) -> DataFrame:
    """(keys, n_compared, n_match): equal characters at equal places of both texts' first characters that aren't white space."""
    bare = lambda c: F.substring(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s", ""), 1, most)
    p = pairs.select(*keys, bare(a).alias("_a"), bare(b).alias("_b"))
    n = F.least(F.length("_a"), F.length("_b"))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + F.when((i <= n) & (F.substring(F.col("_a"), i, F.lit(1)) == F.substring(F.col("_b"), i, F.lit(1))), 1).otherwise(0))
    return p.select(*keys, n.alias("n_compared"), same.alias("n_match"))
