"""The queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import alignment, answers, leakage, mixing, mojibake, neardup, pieces, skeletons

Query = Callable[[SparkSession, str], DataFrame]


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks", "chunk_id", "source", "draft", "final", "model", "patcher")


def _both(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.select(F.lit(t).alias("tbl"), "*") for t, df in parts))


# --- 1, 2: answers -------------------------------------------------------------------------------------------


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defects(_chunks(spark, d))


def p1_defect_counts(spark: SparkSession, d: str) -> DataFrame:
    """Faulty answers by field and kind."""
    return answers.defects(_chunks(spark, d)).groupBy("field", "defect").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.cut_texts(_chunks(spark, d))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """The log-odds of every draft and final that it was cut."""
    return answers.cut_scores(_chunks(spark, d))


def p2_cut_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of each model's drafts and each patcher's finals that were cut."""
    return answers.truncation_report(_chunks(spark, d))


# --- 3: look-alikes ------------------------------------------------------------------------------------------

_LOOK = (("units", "unit_id", "text"), ("chunks", "chunk_id", "final"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _both([(t, skeletons.look_alike_pairs(table(spark, d, t, i, x), i, x)) for t, i, x in _LOOK])


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its group of texts that read the same."""
    return _both([(t, skeletons.look_alike_groups(table(spark, d, t, i, x), i, x)) for t, i, x in _LOOK])


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every text of both tables in its one form."""
    return _both([(t, skeletons.canonical(table(spark, d, t, i, x), i, x)) for t, i, x in _LOOK])


# --- 4: splitting ----------------------------------------------------------------------------------------------

_LONG = (("units", "unit_id", "text"), ("chunks", "chunk_id", "source"), ("sections", "section_id", "source"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized text."""
    return _both([(t, pieces.split_oversized(table(spark, d, t, i, x), i, x)) for t, i, x in _LONG])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).where("piece_no = 1").select("tbl", "row_id", "boundary")


# --- 5: near-duplicates ------------------------------------------------------------------------------------------


def _memory(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    memory = table(spark, d, "correction_memory", "entry_id", "source", "draft", "final")
    return neardup.near_duplicates(memory, "entry_id", ["source", "draft", "final"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_pairs(*_memory(spark, d))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row an entry: its class of equal word sets, the copies in it, and the number of near classes."""
    return neardup.link_counts(*_memory(spark, d))


# --- 6: alignment --------------------------------------------------------------------------------------------------


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    m = alignment.lexicon(table(spark, d, "chunks", "source", "final"), "source", "final")
    sections = table(spark, d, "sections", "section_id", "source", "final")
    return alignment.sentence_pairs(sections, "section_id", "source", "final", m)


# --- 7: leakage ------------------------------------------------------------------------------------------------------


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items", "item_id", "text")
    return leakage.leaks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", items, "item_id", "text")


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked and the number of documents that hold each."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))


# --- 8: mixing ----------------------------------------------------------------------------------------------------------


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    targets = table(spark, d, "mix_targets", "source", "target_share", "max_repeats")
    return mixing.mix(table(spark, d, "documents", "doc_id", "text", "source"), "doc_id", "text", "source", targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report.where("short").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each source has, is to give and gives."""
    return _mixture(spark, d).report


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: for every filled slot of every output shard, the pieces of documents in its block."""
    return _mixture(spark, d).draws


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"  # where LECTERN_TOKENIZER names no other file


def p8_token_shares(spark: SparkSession, d: str) -> DataFrame:
    """As p8_shares, with sizes in tokens of a public tokenizer, whose file LECTERN_TOKENIZER names."""
    docs = table(spark, d, "documents", "doc_id", "text", "source")
    counts = mixing.token_counts(docs, "doc_id", "text", os.environ.get("LECTERN_TOKENIZER", TOKENIZER))
    targets = table(spark, d, "mix_targets", "source", "target_share", "max_repeats")
    return mixing.mix(docs, "doc_id", "text", "source", targets, counts=counts).report


# --- 9: encodings -------------------------------------------------------------------------------------------------------


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with the chains found, their wrong characters and the restored text."""
    return mojibake.garbled(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_restored(spark, d).select("doc_id")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


_WORDS = "regexp_extract_all(lower(coalesce(source, '') || ' ' || coalesce(draft, '') || ' ' || coalesce(final, '')), '[\\p{L}\\p{N}]+')"
_NEAR = f"""with s as (select entry_id, list_distinct({_WORDS}) as w from correction_memory), e as (select entry_id, len(w) as n, unnest(w) as x from s),
    j as (select a.entry_id as entry_a, b.entry_id as entry_b from e a join e b on a.x = b.x and a.entry_id < b.entry_id group by all having count(*) >= 0.75 * (any_value(a.n) + any_value(b.n) - count(*)))"""
_TOKENS = "(select source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+'), lambda t: t <> '')) as n from documents)"


def oracle_sql() -> dict[str, str]:
    """Plain SQL of those queries whose rules it can express over the whole tables in bearable time."""
    return {
        "p5_found": _NEAR + " select entry_a, entry_b from j",
        "p8_found": f"select m.source from mix_targets m left join (select source, sum(n) as n from {_TOKENS} group by source) t using (source) where coalesce(t.n, 0) * max_repeats < target_share * (select sum(n) from {_TOKENS})",
    }
