"""Problem 3: visually identical texts with different characters.

Method: a confusables skeleton. Every text is decomposed, each character replaced by its prototype, and
decomposed again (textform.skeleton); originals are grouped by equal skeletons. The look-alike table is made of all
of Unicode's confusables (textform.confusables) on the driver and travels with the function.

Scale: texts cross to Python once, as Arrow columns. Only 64-bit digests and forms of skeletons with two or
more different forms are paired, form with form, and rows join their forms. So equal strings, however many,
never meet, and every joined row is a pair of the result, whose definition asks for all of them; the rows of a
hot form are split by AQE's skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_rows, shared_table, spread
from .textform import WORD, confusables, fold_table, one_form, skeleton


def skeletons(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, skeleton, form): form is the text without white space at its ends.

    Null texts and texts without letter or digit have no row. Other columns of df are not read.
    """

    letters = confusables(df.sparkSession)

    def run(ids: list, texts: list) -> Iterator[tuple]:
        table = fold_table() | letters
        for i, t in zip(ids, texts):
            if t and i is not None and WORD.search(t):
                yield i, skeleton(t, table), t.strip()

    return arrow_rows(spread(df), run, [id_col, text_col], "id bigint, skeleton string, form string")


def canonical(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, canonical): every text in its one form; null stays null, and '' stays ''."""

    letters = confusables(df.sparkSession)

    def run(ids: list, texts: list) -> Iterator[tuple]:
        table = fold_table() | letters
        for i, t in zip(ids, texts):
            yield i, None if t is None else one_form(t, table)

    return arrow_rows(spread(df), run, [id_col, text_col], "id bigint, canonical string")


def _digests(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        F.xxhash64("skeleton").alias("s1"),
        F.xxhash64("skeleton", F.lit(1)).alias("s2"),
        F.xxhash64("form").alias("f1"),
        F.xxhash64("form", F.lit(1)).alias("f2"),
    )


def look_alike_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per text: (id, group_id, n_forms, n_texts); group_id is the least id of its skeleton."""
    d = _digests(skeletons(df, id_col, text_col))
    # forms are counted first, so a hot skeleton reaches one reducer as one row per form, not per text
    forms = d.groupBy("s1", "s2", "f1", "f2").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    groups = forms.groupBy("s1", "s2").agg(
        F.min("least").alias("group_id"), F.count("*").alias("n_forms"), F.sum("n").alias("n_texts")
    )
    return d.join(groups, ["s1", "s2"]).select("id", "group_id", "n_forms", "n_texts")


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts read the same but aren't the same string.

    Null texts and texts without letter or digit are in no pair; white space at the ends makes no difference. A row
    that comes twice repeats its pairs, and two texts of one id are no pair.
    """
    d = shared_table(_digests(skeletons(df, id_col, text_col)), "skeletons")
    forms = d.select("s1", "s2", "f1", "f2").distinct()
    a = forms.select("s1", "s2", F.col("f1").alias("a1"), F.col("f2").alias("a2"))
    b = forms.select("s1", "s2", F.col("f1").alias("b1"), F.col("f2").alias("b2"))
    before = (F.col("a1") < F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") < F.col("b2")))
    pairs = a.join(b, ["s1", "s2"]).where(before).select("a1", "a2", "b1", "b2")
    # rows meet rows of another form only: a hot text costs its rows once for each of its other forms
    x = d.select(F.col("f1").alias("a1"), F.col("f2").alias("a2"), F.col("id").alias("x"))
    y = d.select(F.col("f1").alias("b1"), F.col("f2").alias("b2"), F.col("id").alias("y"))
    met = pairs.join(x, ["a1", "a2"]).join(y, ["b1", "b2"])
    return met.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
