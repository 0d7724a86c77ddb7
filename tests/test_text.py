"""Scalar functions against values worked out by hand and against plain Python."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import quality as Q
from lectern.functions import semantics as S
from lectern.functions import text as T


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(make(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first().x


def test_normalize(spark):
    assert one(spark, T.normalize_text, "Chapter_Twenty-One!") == "chapter twenty one"
    assert one(spark, T.normalize_text, "  Été 2024 ") == "t 2024"
    assert one(spark, T.normalize_text, None) is None


def test_tokens_and_counts(spark):
    assert [one(spark, T.estimate_tokens, x) for x in ("", "a b c", "abcdefghi", None)] == [1, 3, 3, 1]
    assert [one(spark, T.sentence_count, x) for x in ("A. B! C? ", "no end", "One. Two.")] == [3, 1, 1]


def test_typography(spark):
    assert one(spark, T.french_typography, "“Viens ,”  dit l' homme   !") == "« Viens, » dit l'homme !"


def test_scores(spark):
    src, cand = "She is there with the dog.", "Elle est là avec le chien."
    assert one(spark, lambda s, c: Q.score10(s, c, F.array().cast("array<string>")), src, cand) == 1106
    src, cand = "Elle était là.", "She was there and he said that the dog was with him."
    assert one(spark, Q.english_hits, src, cand) == 10
    assert one(spark, lambda s, c: Q.score10(s, c, F.array().cast("array<string>")), src, cand) == 920


def test_new_numbers(spark):
    got = one(spark, Q.new_numbers, "In 1999 he had 3 cats", "En 2001 il avait 7 et 12 chats")
    assert got == ["hallucinated_number:12", "hallucinated_year:2001"]


def test_flags_of_nulls_and_empty(spark):
    flags = lambda s, d, c: Q.base_flags(s, d, c)
    assert one(spark, flags, None, None, None) == ["empty"]
    assert one(spark, flags, "x", None, "[[ZXB1X]]") == []
    assert one(spark, flags, "[[ZXB1X]]x[[/ZXB1X]]", None, "x") == ["missing_inline_markers"]


def test_chapter_numbers(spark):
    assert [one(spark, T.chapter_number, x) for x in ("Chapter Twenty-One", "ch_7", "chapter x", "chap. two b")] == [21, 7, None, 2]


def test_aspect(spark):
    df = spark.createDataFrame([(w,) for w in ("stopped", "loved", "tried", "walked", "was", "xyzed")], "w string")
    assert [r.x for r in df.select(S.infinitive(F.col("w")).alias("x")).collect()] == ["stop", "love", "try", "walk", "be", "xyz"]
    assert [r.x for r in df.select(S.aspect(F.col("w")).alias("x")).collect()] == ["achievement", "state", "unknown", "activity", "state", "unknown"]


def test_fid_and_dominance(spark):
    assert one(spark, S.fid_raw, "Why would he leave now?") == 3 + 2 + 2 + 2
    assert one(spark, lambda c: S.dominance_parts(c)[0], "Stop! I order you.") == 4
    assert one(spark, lambda c: S.dominance_parts(c)[1], "I think maybe.") == 3


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab [Z]X/1é\n", max_size=30), min_size=1, max_size=20))
def test_words_agree_with_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.x for r in df.select(T.words(F.col("t")).alias("x")).collect()]
    assert got == [re.findall(r"\w+", t) for t in texts]
