"""Alignment of strings and marked spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions import lexicons as L
from ..functions import text as T


def _score(a: str, b: str, match: int, mismatch: int, gap: int) -> int:
    a, b = a.lower(), b.lower()
    row = [j * gap for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i * gap
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], max(diagonal + (match if x == y else mismatch), row[j] + gap, row[j - 1] + gap)
    return row[-1]


def global_score(a: F.Column, b: F.Column, match: int = 2, mismatch: int = -1, gap: int = -2) -> F.Column:
    """Score of the best global alignment of two strings, without case; nulls count as empty.

    A plain global alignment: scores may fall below zero.
    """

    @F.pandas_udf(IntegerType())
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_score(p or "", q or "", match, mismatch, gap) for p, q in zip(x, y)], dtype="int32")

    return score(a, b)


def repair_markers(df: DataFrame, source: str, candidate: str, out: str = "repaired") -> DataFrame:
    """df with the candidate, each missing marker put around the first match of its hint, or appended with its content.

    The candidate may be an array of texts.
    """
    import re

    pair = re.compile(r"\[\[(ZX[A-Z]+[0-9]+X)\]\](.*?)\[\[/\1\]\]", re.S)
    hints = {k: [re.compile(p, re.I) for p in v] for k, v in L.MARKER_HINTS.items()}

    def one(s: str | None, c: str | None) -> str | None:
        if c is None:
            return None
        for marker, content in pair.findall(s or ""):
            if f"[[{marker}]]" in c and f"[[/{marker}]]" in c:
                continue
            content = content.strip()
            wanted = re.sub(r"\s+", " ", content.lower()).strip(" .?!,;:")
            found = next((m for p in hints.get(wanted, []) if (m := p.search(c))), None)
            if found:
                c = f"{c[: found.start()]}[[{marker}]]{found.group()}[[/{marker}]]{c[found.end() :]}"
            else:
                c = f"{c.rstrip()} [[{marker}]]{content or marker}[[/{marker}]]"
        return c

    many = df.schema[candidate].dataType.typeName() == "array"

    @F.pandas_udf(ArrayType(StringType()) if many else StringType())
    def repair(s: pd.Series, c: pd.Series) -> pd.Series:
        if many:
            return pd.Series([None if y is None else [one(x, z) for z in y] for x, y in zip(s, c)], dtype="object")
        return pd.Series([one(x, y) for x, y in zip(s, c)], dtype="object")

    return df.withColumn(out, repair(F.col(source), F.col(candidate)))


def italic_matches(pairs: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """(keys, n_italic, n_kept): words of marked spans of the source, and those that spans of the target hold as well."""
    span = F.lit(r"(?s)\[\[ZX(?:I|EM)[0-9]+X\]\](.*?)\[\[/ZX(?:I|EM)[0-9]+X\]\]")
    inside = lambda c: T.word_tokens(F.array_join(F.regexp_extract_all(F.coalesce(c, F.lit("")), span, F.lit(1)), " "))
    s, t = F.array_distinct(inside(source)), inside(target)
    return pairs.select(*keys, F.size(s).alias("n_italic"), F.size(F.array_intersect(s, t)).alias("n_kept"))
