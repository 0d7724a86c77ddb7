"""Pluggable batch inference: one protocol for every model, deterministic stand-ins, and the passes that use them.

Models can't run here; a Model is whatever has this protocol. Passes read a snapshot of all rows, so their result
doesn't depend on the order in which rows are visited.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality as Q


class Model(Protocol):
    """Loaded once a worker, then called with batches."""

    name: str

    def load(self) -> None: ...
    def run(self, texts: list[str], contexts: list[str]) -> list[list[str]]:
        """One or more hypotheses for every text, the best first."""
        ...


@dataclass
class Stub:
    """A stand-in that marks its input, for tests and dry runs."""

    name: str = "stub"
    n_best: int = 1

    def load(self) -> None:
        pass

    def run(self, texts: list[str], contexts: list[str]) -> list[list[str]]:
        return [[f"[Translated {t}]" if k == 0 else f"[Translated {t}] ({k})" for k in range(self.n_best)] for t in texts]


@dataclass
class Substitution:
    """A stand-in that rewrites by a table of (from, to), for tests of patching passes."""

    rules: list[tuple[str, str]] = field(default_factory=list)
    name: str = "substitution"

    def load(self) -> None:
        pass

    def run(self, texts: list[str], contexts: list[str]) -> list[list[str]]:
        out = []
        for t in texts:
            for a, b in self.rules:
                t = t.replace(a, b)
            out.append([t])
        return out


def infer(df: DataFrame, keys: list[str], text: str, model: Model, context: str | None = None, batch: int = 64) -> DataFrame:
    """(keys, outputs, error): the model's hypotheses for every row.

    A failing batch is repeated row by row; rows that fail alone have null outputs and the error's text. Null
    texts aren't sent and have null outputs.
    """
    src = df.select(*keys, F.col(text).alias("_t"), (F.col(context) if context else F.lit("")).alias("_c"))
    fields = {f.name: f.dataType.simpleString() for f in src.schema}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", outputs array<string>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.load()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts, ctx = part.column(len(keys)).to_pylist(), part.column(len(keys) + 1).to_pylist()
                there = [i for i, t in enumerate(texts) if t is not None]
                outs: list[list[str] | None] = [None] * len(texts)
                errors: list[str | None] = [None] * len(texts)
                try:
                    for i, o in zip(there, model.run([texts[i] for i in there], [ctx[i] or "" for i in there])):
                        outs[i] = o
                except Exception:
                    for i in there:
                        try:
                            outs[i] = model.run([texts[i]], [ctx[i] or ""])[0]
                        except Exception as e:
                            errors[i] = f"{type(e).__name__}: {e}"[:300]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keys))), pa.array(outs, pa.list_(pa.string())), pa.array(errors, pa.string())],
                    names=[*keys, "outputs", "error"],
                )

    return src.mapInArrow(run, schema)


def estimate(cands: DataFrame) -> DataFrame:
    """cands with raw: a stand-in for learned quality estimation, the heuristic score within 0..1."""
    return cands.withColumn("raw", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score10") / 1000)))


Select = Callable[[DataFrame], DataFrame]


def revise(rows: DataFrame, keys: list[str], model: Model, wanted: F.Column, strict: bool = True) -> DataFrame:
    """One pass: rows for which wanted holds go to the model; its first output replaces current if it is accepted.

    rows: (keys, source, draft, current). The result has the same columns; each row depends on the snapshot only.
    """
    chosen = rows.where(wanted & F.col("current").isNotNull())
    out = infer(chosen, keys, "current", model, "source").select(*keys, F.element_at("outputs", 1).alias("_new"))
    j = rows.join(out, keys, "left")
    flags = lambda c: Q.all_flags(F.col("source"), F.col("draft"), F.col(c))
    j = j.withColumn("_fb", flags("current")).withColumn("_fn", flags("_new"))
    ok = Q.accepted(Q.hard_flags(F.col("_fb")), Q.score10(F.col("source"), F.col("current"), F.col("_fb")), Q.hard_flags(F.col("_fn")), Q.score10(F.col("source"), F.col("_new"), F.col("_fn")), strict)
    take = F.col("_new").isNotNull() & (F.col("_new") != "") & ok
    return j.withColumn("current", F.when(take, F.col("_new")).otherwise(F.col("current"))).drop("_new", "_fb", "_fn")


def selection(mode: str, current: str = "current") -> F.Column:
    """off, all, changed, failed or dialogue: which rows a pass wants."""
    from ..functions import text as T

    flags = Q.all_flags(F.col("source"), F.col("draft"), F.col(current))
    return {
        "off": F.lit(False),
        "all": F.lit(True),
        "changed": F.col(current) != F.col("draft"),
        "failed": F.size(flags) > 0,
        "dialogue": (F.size(flags) > 0) | T.has_speech(F.coalesce("source", F.lit(""))),
    }[mode]


def window_json(c: F.Column) -> F.Column:
    """The array of (index, translation) in a model's answer; null if it isn't one."""
    inner = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.from_json(inner, "array<struct<index:int,translation:string>>")


def window_valid(parsed: F.Column, expected: F.Column) -> F.Column:
    """Whether every expected index has a translation, and no other."""
    got = F.array_sort(F.array_distinct(F.transform(parsed, lambda x: x["index"])))
    full = F.forall(parsed, lambda x: x["index"].isNotNull() & (F.trim(F.coalesce(x["translation"], F.lit(""))) != ""))
    return F.coalesce(full & (got == F.array_sort(expected)), F.lit(False))
