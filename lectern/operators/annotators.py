"""Operators over what outside annotators say: grammar checks, parsed tokens, coreference, memos and glossaries of a model.

The annotators can't run here: each is a models.Model whose first hypothesis is JSON or text, and what follows from it
is computed by expressions and keyed joins. An annotator that fails or says nothing leaves rows as they are.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from . import models

TOKENS = "array<struct<text:string,pos:string,tense:string,verb_form:string,gender:string,number:string,head:int>>"
PRONOUNS = ("he", "she", "they", "i", "me")
LONG_PARAGRAPH = 60


def _json(df: DataFrame, keys: list[str], text: str, model: models.Model, schema: str) -> DataFrame:
    out = models.infer(df, keys, text, model)
    return out.select(*keys, F.from_json(F.element_at("outputs", 1), schema).alias("said"))


# --- grammar -------------------------------------------------------------------------------------------------


def grammar_messages(df: DataFrame, keys: list[str], text: str, checker: models.Model, least: int = 40, most: int = 5) -> DataFrame:
    """(keys, messages): the first messages of a checker for texts of at least so many characters; none for others,
    nulls, and texts on which it fails. The checker's hypotheses are its messages."""
    t = F.when(F.length(text) >= least, F.col(text))
    out = models.infer(df.select(*keys, t.alias("_t")), keys, "_t", checker)
    return out.select(*keys, F.slice(F.coalesce("outputs", F.array().cast("array<string>")), 1, most).alias("messages"))


def paragraphs(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, par, paragraph): a text's lines of more than LONG_PARAGRAPH characters, or the whole text where there is none."""
    long = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n+"), T.strip), lambda x: F.length(x) > LONG_PARAGRAPH)
    parts = F.when(F.size(long) > 0, long).otherwise(F.array(F.coalesce(text, F.lit(""))))
    return df.select(*keys, F.posexplode(parts).alias("par", "_p")).select(*keys, "par", F.substring("_p", 1, 2000).alias("paragraph"))


def parsed(df: DataFrame, keys: list[str], text: str, parser: models.Model) -> DataFrame:
    """(keys, tokens) of a parser that answers with JSON; heads are places from 0, tokens null where it fails."""
    return _json(df, keys, text, parser, TOKENS).withColumnRenamed("said", "tokens")


def tense_mixing(tokens: Column) -> Column:
    """A warning where finite past forms and participles with an auxiliary stand together; null elsewhere."""
    head = lambda t: F.get(tokens, t["head"])["pos"]
    led = F.transform(F.filter(tokens, lambda t: t["pos"] == "AUX"), lambda t: t["head"])
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    past = lambda t: t["pos"].isin("VERB", "AUX") & (t["tense"] == "Past")
    simple = F.transform(F.filter(tokens, lambda t: past(t) & (t["verb_form"] == "Fin")), lambda t: t["text"])
    made = F.filter(placed, lambda x: past(x["t"]) & (x["t"]["verb_form"] == "Part") & (F.coalesce(head(x["t"]) == "AUX", F.lit(False)) | F.array_contains(led, x["i"])))
    compound = F.transform(made, lambda x: x["t"]["text"])
    first = lambda a: F.array_join(F.slice(a, 1, 3), ", ")
    said = F.concat(F.lit(L.TENSE_MIXING[0]), first(simple), F.lit(L.TENSE_MIXING[1]), first(compound), F.lit(L.TENSE_MIXING[2]))
    return F.when((F.size(simple) > 0) & (F.size(compound) > 0), said)


def agreement_errors(tokens: Column, most: int = 5) -> Column:
    """Adjectives whose gender or number differs from that of the noun they hang on, both being known."""

    def of(t: Column) -> Column:
        noun = F.get(tokens, t["head"])
        fits = (t["pos"] == "ADJ") & noun["pos"].isin("NOUN", "PROPN")
        one = lambda kind: F.when(fits & (noun[kind] != t[kind]), F.concat(F.lit(f"{kind}_mismatch: '"), noun["text"], F.lit("' ("), noun[kind], F.lit(") + '"), t["text"], F.lit("' ("), t[kind], F.lit(")")))
        return F.array_compact(F.array(one("gender"), one("number")))

    # the adjective that reaches the limit is still told in full
    found = F.filter(F.transform(tokens, of), lambda x: F.size(x) > 0)
    told = F.aggregate(found, F.array().cast("array<string>"), lambda a, x: F.when(F.size(a) >= most, a).otherwise(F.concat(a, x)))
    return F.coalesce(told, F.array().cast("array<string>"))


# --- coreference ---------------------------------------------------------------------------------------------


def resolve_speakers(chunks: DataFrame, keys: list[str], aliases: DataFrame, coreference: models.Model) -> DataFrame:
    """chunks with speaker filled in where it was empty and a cluster of mentions names a known character and has a pronoun.

    The first such cluster of a chunk decides, and in it the first mention that is an alias, without a possessive
    ending. aliases: (alias, canonical), one canonical name an alias. coreference answers with an array of clusters,
    arrays of mentions.
    """
    lacking = chunks.where(F.coalesce("speaker", F.lit("")) == "").select(*keys, T.strip_markers(F.coalesce("source", F.lit(""))).alias("_t"))
    said = _json(lacking, keys, "_t", coreference, "array<array<string>>")
    m = said.select(*keys, F.posexplode("said").alias("_c", "_ms")).select(*keys, "_c", F.posexplode("_ms").alias("_m", "_mention"))
    clean = F.rtrim(T.strip(F.col("_mention")), F.lit("'s"))
    m = m.withColumns({"_alias": clean, "_low": F.lower(clean), "_pronoun": F.lower(T.strip(F.col("_mention"))).isin(*PRONOUNS)})
    known = lambda c, name: aliases.select(F.col("alias").alias(c), F.col("canonical").alias(name))
    m = m.join(known("_alias", "_exact"), "_alias", "left").join(known("_low", "_loose"), "_low", "left")
    found = F.coalesce("_exact", "_loose")
    c = m.groupBy(*keys, "_c").agg(F.min_by(found, F.when(found.isNotNull(), F.col("_m"))).alias("_who"), F.max("_pronoun").alias("_p"))
    first = c.where(F.col("_p") & F.col("_who").isNotNull()).groupBy(*keys).agg(F.min_by("_who", "_c").alias("_who"))
    return chunks.join(first, keys, "left").withColumn("speaker", F.coalesce(F.nullif("speaker", F.lit("")), "_who", "speaker")).drop("_who")


# --- memos and glossaries --------------------------------------------------------------------------------------


def model_memos(memos: DataFrame, chunks: DataFrame, keys: list[str], order: str, model: models.Model, remembered: DataFrame | None = None, sample: int = 3) -> DataFrame:
    """(keys, memo): each chapter's memo, followed by what a model makes of it, of the book's remembered memo, and of the
    first chunks' sources and drafts; the memo alone where the model says nothing.

    memos: (keys, memo); remembered: (first key, memo).
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    shown = F.concat(F.lit("SOURCE:\n"), text("source"), F.lit("\nDRAFT:\n"), text("draft"))
    s = chunks.select(*keys, order, place.alias("_k"), shown.alias("_s")).where(F.col("_k") <= sample)
    samples = s.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_s"))), lambda x: x["_s"]), "\n\n---\n\n").alias("_samples"))
    j = memos.join(samples, keys, "left")
    if remembered is not None:
        j = j.join(remembered.select(keys[0], F.nullif("memo", F.lit("")).alias("_old")), keys[0], "left")
    else:
        j = j.withColumn("_old", F.lit(None).cast("string"))
    request = F.concat_ws("\n\n", F.concat(F.lit("DETERMINISTIC MEMORY:\n"), "memo"), F.concat(F.lit("CROSS-CHAPTER STYLE MEMO:\n"), "_old"), F.concat(F.lit("SAMPLES:\n"), F.coalesce("_samples", F.lit(""))))
    out = models.infer(j.select(*keys, request.alias("_r")), keys, "_r", model).select(*keys, F.nullif(T.strip(F.element_at("outputs", 1)), F.lit("")).alias("_said"))
    memo = F.concat(F.col("memo"), F.coalesce(F.concat(F.lit("\n\nLLM MEMO:\n"), "_said"), F.lit("")))
    return memos.join(out, keys, "left").select(*keys, memo.alias("memo"))


def model_glossary(books: DataFrame, key: str, text: str, model: models.Model, most: int = 4000) -> DataFrame:
    """(key, term, source, preferred, forbidden): rules that a model finds in a text's first characters, as the JSON object
    of its answer; none where it answers otherwise."""
    rules = "map<string,struct<source:array<string>,preferred:array<string>,forbidden:array<string>>>"
    out = models.infer(books.select(key, T.strip(F.substring(text, 1, most)).alias("_t")), [key], "_t", model)
    said = out.select(key, F.from_json(F.regexp_extract(F.element_at("outputs", 1), r"(?s)(\{.*\})", 1), rules).alias("said"))
    none = F.array().cast("array<string>")
    e = said.select(key, F.explode("said").alias("term", "r"))
    return e.select(key, "term", *(F.coalesce(F.col("r")[c], none).alias(c) for c in ("source", "preferred", "forbidden")))


# --- stand-ins -----------------------------------------------------------------------------------------------


@dataclass
class Marks:
    """A stand-in for a grammar checker: a message for each exclamation mark."""

    name: str = "marks"

    def load(self) -> None:
        pass

    def run(self, texts: list[str], contexts: list[str]) -> list[list[str]]:
        return [[f"[EXCLAMATION] one mark (offset {k})" for k, c in enumerate(t) if c == "!"] for t in texts]


@dataclass
class OneCluster:
    """A stand-in for coreference: all words of a text as one cluster."""

    name: str = "one-cluster"

    def load(self) -> None:
        pass

    def run(self, texts: list[str], contexts: list[str]) -> list[list[str]]:
        return [[json.dumps([re.findall(r"\w+", t)])] for t in texts]


@dataclass
class Answers:
    """A stand-in that answers by a table of text to hypotheses, and fails on other texts."""

    table: dict[str, list[str]]
    name: str = "answers"

    def load(self) -> None:
        pass

    def run(self, texts: list[str], contexts: list[str]) -> list[list[str]]:
        return [self.table[t] for t in texts]
