"""Records at the edges: JSON lines of memories and checkpoints, configuration in TOML, text notes."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRECTIONS = """version int, created_at string, chapter string, patcher string, source string, draft string, final string,
alt_drafts map<string,string>, flags_fixed array<string>, speaker string, addressee string, register_hint string,
mentioned_characters array<string>, scene_participants array<string>, style_hints array<string>"""
CHECKPOINT = "index int, translation string"
BOOK_MEMORY = """version int, chapters array<string>, characters map<string,struct<count:int,gender:string>>,
glossary_terms map<string,struct<preferred:string,count:int>>, register_edges map<string,string>, style_rules array<string>"""
ENTITIES = "map<string,map<string,int>>"


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """Corrections with a source and a final text; broken lines are skipped."""
    lines = spark.read.schema(CORRECTIONS + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return lines.where("source <> '' and final <> ''").drop("_broken")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def checkpoint_lines(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint lines with seq, by which the folder's later lines come later: a file's time and name, then the line.

    Lines of a file are in order within a block of it, and blocks by where they start.
    """
    lines = spark.read.schema(CHECKPOINT).json(path)
    meta = F.col("_metadata")
    return lines.withColumn("seq", F.struct(meta["file_modification_time"].alias("time"), meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("line")))


def book_memory(spark: SparkSession, path: str) -> DataFrame:
    empty = {"chapters": "array<string>", "style_rules": "array<string>"}
    m = spark.read.schema(BOOK_MEMORY).option("multiLine", "true").json(path)
    return m.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in empty.items()})


def entity_memory(spark: SparkSession, path: str) -> DataFrame:
    """(entity, form, n) of a JSON object of objects."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", ENTITIES).alias("m"))
    e = m.select(F.explode("m").alias("entity", "forms"))
    return e.select("entity", F.explode("forms").alias("form", "n"))


def cast_config(spark: SparkSession, path: str | Path) -> dict[str, DataFrame]:
    """aliases (ord, alias, canonical), genders (name, gender), relations (a, b, type) and glossary of a TOML file."""
    with open(path, "rb") as f:
        c = tomllib.load(f)
    relations = [(*k.split("|", 1), v) for k, v in c.get("relationships", {}).items() if "|" in k]
    rules = [(t, list(r.get("source", [])), list(r.get("preferred", [])), list(r.get("forbidden", []))) for t, r in c.get("glossary", {}).items()]
    return {
        "aliases": spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(c.get("aliases", {}).items(), 1)], "ord int, alias string, canonical string"),
        "genders": spark.createDataFrame(list(c.get("genders", {}).items()), "name string, gender string"),
        "relations": spark.createDataFrame(relations, "a string, b string, type string"),
        "glossary": spark.createDataFrame(rules, "term string, source array<string>, preferred array<string>, forbidden array<string>"),
    }


def write_cache(new: DataFrame, path: str) -> None:
    """Append new results by namespace."""
    new.write.mode("append").partitionBy("namespace").parquet(path)


def memo_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, memo) of every text file there: style memos of books, without white space at their ends; none for a
    missing file."""
    try:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("memo"))
    except AnalysisException:
        return spark.createDataFrame([], "path string, memo string")
    return files.withColumn("memo", F.regexp_replace("memo", r"^\s+|\s+$", ""))


def write_report(report: DataFrame, path: str) -> None:
    """An evaluation report as JSON lines, in place of the one before; nulls stay as such."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_summary(summary: DataFrame, path: str) -> None:
    """Run summaries as JSON lines with their keys in order, behind those before; one file a call."""
    summary.select(*sorted(summary.columns)).coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(path)
