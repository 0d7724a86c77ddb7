"""Session, table access and small helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: str | int = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller passes its own.

    conf: further settings, with __ for the dots of their names.
    """
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lectern")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table of the input folder, with only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where nothing is set, as in local tests, a temporary folder is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        at = Path(tempfile.gettempdir(), "lectern-checkpoint").as_uri()
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder, so that later uses don't compute it again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table under the shared folder; columns stay prunable, unlike in a checkpoint.

    The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes a shared table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores.

    Few input splits mean a small input, so the exchange is cheap; larger inputs stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def arrow_rows(df: DataFrame, fn: Callable[..., Iterator[tuple]], columns: list[str], schema: str) -> DataFrame:
    """Arrow batches of df's columns through fn(*lists) -> an iterator of output rows.

    Whole batches cross the JVM boundary as columns; output is flushed every 2,048 rows to bound memory.
    """
    source = df.select(*columns)
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[] for _ in arrow_schema]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(cols, arrow_schema)], schema=arrow_schema
            )

        for batch in batches:
            rows: list[tuple] = []
            for row in fn(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                rows.append(row)
                if len(rows) == 2048:
                    yield flush(rows)
                    rows = []
            if rows:
                yield flush(rows)

    return source.mapInArrow(run, target)


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """fold(key, rows in order) -> output rows, for every key.

    Rows are hash-partitioned by key and sorted within partitions, and a partition is read as one stream of Arrow
    batches, so a key's rows are never held together, neither in the JVM nor in Python. Rows are tuples of df's
    columns after the keys.
    """
    from itertools import groupby

    from pyspark.sql.pandas.types import to_arrow_schema

    rest = [c for c in df.columns if c not in keys]
    target = df.sparkSession.createDataFrame([], schema).schema
    arrow_schema = to_arrow_schema(target)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)))

        def flush(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow_schema)], schema=arrow_schema)

        out: list[tuple] = []
        for key, group in groupby(rows(), key=lambda r: r[:n]):
            for row in fold(key, (r[n:] for r in group)):
                out.append(row)
                if len(out) == 4096:
                    yield flush(out)
                    out = []
        if out:
            yield flush(out)

    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, target)


def data_dir(default: str = "/root/testdata/sf0.001") -> str:
    return os.environ.get("LECTERN_DATA", default)
