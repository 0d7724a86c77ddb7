"""Order-dependent operators: context windows, hop windows, batches and groups of neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..runtime import arrow_rows, ordered_fold, shared_table


def context_text(chunks: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """(keys, order, context): the text that a patching model is given. Neighbours give their final text, or draft; the
    row itself its meta data, source, draft and the drafts of other models, by name.

    Nulls count as empty. chunks: (keys, order, source, draft, final, speaker, addressee, register_hint, participants,
    style_hints, alt_drafts).
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = lambda c, name: F.when(F.col(c) != "", F.concat(F.lit(f"{name}="), F.col(c)))
    listed = lambda c, name: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}="), F.array_join(c, "/")))
    meta = F.concat_ws(", ", said("speaker", "speaker"), said("addressee", "addressee"), said("register_hint", "register"), listed("participants", "scene"), listed("style_hints", "rules"))
    others = F.array_sort(F.filter(F.map_entries("alt_drafts"), lambda e: e["value"] != ""))
    alternates = F.array_join(F.transform(others, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    target = F.concat(
        F.lit("TARGET META: "), F.when(meta == "", "speaker=unknown").otherwise(meta), F.lit("\nTARGET SOURCE:\n"), text("source"), F.lit("\nTARGET DRAFT:\n"), text("draft"),
        F.when(F.size(others) > 0, F.concat(F.lit("\nTARGET ALTERNATE DRAFTS:\n"), alternates)).otherwise(F.lit("")),
    )
    french = F.concat(F.lit("CTX "), F.col(order).cast("string"), F.lit(" FRENCH:\n"), F.coalesce(F.nullif("final", F.lit("")), "draft", F.lit("")))
    w = Window.partitionBy(*keys).orderBy(order)
    c = chunks.select(*keys, order, target.alias("_target"), french.alias("_french"))
    near = lambda a, b: F.collect_list("_french").over(w.rowsBetween(a, b))
    c = c.select(*keys, order, "_target", near(-k, -1).alias("_before"), near(1, k).alias("_after"))
    return c.select(*keys, order, F.array_join(F.concat("_before", F.array("_target"), "_after"), "\n\n").alias("context"))


def preceding_text(blocks: DataFrame, keys: list[str], order: list[str], id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, before, target): the texts of the k rows before that aren't blank, as paragraphs; the row's own in <<< >>>."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    shown = F.when(T.strip(t) != "", t)  # collect_list leaves nulls out
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-k, -1)
    c = blocks.select(*keys, *order, id_col, t.alias("_t"), shown.alias("_shown"))
    return c.select(id_col, F.array_join(F.collect_list("_shown").over(w), "\n\n").alias("before"), F.concat(F.lit("<<<"), F.col("_t"), F.lit(">>>")).alias("target"))


CHAPTER_WINDOWS = {"light": 3, "heavy": 8}


def chapter_windows(blocks: DataFrame, keys: list[str], order: list[str], id_col: str, text_col: str, mode: str = "light") -> DataFrame:
    """(id, chunk): every block that isn't blank with the 3 (light) or 8 (heavy) blocks around it, as paragraphs."""
    k = CHAPTER_WINDOWS.get(mode, 3)
    leaves = blocks.where(T.strip(F.coalesce(F.col(text_col), F.lit(""))) != "")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-k, k)
    return leaves.select(id_col, F.array_join(F.collect_list(text_col).over(w), "\n\n").alias("chunk"))


def sentence_chunk(c: Column) -> Column:
    """A chapter's sentences of five characters or more as one chunk; null where there is none."""
    parts = F.split(F.regexp_replace(c, r"(?<=[.!?])\s+(?=[A-Z>\"])", "\u001f"), "\u001f")
    kept = F.filter(parts, lambda x: F.length(T.strip(x)) >= 5)
    return F.when(F.size(kept) == 1, F.element_at(kept, 1)).when(F.size(kept) > 1, T.strip(F.array_join(kept, " ")))


def hop_windows(counts: DataFrame, keys: list[str], n: str = "n", size: int = 5, stride: int = 3) -> DataFrame:
    """(keys, start, end) of windows of size rows every stride rows, of two rows or more; end is exclusive."""
    starts = counts.where(F.col(n) > 0).select(*keys, n, F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1, F.lit(stride))).alias("start"))
    end = F.least(F.col(n).cast("int"), F.col("start") + size)
    return starts.withColumn("end", end).where(F.col("end") - F.col("start") >= 2).select(*keys, "start", "end")


def centred_windows(selected: DataFrame, keys: list[str], pos: str = "pos", n: str = "n", size: int = 5) -> DataFrame:
    """(keys, start, end): a window of size rows around each selected 0-based row, kept inside, each once."""
    half = max(1, size // 2)
    first = F.greatest(F.lit(0), F.col(pos) - half)
    end = F.least(F.col(n), first + size)
    w = selected.select(*keys, F.greatest(F.lit(0), end - size).cast("int").alias("start"), end.cast("int").alias("end"))
    return w.where(F.col("end") - F.col("start") >= 2).distinct()


def window_rows(windows: DataFrame, rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """The rows of every window: windows are unrolled to places, so the join is on equal keys, not on a range."""
    places = windows.select(*keys, "start", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias(pos))
    return places.join(rows, [*keys, pos])


def batches(chunks: DataFrame, keys: list[str], id_col: str, text_col: str, limit: int = L.BATCH_TOKENS, most: int = L.BATCH_SIZE) -> DataFrame:
    """(keys, id, tokens, batch): rows by length are packed, at most `most` a batch, while their tokens fit the limit.

    The running sum restarts at each batch, which no window sum expresses: one ordered fold per key.
    """
    slim = chunks.select(*keys, id_col, F.length(F.coalesce(text_col, F.lit(""))).alias("_len"), T.estimate_tokens(F.col(text_col)).alias("tokens"))
    fields = {f.name: f.dataType.simpleString() for f in slim.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in [*keys, id_col]) + ", tokens int, batch int"

    def pack(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        batch = count = used = 0
        for i, _, t in rows:
            if count and used + t > limit or count >= most:
                batch, count, used = batch + 1, 0, 0
            yield *key, i, t, batch
            count, used = count + 1, used + t

    return ordered_fold(slim, keys, ["_len", id_col], pack, schema)


def short_groups(chunks: DataFrame, keys: list[str], order: str, text_col: str, most: int = L.GROUP) -> DataFrame:
    """(keys, order, short, group): runs of short neighbours, cut to `most`; every other row is a group of its own."""
    bare = T.strip(T.strip_markers(F.coalesce(text_col, F.lit(""))))
    short = (bare != "") & (F.length(bare) <= L.SHORT_CHARS) & (F.size(T.spaced(F.col(text_col))) <= L.SHORT_WORDS)
    w = Window.partitionBy(*keys).orderBy(order)
    c = chunks.select(*keys, order, short.alias("short"))
    c = c.withColumn("_run", F.sum(F.when(F.col("short") & F.lag("short", 1, False).over(w), 0).otherwise(1)).over(w))
    in_run = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(order))
    c = c.withColumn("_part", F.floor((in_run - 1) / most))
    first = F.min(order).over(Window.partitionBy(*keys, "_run", "_part"))
    return c.withColumn("group", first).select(*keys, order, "short", "group")


_SPLIT = re.compile(r"(?<=[.!?»'\"])\s+(?=[A-Z\"«—\-])")


def split_long(df: DataFrame, id_col: str, text_col: str, most: int = L.LONG_WORDS) -> DataFrame:
    """(id, part, text): texts over `most` words cut between sentences; shorter ones, and single sentences, whole."""
    def run(ids: list, texts: list) -> Iterator[tuple]:
        for i, t in zip(ids, texts):
            if len(t.split()) <= most:
                yield i, 0, t
                continue
            parts: list[list[str]] = [[]]
            count = 0
            for s in _SPLIT.split(t):
                n = len(s.split())
                if count + n > most and parts[-1]:
                    parts.append([])
                    count = 0
                parts[-1].append(s)
                count += n
            for k, p in enumerate(parts):
                yield i, k, " ".join(p)

    return arrow_rows(df.where(F.col(text_col).isNotNull()), run, [id_col, text_col], "id bigint, part int, text string")


def split_grouped(df: DataFrame, text_col: str, expected: str) -> DataFrame:
    """df with parts: the text cut at sentinels if that gives the expected count, else its lines if those do, else null."""
    sentinel = r"\[\[ZXSEG\d+X\]\]|ZXSEG\d+X"
    clean = lambda a: F.filter(F.transform(a, T.strip), lambda x: x != "")
    parts = clean(F.split(text_col, sentinel))
    lines = F.filter(clean(F.split(text_col, "\n")), lambda x: ~x.rlike(f"^(?:{sentinel})$"))
    n = F.col(expected)
    return df.withColumn("parts", F.when(F.size(parts) == n, parts).when(F.size(lines) == n, lines))


def numbered(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order, pos, n): each row's place from 0 among its key's rows, and their number; order is unique within a key.

    Rows are range-partitioned by key and order and written; places are counted within each range, and the ranges' own
    counts are summed by key. So a key of a third of all rows is spread over many tasks.
    """
    slim = shared_table(df.select(*keys, order).repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = slim.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    before = counts.select(*keys, "_range", (F.sum("_c").over(w.orderBy("_range")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("n"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1
    placed = slim.withColumn("_in", inner).join(before, [*keys, "_range"])
    return placed.select(*keys, order, (F.col("_before") + F.col("_in")).alias("pos"), "n")


def systematic_sample(df: DataFrame, keys: list[str], order: str, most: int = 20) -> DataFrame:
    """Every step-th row of a key, most of them at most; step is the row count divided by most, 1 at least."""
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    picked = numbered(df, keys, order).where((F.col("pos") % step == 0) & (F.col("pos") / step < most)).select(*keys, order)
    return df.join(picked, [*keys, order], "left_semi")
