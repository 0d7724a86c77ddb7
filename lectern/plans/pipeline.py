"""From books to books: extraction, annotation, inference, validation, patching, output. Each step is a snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import quality as Q
from ..functions import text as T
from ..operators import memo, memory, models, profile, rerank, similarity, strings, windows
from ..runtime import forget, shared_table
from ..sources import epub


def chunks_of(units: DataFrame) -> DataFrame:
    """(book_id, chapter, chunk_idx, source) of translation units, numbered from 1 in each item; an item is one window."""
    return units.select("book_id", F.col("name").alias("chapter"), F.col("block_pos").alias("chunk_idx"), F.col("marked_text").alias("source"), "tag", "markers")


def draft(chunks: DataFrame, keys: list[str], model: models.Model, cache: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafts, new cache rows): every chunk's draft from a checkpoint, the cache, or the model; typography and markers repaired.

    done: (keys, translation) of the last run's checkpoint. Equal sources are sent once.
    """
    there = chunks.join(done.select(*keys, F.col("translation").alias("draft")), keys)
    rest = memory.misses(chunks, done, keys)

    def call(lacking: DataFrame) -> DataFrame:
        out = models.infer(lacking, ["key"], "source", model)
        return out.select("key", F.element_at("outputs", 1).alias("value")).where("value is not null")

    answers, new = memory.memoised(rest, cache, model.name, T.content_key(F.lit(model.name), F.col("source")), call)
    made = answers.withColumn("draft", T.french_typography(T.clean_generated(F.col("value")))).drop("key", "value")
    made = strings.repair_markers(made, "source", "draft", "draft")
    return there.unionByName(made), new


def best_hypotheses(chunks: DataFrame, keys: list[str], model: models.Model, names: F.Column) -> DataFrame:
    """(keys, text): of the model's hypotheses, the best that keeps the names."""
    out = models.infer(chunks, keys, "source", model).where("outputs is not null")
    c = chunks.join(out.select(*keys, F.posexplode("outputs").alias("ord", "text")), keys)
    return rerank.best_hypothesis(rerank.scored(c.withColumn("draft", F.col("source")), names, full=False), keys, names).select(*keys, "text")


def arbitrate(chunks: DataFrame, keys: list[str], second: models.Model) -> DataFrame:
    """chunks whose draft needs a patch get the second model's draft among their alternatives."""
    flags = Q.base_flags(F.col("source"), F.col("draft"), F.col("draft"))
    need = F.size(Q.patch_reasons(flags, Q.score10(F.col("source"), F.col("draft"), flags))) > 0
    out = models.infer(chunks.where(need), keys, "source", second).select(*keys, F.element_at("outputs", 1).alias("_alt"))
    old = F.coalesce("alt_drafts", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: k != second.name), F.create_map(F.lit(second.name), F.col("_alt")))
    return chunks.join(out, keys, "left").withColumn("alt_drafts", F.when(F.col("_alt").isNotNull(), merged).otherwise(F.col("alt_drafts"))).drop("_alt")


def patch_by_estimate(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, text): the candidate of the best adjusted estimate, or the draft where it isn't accepted."""
    c = models.estimate(rerank.scored(rerank.candidates(chunks, keys), full=False))
    c = c.withColumn("value", Q.adjusted_qe10(F.col("raw"), F.col("score10"), F.col("flags")))
    c = rerank.accept(c, keys).where("accepted or ord = 1")
    return rerank.choose_estimated(c, keys, "value").select(*keys, "name", "text")


def safest(chunks: DataFrame, keys: list[str], rules: DataFrame) -> DataFrame:
    """(keys, name, text): the last choice among current text, draft and alternatives, by all checks.

    chunks have names and who of with_cast; rules are the glossary's.
    """
    c = rerank.candidates(chunks, keys, "names", "who")
    found = memory.glossary_column(rules, T.strip_markers(F.coalesce("source", F.lit(""))), T.strip_markers(F.col("text")))
    scored = rerank.scored(c, F.col("names"), glossary=found, w=F.col("who")).drop("names", "who")
    return rerank.rerank(scored, keys).select(*keys, "name", "text")


def with_cast(chunks: DataFrame) -> DataFrame:
    """chunks with names, those of their book's texts that must be kept, and who, as the checks of names want it.

    Of both, a chunk has what its own source names: the checks look at no more, and a book's whole cast isn't carried along.
    """
    b = chunks.select(F.col("book_id").alias("book"), F.col("chapter").alias("part"), F.col("chunk_idx").alias("pos"), F.col("chunk_id").alias("id"), F.col("source").alias("text"))
    there = chunks.select(F.col("book_id").alias("book"), F.explode(F.concat(F.coalesce("mentioned", F.array().cast("array<string>")), F.array("speaker"))).alias("name")).where("name <> ''")
    cast = profile.cast(b, there).withColumn("_lines", Q.lines(F.col("cast.addresses")))
    known = profile.required_names(b).join(cast, "book", "full").withColumnRenamed("book", "book_id")
    c = chunks.join(known, "book_id", "left").withColumn("names", Q.names_here(F.col("source"), F.coalesce("names", F.array().cast("array<string>"))))
    c = c.withColumn("who", Q.who(F.col("speaker"), F.col("mentioned"), F.col("register_hint"), F.col("cast")))
    return c.withColumn("who", Q.who_here(F.col("source"), F.col("who"), F.col("_lines"))).drop("cast", "_lines")


@dataclass
class Editors:
    """The models of the literary pipeline; the critic answers with a critique, back with a text in the source's language."""

    patcher: models.Model
    repairer: models.Model
    critic: models.Model
    back: models.Model
    reader: models.Model
    window: models.Model


def literary(chunks: DataFrame, by: Editors, rules: DataFrame, corrections: DataFrame, rounds: int = 2) -> DataFrame:
    """chunks whose draft isn't null, with names, who and final: the whole literary pass over them.

    Patch (the memory's exact correction or the patcher's hypotheses, the draft and the alternatives as one pool, then
    up to rounds repairs of what isn't accepted), critic, back-check of changed texts, reread of flagged ones, revision
    in windows, and the safest of current text, draft and alternatives. Every pass is a snapshot; rows that a pass
    doesn't want aren't sent, but go through, so no pass joins the rows with themselves, windows apart.
    evaluate.chapter_report and memory.new_corrections take the result.

    A text is checked once, when it comes in; its mark goes along with it. An answer that is the current text isn't checked again.
    """
    s, d, cur, new = (F.col(c) for c in ("source", "draft", "current", "_new"))
    of_draft, of_current, of_new = (F.col(c) for c in ("_of_draft", "_of_current", "_of_new"))
    read = memory.glossary_rules(rules)
    flags = _checks(read)
    spark = chunks.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def mark(c: F.Column) -> F.Column:
        """Hard flags, score, count of flags, and whether a draft of these is to be patched."""
        both = T.let(flags(c), lambda f: F.struct(f.alias("f"), Q.score10(s, c, f).alias("s")))
        return T.let(both, lambda x: F.struct(Q.hard_flags(x["f"]).alias("h"), x["s"].alias("s"), F.size(x["f"]).alias("n"), (F.size(Q.patch_reasons(x["f"], x["s"])) > 0).alias("patch")))

    marked = mark(new)  # built once for all passes

    def judged(base: F.Column, c: F.Column) -> F.Column:
        return F.coalesce(Q.accepted(base["h"], base["s"], c["h"], c["s"]), F.lit(False))

    def ask(rows: DataFrame, wanted: F.Column, model: models.Model, text: str = "current") -> DataFrame:
        sent = rows.withColumn("_ask", F.when(wanted, F.col(text)))
        return models.infer(sent, rows.columns, "_ask", model, "source")

    def fine(c: F.Column) -> F.Column:
        return T.french_typography(T.clean_generated(c))

    def answered(rows: DataFrame) -> DataFrame:
        """rows with _new, the model's first answer, and its mark where it is another text than the current one."""
        r = strings.repair_markers(rows.withColumn("_new", fine(F.element_at("outputs", 1))), "source", "_new", "_new")
        return r.drop("outputs", "error").withColumn("_of_new", F.when((new != "") & (new != cur), marked))

    def taken(rows: DataFrame, take: F.Column) -> DataFrame:
        r = rows.withColumn("_take", take)
        r = r.withColumn("current", F.when(F.col("_take"), new).otherwise(cur))
        return r.withColumn("_of_current", F.when(F.col("_take"), of_new).otherwise(of_current))

    def replace(rows: DataFrame, wanted: F.Column, model: models.Model) -> DataFrame:
        """current becomes the model's answer where it is wanted and accepted."""
        return taken(answered(ask(rows, wanted, model)), judged(of_current, of_new)).select(*keep)

    def option(text: F.Column, m: F.Column, k: F.Column | int) -> F.Column:
        """Of options the least is chosen: the fewest hard flags, then the best score, then the first."""
        k = k if isinstance(k, F.Column) else F.lit(k)
        return F.struct(m["h"].alias("h"), (-m["s"]).alias("o"), k.cast("int").alias("k"), text.alias("text"), m.alias("m"))

    def best(*options: F.Column) -> F.Column:
        return F.array_min(F.filter(F.concat(*options), lambda x: x["text"] != ""))

    plain = T.strip_markers(F.coalesce(s, F.lit("")))
    # the draft and the alternatives by name
    alternatives = F.coalesce("alt_drafts", F.create_map().cast("map<string,string>"))
    there = F.filter(F.transform(F.array_sort(F.map_keys(alternatives)), lambda k: F.element_at(alternatives, k)), lambda x: x != "")
    c = with_cast(chunks.where("draft is not null")).repartition(parts)
    kept = c.columns
    c = c.withColumn("_rules", memory.glossary_here(read, plain))
    keep = [*c.columns, "_of_draft", "_alts", "current", "_of_current"]
    c = c.withColumn("_texts", F.transform(F.concat(F.array(d), there), lambda x: F.struct(x.alias("text"), mark(x).alias("m"))))
    c = c.withColumn("_of_draft", F.col("_texts")[0]["m"]).withColumn("_alts", F.slice("_texts", 2, F.size("_texts") - 1)).drop("_texts")
    first = shared_table(c, "literary")
    others = lambda k: F.transform("_alts", lambda x, i: option(x["text"], x["m"], i + k))
    # patch: one pool of the draft, the memory's or the patcher's texts, and the alternatives
    need = of_draft["patch"]
    exact = similarity.latest_exact(first.where(need).select("chunk_id", "source", "draft", "names", "who", "_rules"), "chunk_id", corrections, "entry_id", flags(F.col("candidate")))
    rows = first.repartition(parts, "chunk_id").join(exact.select("chunk_id", F.col("candidate").alias("_memory")), "chunk_id", "left")
    asked = ask(rows, need & F.col("_memory").isNull(), by.patcher, "draft")
    made = F.when(F.col("_memory").isNotNull(), F.array("_memory")).otherwise(F.coalesce("outputs", F.array().cast("array<string>")))
    asked = strings.repair_markers(asked.withColumn("_made", F.when(need, F.transform(made, fine))), "source", "_made", "_made")
    pool = best(F.array(option(d, of_draft, 0)), F.transform("_made", lambda x, i: T.let(F.when(x == d, of_draft).otherwise(mark(x)), lambda m: option(x, m, i + 1))), others(1000))
    rows = asked.withColumn("_best", F.when(need, pool)).withColumn("current", F.coalesce("_best.text", "draft")).withColumn("_of_current", F.coalesce("_best.m", "_of_draft"))
    rows = second = shared_table(rows.withColumn("_ok", (cur == d) | judged(of_draft, of_current)).select(*keep, "_ok"), "literary")
    forget(first)
    for _ in range(rounds):  # a repair is kept if it is accepted or better; one that isn't ends the repairs
        r = answered(ask(rows, ~F.col("_ok"), by.repairer)).withColumn("_good", judged(of_draft, of_new))
        less = F.coalesce((of_new["h"] < of_current["h"]) & (of_new["s"] >= of_current["s"]), F.lit(False))
        rows = taken(r, F.col("_good") | less).withColumn("_ok", F.col("_ok") | F.col("_good")).select(*keep, "_ok")
    rows = rows.withColumn("_of_current", F.when(F.col("_ok"), of_current).otherwise(of_draft)).withColumn("current", F.when(F.col("_ok"), cur).otherwise(d)).select(*keep)
    # critic
    informal = F.col("who.informal") | (T.has_speech(plain) & T.has_phrase(plain, L.SECOND_PERSON) & ~T.has_phrase(plain, L.PLURAL_OR_FORMAL))
    r = ask(rows, (cur != "") & ((cur != d) | (of_current["n"] > 0) | informal), by.critic).withColumn("_issue", F.element_at("outputs", 1)).drop("outputs", "error")
    rows = replace(r, F.col("_issue").isNotNull() & ~memo.critique_is_ok(F.col("_issue")), by.repairer)
    # back-check: the text rendered back shares too few content words with the source, or lacks a name
    r = ask(rows, cur != d, by.back).withColumn("_back", T.strip_markers(F.element_at("outputs", 1))).drop("outputs", "error")
    words = lambda x: T.content_tokens(T.memory_text(x))
    have, want = T.words(F.col("_back")), T.words(plain)
    drift = (T.jaccard(words(plain), words(F.col("_back"))) < L.BACK_OVERLAP) | F.exists("names", lambda n: F.array_contains(want, n) & ~F.array_contains(have, n))
    rows = replace(r.withColumn("_drift", F.col("_back").isNotNull() & drift), F.col("_drift"), by.repairer)
    # reread, windows, and the last choice
    rows = replace(rows, of_current["n"] > 0, by.reader)
    w = Window.partitionBy("book_id", "chapter").orderBy("chunk_idx", "chunk_id")
    rows = shared_table(rows.withColumn("pos", F.row_number().over(w) - 1), "literary")
    forget(second)
    at = ["book_id", "chapter", "pos"]
    rows = rows.join(window_answers(rows.select(*at, "current"), at[:2], "pos", by.window), at, "left").withColumn("_of_new", F.when(new != cur, marked))
    rows = taken(rows, judged(of_current, of_new))
    safe = best(F.array(option(cur, of_current, 0), option(d, of_draft, 1)), others(2))
    return rows.withColumn("final", F.coalesce(safe["text"], cur)).select(*(dict.fromkeys([*kept, "final"])))


def _checks(rules: list[Row]):
    """All checks of a column of rows with names, who and _rules, the rules of the glossary that their source meets."""
    g = lambda c: memory.glossary_column(rules, None, T.strip_markers(F.coalesce(c, F.lit(""))), F.col("_rules"))
    return lambda c: Q.all_flags(F.col("source"), F.col("draft"), c, F.col("names"), g(c), F.col("who"))


def window_answers(rows: DataFrame, keys: list[str], pos: str, model: models.Model, size: int = 5, stride: int = 3) -> DataFrame:
    """(keys, pos, _new): hop windows go to the model as JSON and come back as JSON, of which the valid ones count.

    rows: (keys, pos from 0, current). Where windows overlap, the first that is valid holds.
    """
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    w = windows.window_rows(windows.hop_windows(n, keys, "n", size, stride), rows, keys, pos)
    item = F.struct(F.col(pos).cast("int").alias("index"), F.col("current").alias("translation"))
    g = w.groupBy(*keys, "start").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("request", F.to_json("items"))
    p = models.infer(g, [*keys, "start", "items"], "request", model).withColumn("parsed", models.window_json(F.element_at("outputs", 1)))
    p = p.where(models.window_valid(F.col("parsed"), F.transform("items", lambda x: x["index"])))
    e = p.select(*keys, "start", F.explode("parsed").alias("x")).select(*keys, "start", F.col("x.index").alias(pos), F.col("x.translation").alias("new"))
    return e.groupBy(*keys, pos).agg(F.min_by("new", "start").alias("_new"))


def revise_windows(rows: DataFrame, keys: list[str], pos: str, model: models.Model, size: int = 5, stride: int = 3) -> DataFrame:
    """(keys, pos, current): valid answers for windows replace what they may.

    rows: (keys, pos from 0, source, draft, current).
    """
    j = rows.join(window_answers(rows, keys, pos, model, size, stride), [*keys, pos], "left")
    fb, fn = (Q.all_flags(F.col("source"), F.col("draft"), F.col(c)) for c in ("current", "_new"))
    ok = Q.accepted(Q.hard_flags(fb), Q.score10(F.col("source"), F.col("current"), fb), Q.hard_flags(fn), Q.score10(F.col("source"), F.col("_new"), fn))
    return j.select(*keys, pos, F.when(F.col("_new").isNotNull() & ok, F.col("_new")).otherwise(F.col("current")).alias("current"))


def translate_books(books: DataFrame, model: models.Model, out: str) -> DataFrame:
    """(book_id, file, n_bytes): every numbered chapter of the books, translated and written under out."""
    chapters = books.where(epub.numbered_chapter(F.col("name"), F.col("content")))
    keys = ["book_id", "chapter", "chunk_idx"]
    c = chunks_of(epub.units(chapters))
    spark = books.sparkSession
    empty = spark.createDataFrame([], "namespace string, key string, value string")
    done = spark.createDataFrame([], "book_id string, chapter string, chunk_idx int, translation string")
    drafted, _ = draft(c, keys, model, empty, done)
    meta = books.select("book_id", "title", "author").distinct()
    b = drafted.join(meta, "book_id").select("book_id", "title", "author", F.lit("fr").alias("language"), "chapter", F.col("chunk_idx").alias("pos"), "tag", F.col("draft").alias("text"), "markers")
    return epub.write(b, out)
