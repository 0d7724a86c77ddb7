"""Texts that carry a chapter's or a book's state into a prompt: memos, summaries, notes, hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import profile

# Answers by which a critic says that nothing is wrong.
OK_MARKERS = ("ok", "okay", "no issues", "no issue", "none", "aucun problème", "rien à signaler", "rien")


def critique_is_ok(c: Column) -> Column:
    """The critique is empty, one of the markers, or begins with one and a full stop."""
    t = F.lower(T.strip(F.coalesce(c, F.lit(""))))
    bare = F.regexp_replace(t, r"[.!\s]+$", "")
    starts = F.lit(False)
    for m in OK_MARKERS:
        starts = starts | F.startswith(t, F.lit(m + "."))
    return (t == "") | bare.isin(*OK_MARKERS) | starts


def chapter_memo(chunks: DataFrame, names: DataFrame, terms: DataFrame, most_names: int = 20, most_lines: int = 24) -> DataFrame:
    """(book_id, chapter, memo): names to keep, glossary and the first lines of the dialogue state, in the order of chunks.

    chunks: (book_id, chapter, chunk_idx, speaker, addressee, register_hint); names: (book, name, n, rank); terms:
    (book, term, preferred). Arrays are cut to the sizes a prompt takes.
    """
    said = chunks.where("coalesce(speaker, '') <> '' or coalesce(addressee, '') <> '' or coalesce(register_hint, '') <> ''")
    or_ = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    line = F.concat(F.lit("- "), F.col("chunk_idx").cast("string"), F.lit(": speaker="), or_("speaker", "unknown"), F.lit(", addressee="), or_("addressee", "unknown"), F.lit(", register="), or_("register_hint", "default"))
    state = said.where(F.col("chunk_idx").isNotNull()).groupBy("book_id", "chapter").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", line.alias("line")))).alias("s"))
    state = state.select("book_id", "chapter", F.transform(F.slice("s", 1, most_lines), lambda x: x["line"]).alias("state"))
    kept = names.where((F.col("n") >= 2) & (F.col("rank") <= most_names)).groupBy(F.col("book").alias("book_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("k"))
    known = terms.groupBy(F.col("book").alias("book_id")).agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), "term", F.lit(" -> "), "preferred"))).alias("t"))
    c = chunks.select("book_id", "chapter").distinct().join(kept, "book_id", "left").join(known, "book_id", "left").join(state, ["book_id", "chapter"], "left")
    memo = F.concat_ws(
        "\n",
        F.concat(F.lit("Chapter: "), "chapter"),
        F.when(F.col("k").isNotNull(), F.concat(F.lit("Names to keep unchanged: "), F.array_join(F.transform("k", lambda x: x["name"]), ", "))),
        F.when(F.col("t").isNotNull(), F.concat(F.lit("Glossary:\n"), F.array_join("t", "\n"))),
        F.when(F.col("state").isNotNull(), F.concat(F.lit("Dialogue state:\n"), F.array_join("state", "\n"))),
    )
    return c.select("book_id", "chapter", memo.alias("memo"))


def book_summary(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """(book_id, summary): a book's glossary with counts and its registers, sorted. terms: (book_id, term, preferred, count)."""
    g = terms.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "term", F.lit(" -> "), "preferred", F.lit(" (seen "), F.col("count").cast("string"), F.lit(")")))), "\n").alias("g"))
    r = edges.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "speaker", F.lit("->"), "addressee", F.lit(": "), "hint"))), "\n").alias("r"))
    j = g.join(r, "book_id", "full")
    part = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(title + "\n"), c))
    return j.select("book_id", F.concat_ws("\n", F.lit("Book memory:"), part("Glossary:", "g"), part("Registers:", "r")).alias("summary"))


def dialogue_registers(relations: DataFrame) -> DataFrame:
    """relations with register: informal between partners, friends and acquaintances, else formal."""
    return relations.withColumn("register", F.when(F.col("type").isin("intimate_partner", "friends", "acquaintance"), "informal").otherwise("formal"))


def style_notes(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(book, notes): point of view, tense, partners and domains in one line."""
    pov = F.when(F.col("pov") == "first_person", "First-person").otherwise("Third-person")
    pairs = profile.relationships(blocks, names).where("type = 'intimate_partner' and a < b")
    pairs = pairs.groupBy("book").agg(F.array_sort(F.collect_list(F.concat("a", F.lit(" and "), "b", F.lit(" are intimate partners.")))).alias("p"))
    doms = profile.domains(blocks).groupBy("book").agg(F.array_sort(F.collect_list(F.concat(F.lit("Domain: "), "domain", F.lit(".")))).alias("d"))
    base = profile.point_of_view(blocks).join(profile.tense(blocks), "book").join(pairs, "book", "left").join(doms, "book", "left")
    head = F.concat(pov, F.lit(" narrative, "), "tense", F.lit("-tense."))
    return base.select("book", F.concat_ws(" ", head, F.array_join("p", " "), F.array_join("d", " ")).alias("notes"))


def merged_memos(old: DataFrame, new: DataFrame, key: str, most_words: int = 400) -> DataFrame:
    """(key, memo): a remembered memo followed by the new one, cut to the first words."""
    j = old.select(key, F.col("memo").alias("_o")).join(new.select(key, F.col("memo").alias("_n")), key, "full")
    return j.select(key, T.first_words(F.concat_ws(" ", "_o", "_n"), most_words).alias("memo"))


def word_relations(words: DataFrame, dimension: DataFrame) -> DataFrame:
    """(word, hint): related words of a static dimension (word, relation, other), in place of a remote service."""
    r = dimension.groupBy("word").agg(F.array_join(F.array_sort(F.collect_set(F.concat("relation", F.lit(": "), "other"))), "; ").alias("hint"))
    return words.join(r, "word", "left").select("word", F.coalesce("hint", F.lit("")).alias("hint"))
