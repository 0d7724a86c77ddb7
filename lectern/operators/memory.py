"""Memories and caches: content-addressed results, corrections, book state, entity forms, checkpoints."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..runtime import shared_table
from .dialogue import last_by

MAX_RULES = 2000  # glossary rules that are applied at once
CACHE_SCHEMA = "namespace string, key string, value string, created_at timestamp"


def hits(requests: DataFrame, cache: DataFrame, on: list[str]) -> DataFrame:
    return requests.join(cache.select(*on), on, "left_semi")


def misses(requests: DataFrame, cache: DataFrame, on: list[str]) -> DataFrame:
    return requests.join(cache.select(*on), on, "left_anti")


def memoised(requests: DataFrame, cache: DataFrame, namespace: str, key: Column, call: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, new): requests with value, from the cache or from call; and the rows to append to the cache.

    call takes distinct (key, and request columns) rows that the cache lacks and returns (key, value). Equal
    requests are called once, and what call returned is written once, so that answers and new rows are the same. Of
    several cached values of a key the one created last holds, the greatest where none has a time.
    """
    keyed = requests.withColumn("key", key)
    created = F.col("created_at") if "created_at" in cache.columns else F.lit(None).cast("timestamp")
    known = cache.where(F.col("namespace") == namespace).groupBy("key").agg(F.max_by("value", F.struct(F.coalesce(created, F.lit(0).cast("timestamp")), F.col("value"))).alias("value"))
    lacking = misses(keyed, known, ["key"]).dropDuplicates(["key"])
    made = shared_table(call(lacking).select("key", "value"), "made")
    answers = keyed.join(known.unionByName(made), "key", "left")
    new = made.select(F.lit(namespace).alias("namespace"), "key", "value", F.current_timestamp().alias("created_at"))
    return answers, new


def complete_groups(cached: DataFrame, sources: DataFrame, group: str) -> DataFrame:
    """Groups of the cache whose count of outputs is that of their sources, none of them null."""
    c = cached.groupBy(group).agg(F.count("*").alias("n"), F.count("output").alias("m"))
    s = sources.groupBy(group).agg(F.count("*").alias("want"))
    return c.join(s, group).where("n = want and m = want").select(group)


def last_checkpoint(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The line last logged for every key holds. Later logged wins, then the higher id."""
    return last_by(lines, keys, order)


def newest(memory: DataFrame, seq: str, most: int = L.MEMORY_ENTRIES) -> DataFrame:
    """The newest entries with a source and a final text."""
    return memory.where("source <> '' and final <> ''").orderBy(F.col(seq).desc()).limit(most)


def new_corrections(records: DataFrame, memory: DataFrame, order: str) -> DataFrame:
    """records to append to the memory: changed, without flags, not there yet; the first of equal ones.

    Equality is of source, draft and final together, by content key.
    """
    changed = (F.coalesce("final", F.lit("")) != "") & (F.coalesce("final", F.lit("")) != F.coalesce("draft", F.lit("")))
    k = T.content_key(F.col("source"), F.col("draft"), F.col("final"))
    r = records.where(changed & (F.size(F.coalesce("flags", F.array().cast("array<string>"))) == 0)).withColumn("key", k)
    rest = [c for c in r.columns if c != "key"]
    one = r.groupBy("key").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row")).select("key", "_row.*")
    return misses(one, memory.select(k.alias("key")), ["key"])


def book_state(chunks: DataFrame, book: str, order: list[str]) -> dict[str, DataFrame]:
    """What a book's memory gains from chunks: character counts, last registers by speaker and addressee, chapters."""
    mentions = chunks.select(book, F.explode("mentioned").alias("character")).where("character <> ''")
    characters = mentions.groupBy(book, "character").agg(F.count("*").alias("count"))
    said = chunks.where("speaker <> '' and addressee <> '' and register_hint <> ''").select(book, "speaker", "addressee", "register_hint", *order)
    edges = last_by(said, [book, "speaker", "addressee"], order).select(book, "speaker", "addressee", F.col("register_hint").alias("hint"))
    return {"characters": characters, "register_edges": edges, "chapters": chunks.select(book, "chapter").distinct()}


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """Counts of both, added."""
    return old.select(*keys, count).unionByName(new.select(*keys, count)).groupBy(*keys).agg(F.sum(count).alias(count))


def merge_last(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows of their keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def left_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left, and of right what left doesn't have."""
    return left.unionByName(right.join(left.select(key), key, "left_anti"))


def entity_forms(chunks: DataFrame, entities: DataFrame, source: str, target: str) -> DataFrame:
    """(entity, n): chunks whose source has the entity as whole words, without case, and whose target keeps its form.

    entities: (entity). A chunk's distinct words meet the entities' first words as numbers and digests; texts, which
    would be repeated for every word, meet only the entities that begin with one of their words.
    """
    w = lambda c: T.words(F.coalesce(F.col(c), F.lit("")))
    spaced = lambda c: F.lower(F.concat(F.lit(" "), F.array_join(w(c), " "), F.lit(" ")))
    # numbers that are written once hold for both uses
    c = shared_table(chunks.select(F.monotonically_increasing_id().alias("_k"), spaced(source).alias("_s"), F.coalesce(F.col(target), F.lit("")).alias("_t")), "entity-texts")
    e = entities.select("entity", spaced("entity").alias("_e")).where("_e <> '  '").withColumn("_w", F.xxhash64(F.element_at(F.split("_e", " "), 2)))
    words = c.select("_k", F.explode(F.array_distinct(F.transform(F.filter(F.split("_s", " "), lambda x: x != ""), lambda x: F.xxhash64(x)))).alias("_w"))
    met = words.join(e, "_w").select("_k", "entity", "_e")
    j = met.join(c, "_k").where(F.contains("_s", "_e") & F.contains("_t", "entity"))
    return j.groupBy("entity").agg(F.count("*").alias("n"))


def best_form(forms: DataFrame) -> DataFrame:
    """(entity, form, n, n_forms) of each entity's most frequent form; ties by form. forms: (entity, form, n)."""
    f = forms.groupBy("entity", "form").agg(F.sum("n").alias("n"))
    g = f.groupBy("entity").agg(F.min_by(F.struct("form", "n"), F.struct(-F.col("n"), F.col("form"))).alias("x"), F.count("*").alias("n_forms"))
    return g.select("entity", "x.*", "n_forms")


def glossary_flags(pairs: DataFrame, keys: list[str], rules: DataFrame, source: str, target: str) -> DataFrame:
    """(keys, flag): glossary_missing_TERM if a rule's source matches and no preferred form does; glossary_forbidden_TERM
    if a forbidden one does. rules: (term, source, preferred, forbidden), arrays of regular expressions.

    Rules are a small dimension of at most MAX_RULES, which is checked; they become one array of literal patterns.
    """
    src, tgt = T.strip_markers(F.coalesce(F.col(source), F.lit(""))), T.strip_markers(F.coalesce(F.col(target), F.lit("")))
    p = pairs.select(*keys, src.alias("_src"), tgt.alias("_tgt"))
    return p.select(*keys, F.explode(glossary_column(rules, F.col("_src"), F.col("_tgt"))).alias("flag"))


def glossary_rules(rules: DataFrame) -> list[Row]:
    """The rules, read once for every glossary_column that uses them."""
    rows = rules.select("term", "source", "preferred", "forbidden").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} glossary rules: pass them in parts")
    return rows


def _any_of(c: Column, patterns: list[str]) -> Column:
    """Patterns are literals, so each is compiled once a task."""
    return c.rlike("(?i)(?:" + "|".join(patterns) + ")")


def glossary_here(rules: list[Row], source: Column) -> Column:
    """Numbers of the rules whose source matches, for glossary_column where many texts are checked against one source."""
    here = [F.when(_any_of(source, r.source), F.lit(k)) for k, r in enumerate(rules) if r.source and r.term is not None]
    return F.array_compact(F.array(*here)) if here else F.array().cast("array<int>")


def glossary_column(rules: DataFrame | list[Row], source: Column | None, target: Column, known: Column | None = None) -> Column:
    """The flags of glossary_flags as an array, of two texts without markers.

    rules: a table, or glossary_rules of it. known: glossary_here of the source, which then isn't needed.
    """
    rows = rules if isinstance(rules, list) else glossary_rules(rules)
    slug = lambda t: re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", t.lower()))[:80]

    def flags(x: Column) -> Column:
        out = []
        for k, r in enumerate(rows):
            if not r.source or r.term is None:
                continue
            here = _any_of(x["s"], r.source) if known is None else F.array_contains(x["s"], k)
            if r.preferred:
                out.append(F.when(here & ~_any_of(x["t"], r.preferred), F.lit(f"glossary_missing_{slug(r.term)}")))
            if r.forbidden:
                out.append(F.when(here & _any_of(x["t"], r.forbidden), F.lit(f"glossary_forbidden_{slug(r.term)}")))
        return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")

    return T.let(F.struct((source if known is None else known).alias("s"), target.alias("t")), flags)
