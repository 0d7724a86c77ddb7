"""Characters and dialogue: mentions, relations, style hints and the ordered fold over a chapter's chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..runtime import ordered_fold


def canonical(names: DataFrame, aliases: DataFrame, column: str = "name") -> DataFrame:
    """names with the canonical form of column, itself where there is none. aliases: (alias, canonical)."""
    a = aliases.select(F.col("alias").alias(column), "canonical")
    return names.join(a, column, "left").withColumn("canonical", F.coalesce("canonical", column))


def relation_of(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """pairs (a, b) with the type of their relation, '' where there is none. relations: (a, b, type)."""
    return pairs.join(relations.select("a", "b", "type"), ["a", "b"], "left").na.fill("", ["type"])


def intimate_pairs(relations: DataFrame) -> DataFrame:
    """Unordered distinct (first, second) of intimate partners."""
    r = relations.where("type = 'intimate_partner'")
    return r.select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second")).distinct()


def mentions(chunks: DataFrame, keys: list[str], text_col: str, aliases: DataFrame) -> DataFrame:
    """(keys, canonical, ord): characters whose alias occurs as whole words, each once, in the aliases' order.

    One-word aliases are an equi-join on the chunk's distinct words, so a large alias table is no theta join;
    longer ones join on their first word and are then matched in full.
    """
    tokens = T.words(T.strip_markers(F.col(text_col)))
    exploded = chunks.select(*keys, F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).alias("_line"), F.explode(F.array_distinct(tokens)).alias("_word"))
    w = T.words(F.col("alias"))
    a = aliases.select("ord", "canonical", F.element_at(w, 1).alias("_word"), F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).alias("_alias"))
    found = exploded.join(a, "_word").where(F.contains(F.col("_line"), F.col("_alias")))
    return found.groupBy(*keys, "canonical").agg(F.min("ord").alias("ord"))


def style_hints(source: Column, register_hint: Column, has_alias: Column) -> Column:
    """Ordered hints of a chunk."""
    from ..functions.quality import past_narration

    s = T.strip_markers(F.coalesce(source, F.lit("")))
    return F.array_compact(
        F.array(
            F.when(T.has_speech(s), F.lit("dialogue")),
            F.when(register_hint == "informal", F.lit("informal_dialogue_required")),
            F.when(register_hint == "plural_or_formal_allowed", F.lit("plural_or_formal_allowed")),
            F.when(past_narration(s), F.lit("past_narration")),
            F.when(has_alias, F.lit("preserve_address_names")),
            F.when(F.contains(s, F.lit("?")), F.lit("preserve_question")),
        )
    )


def register_fallback(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """chunks with the register remembered for speaker and addressee, or for the reverse, where none is known.

    Only chunks with both characters, addressing someone as you, but not several. edges: (speaker, addressee, hint).
    """
    known = edges.where(F.col("hint").isin("informal", "plural_or_formal_allowed"))
    there = known.select("speaker", "addressee", F.col("hint").alias("_there"))
    back = known.select(F.col("speaker").alias("addressee"), F.col("addressee").alias("speaker"), F.col("hint").alias("_back"))
    s = T.strip_markers(F.coalesce("source", F.lit("")))
    free = (F.coalesce("register_hint", F.lit("")) == "") & (F.col("speaker") != "") & (F.col("addressee") != "")
    free = free & T.has_phrase(s, L.SECOND_PERSON) & ~T.has_phrase(s, L.PLURAL_OR_FORMAL)
    out = chunks.join(there, ["speaker", "addressee"], "left").join(back, ["speaker", "addressee"], "left")
    return out.withColumn("register_hint", F.when(free, F.coalesce("_there", "_back", F.lit(""))).otherwise(F.coalesce("register_hint", F.lit("")))).drop("_there", "_back")


class Cast:
    """The characters that a fold works with: aliases in order, and relations of canonical names."""

    def __init__(self, aliases: list[tuple[str, str]], relations: list[tuple[str, str, str]]) -> None:
        self.aliases = aliases
        self.type = {(a, b): t for a, b, t in relations}
        self.partner: dict[str, str] = {}
        for a, b, t in relations:
            if t == "intimate_partner":
                self.partner.setdefault(a, b)
        self.intimate = {x for (a, b), t in self.type.items() if t == "intimate_partner" for x in (a, b)}
        bound = lambda x: rf"\b{re.escape(x)}\b"
        verbs = rf"\b(?:{L.SPEECH_VERBS})\b"
        self.named = [(re.compile(bound(a)), a, c) for a, c in aliases]
        self.speaks = [(re.compile(rf"{bound(a)}[^.\n]{{0,80}}{verbs}|{verbs}[^.\n]{{0,80}}{bound(a)}", re.I), c) for a, c in aliases]


_QUOTES = re.compile(r'"[^"]*"|“[^”]*”|«[^»]*»')
_SPEECH = re.compile(r"[\"“”«»]")
_YOU = re.compile(rf"\b(?:{L.SECOND_PERSON})\b", re.I)
_PLURAL = re.compile(rf"\b(?:{L.PLURAL_OR_FORMAL})\b", re.I)
_MARKER = re.compile(T.MARKER)


def _distinct(values: list[str]) -> list[str]:
    return [x for x in dict.fromkeys(values) if x]


def fold_chapter(rows: Iterable[tuple[int, str]], cast: Cast) -> Iterator[tuple[int, str, str, str, list[str], list[str]]]:
    """(idx, speaker, addressee, register, mentions, participants) of the chunks of a chapter in order.

    State: the last intimate speaker and the last four participants.
    """
    last, recent = "", []
    everyone = sorted(cast.intimate)
    other = lambda who, among: next((p for p in among if p != who), cast.partner.get(who, ""))
    for idx, source in rows:
        text = _MARKER.sub("", source or "")
        speech = bool(_SPEECH.search(text))
        told = _QUOTES.sub(" ", text)
        found = _distinct([c for p, _, c in cast.named if p.search(text)])
        if found:
            recent = _distinct(found + recent)[:4]
        attributed = next((c for p, c in cast.speaks if p.search(told)), "")
        speaker = attributed
        if not speaker and speech:
            if len(found) == 1 and found[0] in cast.intimate:
                speaker = other(found[0], everyone)
            elif last in cast.intimate:
                speaker = other(last, everyone)
            elif len(recent) == 2:
                speaker = recent[0]
        addressee = ""
        if speaker:
            addressee = next((c for p, _, c in cast.named if c != speaker and p.search(text)), "")
            if not addressee and speech:
                addressee = cast.partner.get(speaker, "")
        if not addressee and speech:
            addressee = next((c for p, a, c in cast.named if a != c and p.search(text)), "")
        if speaker in cast.intimate:
            last = speaker
        elif speech and not speaker and last:
            addressee = cast.partner.get(last, "") or addressee
        if speaker and not addressee and speech:
            addressee = other(speaker, recent)
        close = cast.type.get((speaker, addressee)) == "intimate_partner" or {speaker, addressee} <= cast.intimate
        addressed = speech and _YOU.search(text) and not (attributed and attributed not in cast.intimate)
        register = ""
        if _PLURAL.search(text):
            register = "plural_or_formal_allowed"
        elif addressed or speech and close:
            register = "informal"
        yield idx, speaker, addressee, register, found, _distinct([*found, speaker, addressee, *recent])[:4]


FOLD_SCHEMA = "doc string, idx bigint, speaker string, addressee string, register string, mentions array<string>, participants array<string>"


def dialogue_fold(chunks: DataFrame, cast: Cast) -> DataFrame:
    """The fold of every chapter, as a stream in order. chunks: (doc, idx, source).

    The state depends on all earlier chunks of a chapter, so a chapter is folded in one task, but its chunks are
    never held together. Empty and null sources are chunks without mention or speech.
    """
    slim = chunks.select(F.col("doc").cast("string").alias("doc"), F.col("idx").cast("bigint").alias("idx"), "source")
    return ordered_fold(slim, ["doc"], ["idx"], lambda key, rows: ((*key, *r) for r in fold_chapter(rows, cast)), FOLD_SCHEMA)


def dialogue_edges(folded: DataFrame) -> DataFrame:
    """Who speaks to whom, in which register."""
    named = lambda c, d: F.when(F.col(c) == "", F.lit(d)).otherwise(F.col(c)).alias(c)
    e = folded.where("speaker <> '' or addressee <> ''")
    return e.select("doc", "idx", named("speaker", "unknown"), named("addressee", "unknown"), named("register", "default"))


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by the order; rows of a hot key are reduced before they are shuffled."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


