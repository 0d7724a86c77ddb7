"""Lexicon-based semantics of a text as column expressions: emotions, sentiment, speech acts, aspect, discourse, dominance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from . import text as T


def emotion_hits(c: Column, emotion: str) -> Column:
    """Words of three or more letters that carry the emotion, with multiplicity."""
    return F.size(F.filter(T.ascii_words(F.coalesce(c, F.lit("")), 3), lambda w: w.isin(*L.EMOTIONS[emotion].split())))


def emotion_counts(c: Column) -> Column:
    return F.create_map(*(x for e in L.EMOTIONS for x in (F.lit(e), emotion_hits(c, e))))


def emotion_scores(c: Column, most: int = 4) -> Column:
    """An array of (emotion, score) of the emotions hit most, by their share of all hits; ties in the lexicon's order."""
    hits = F.array(*(F.struct((-emotion_hits(c, e)).alias("n"), F.lit(k).alias("k"), F.lit(e).alias("emotion")) for k, e in enumerate(L.EMOTIONS)))
    found = F.array_sort(F.filter(hits, lambda x: x["n"] < 0))

    def scores(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0), lambda acc, x: acc - x["n"])
        return F.transform(F.slice(a, 1, most), lambda x: F.struct(x["emotion"].alias("emotion"), F.round(-x["n"] / total, 3).alias("score")))

    return T.let(found, scores)


def polarity(c: Column, emotions: tuple[str, ...]) -> Column:
    listed = {w for e in emotions for w in L.EMOTIONS[e].split()}
    return F.size(F.filter(T.ascii_words(F.coalesce(c, F.lit("")), 3), lambda w: w.isin(*sorted(listed))))


def sentiment(c: Column) -> Column:
    """(positive - negative) / words * 10; 0 without words."""
    n = F.size(T.ascii_words(F.coalesce(c, F.lit("")), 3))
    return F.when(n == 0, 0.0).otherwise((polarity(c, L.POSITIVE) - polarity(c, L.NEGATIVE)) / n * 10)


def speech_acts(c: Column) -> Column:
    """Acts whose pattern occurs, in order; assertion only if it is the only one."""
    acts = F.array_compact(
        F.array(*(F.when(c.rlike(p) if p in (r"\?", "!") else T.has_phrase(c, p), F.lit(a)) for a, p in L.SPEECH_ACTS.items()))
    )
    return F.when(F.size(acts) > 1, F.array_remove(acts, "assertion")).otherwise(acts)


def politeness(c: Column) -> Column:
    formal, informal = T.has_phrase(c, L.FORMAL_POLITENESS), T.has_phrase(c, L.INFORMAL_POLITENESS)
    return F.when(formal & ~informal, "formal").when(informal & ~formal, "informal").otherwise("neutral")


def entity_salience(c: Column, names: list[str]) -> Column:
    """Names that occur as whole words, without case, by their first place."""
    at = lambda n: F.regexp_instr(c, F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}_]){n}(?![\p{{L}}\p{{N}}_])"))
    found = F.array(*(F.struct(at(n).alias("at"), F.lit(n).alias("name")) for n in names))
    return F.transform(F.array_sort(F.filter(found, lambda x: x["at"] > 0)), lambda x: x["name"])


def past_verbs(c: Column) -> Column:
    """Words that look like past forms: ending in ed or t, or one of the strong ones."""
    return F.filter(T.ascii_words(F.coalesce(c, F.lit("")), 2), lambda w: w.rlike("^[a-z]+(?:ed|t)$") | w.isin(*L.STRONG_PAST))


def _in_class(w: Column, name: str) -> Column:
    return w.isin(*L.ASPECTS[name].split())


def infinitive(w: Column) -> Column:
    """Best guess of the infinitive of a lower-cased past form."""
    irregular = F.create_map(*(F.lit(x) for kv in L.IRREGULAR_PAST.items() for x in kv))
    stem = F.regexp_replace(w, "ed$", "")
    doubled = stem.rlike(r"([^aeiou])\1$")
    silent = F.concat(stem, F.lit("e"))
    known = F.lit(False)
    for name in L.ASPECTS:
        known = known | _in_class(silent, name)
    return (
        F.when(w.isin(*L.IRREGULAR_PAST), F.element_at(irregular, w))
        .when(w.rlike("ied$"), F.regexp_replace(w, "ied$", "y"))
        .when(w.rlike("ed$") & doubled, F.regexp_replace(stem, ".$", ""))
        .when(w.rlike("ed$") & stem.rlike("[^aeiou]$") & known, silent)
        .when(w.rlike("ed$"), stem)
        .otherwise(w)
    )


def aspect(w: Column) -> Column:
    """state, achievement, accomplishment, activity or unknown, of a lower-cased past form."""
    v = infinitive(w)
    out = F.lit("unknown")
    for name in reversed(L.ASPECTS):
        out = F.when(_in_class(v, name), name).otherwise(out)
    return out


def tense_hints(c: Column) -> Column:
    """The first three distinct verb (class) pairs."""
    hints = F.transform(past_verbs(c), lambda w: F.struct(infinitive(w).alias("verb"), aspect(w).alias("aspect")))
    named = F.transform(F.filter(hints, lambda h: h["aspect"] != "unknown"), lambda h: F.concat(h["verb"], F.lit(" ("), h["aspect"], F.lit(")")))
    return F.slice(F.array_distinct(named), 1, 3)


def narration(c: Column) -> Column:
    """The text with quotations, of straight marks and guillemets, left out."""
    return F.regexp_replace(c, '["«][^"»]*["»]', " ")


def fid_signals(c: Column) -> Column:
    t = narration(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(n)) for n, _, p in L.FID_SIGNALS)))


def fid_raw(c: Column) -> Column:
    """Sum of the weights of the signals of free indirect discourse; the score is a share of 8, 1 at most."""
    t = narration(F.coalesce(c, F.lit("")))
    return sum((F.when(t.rlike(p), w).otherwise(0) for _, w, p in L.FID_SIGNALS), F.lit(0))


def fid_score(c: Column) -> Column:
    return F.least(fid_raw(c) / 8, F.lit(1.0))


def dominance_parts(c: Column) -> tuple[Column, Column]:
    """(high, low): dominant words and twice the imperatives; deferent words and twice the hedges."""
    t = F.coalesce(c, F.lit(""))
    w = T.ascii_words(t, 1)
    high = F.size(F.filter(w, lambda x: x.isin(*L.DOMINANT))) + 2 * F.regexp_count(t, F.lit(L.IMPERATIVES))
    low = F.size(F.filter(w, lambda x: x.isin(*L.DEFERENT))) + 2 * F.regexp_count(t, F.lit(L.HEDGES))
    return high, low


def dominance(c: Column) -> Column:
    high, low = dominance_parts(c)
    return (high - low) / F.greatest(high + low, F.lit(1))


def formality4(c: Column) -> Column:
    """Four times the formality of a text: distinct formal words less informal ones, within -4..4."""
    w = F.array_distinct(T.spaced(F.lower(F.coalesce(c, F.lit("")))))
    informal = F.size(F.filter(w, lambda x: x.isin(*L.INFORMAL_WORDS)))
    formal = F.size(F.filter(w, lambda x: x.isin(*[y for y in L.FORMAL_WORDS if y not in L.INFORMAL_WORDS])))
    return F.greatest(F.lit(-4), F.least(F.lit(4), formal - informal))


def register(c: Column) -> Column:
    s = formality4(c)
    return F.when(s < -2, "informal").when(s > 2, "formal").otherwise("mixed")


def hint_text(c: Column) -> Column:
    """What a rewriter is told of a text: discourse, dominance and tense, joined by ' | '."""
    fid, dom = fid_score(c), dominance(c)
    level = F.when(fid < 0.4, F.lit(None)).when(fid < 0.6, "possible").when(fid < 0.8, "likely").otherwise("strong")
    return F.concat_ws(
        " | ",
        F.when(level.isNotNull(), F.concat(F.lit("free indirect discourse: "), level)),
        F.when(dom > 0.4, "high dominance").when(dom < -0.4, "low dominance"),
        F.nullif(F.array_join(tense_hints(c), ", "), F.lit("")),
    )
