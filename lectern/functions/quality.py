"""Flags, scores and acceptance of candidate texts, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from . import text as T


def english_hits(source: Column, candidate: Column) -> Column:
    """English marker tokens of the candidate, with multiplicity, that the source doesn't have."""
    here = T.word_tokens(source)
    return F.size(F.filter(T.word_tokens(candidate), lambda w: w.isin(*L.ENGLISH_MARKERS) & ~F.array_contains(here, w)))


def french_hits(candidate: Column) -> Column:
    return F.size(F.filter(T.word_tokens(candidate), lambda w: w.isin(*L.FRENCH_MARKERS)))


def marker_ids(source: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r"\[\[(ZX[A-Z]+[0-9]+X)\]\]"), F.lit(1)))


def missing_markers(source: Column, candidate: Column) -> Column:
    """Marker ids whose opening or closing token the candidate lacks."""
    return F.filter(
        marker_ids(source),
        lambda m: ~F.contains(candidate, F.concat(F.lit("[["), m, F.lit("]]"))) | ~F.contains(candidate, F.concat(F.lit("[[/"), m, F.lit("]]"))),
    )


def base_flags(source: Column, draft: Column, candidate: Column, names: Column | None = None) -> Column:
    """empty, prompt_leak, english_heavy, length_ratio, missing_inline_markers, ascii_dialogue_quotes, missing_name_X.

    Nulls count as empty texts. names: the names that must be kept, as an array.
    """
    source, draft, candidate = (F.coalesce(c, F.lit("")) for c in (source, draft, candidate))
    # each part is computed once and bound, however often the flags use it
    part = F.struct(source.alias("s"), F.length(T.strip(draft)).alias("d"), T.strip(candidate).alias("t"), T.word_tokens(source).alias("st"), T.word_tokens(T.strip(candidate)).alias("ct"))

    def flags_of(x: Column) -> Column:
        t = x["t"]
        leak = F.lit(False)
        for m in L.PROMPT_LEAKS:
            leak = leak | F.contains(F.lower(t), F.lit(m.lower()))
        base = F.greatest(x["d"], F.length(T.strip(x["s"])), F.lit(1))
        # ratio > 2.2 or < .35, in integers
        ratio = (base > 40) & ((F.length(t) * 10 > base * 22) | (F.length(t) * 100 < base * 35))
        en = F.size(F.filter(x["ct"], lambda w: w.isin(*L.ENGLISH_MARKERS) & ~F.array_contains(x["st"], w)))
        fr = F.size(F.filter(x["ct"], lambda w: w.isin(*L.FRENCH_MARKERS)))
        return F.array_compact(
            F.array(
                F.when(t == "", F.lit("empty")),
                F.when(leak, F.lit("prompt_leak")),
                F.when((en >= 4) & (en > fr), F.lit("english_heavy")),
                F.when(ratio, F.lit("length_ratio")),
                F.when(F.size(missing_markers(x["s"], t)) > 0, F.lit("missing_inline_markers")),
                F.when(T.has_speech(x["s"]) & F.contains(t, F.lit('"')), F.lit("ascii_dialogue_quotes")),
            )
        )

    flags = T.let(part, flags_of)
    if names is None:
        return flags
    both = F.struct(T.words(source).alias("want"), T.words(T.strip(candidate)).alias("have"))
    lost = T.let(both, lambda x: F.filter(names, lambda n: F.array_contains(x["want"], n) & ~F.array_contains(x["have"], n)))
    return F.concat(flags, F.transform(lost, lambda n: F.concat(F.lit("missing_name_"), n)))


def past_narration(source: Column) -> Column:
    t = T.strip_markers(source)
    return ~T.has_speech(t) & T.has_phrase(t, L.PAST_NARRATION)


def present_drift(candidate: Column) -> Column:
    return T.strip_markers(candidate).rlike(rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:ils?|elles?)\s+(?:{L.PRESENT_DRIFT})(?:$|[^\p{{L}}\p{{N}}_])")


def style_flags(source: Column, candidate: Column) -> Column:
    """What dialogue, question marks and past narration of the source lost in the candidate."""
    s, t = T.strip_markers(F.coalesce(source, F.lit(""))), T.strip_markers(F.coalesce(candidate, F.lit("")))
    return F.array_compact(
        F.array(
            F.when(T.has_speech(s) & ~t.rlike(r"(?:^|\s)(?:[\"«»]|[-–—]\s)"), F.lit("dialogue_punctuation_lost")),
            F.when(F.contains(s, F.lit("?")) & ~F.contains(t, F.lit("?")), F.lit("question_punctuation_lost")),
            F.when(past_narration(s) & present_drift(t), F.lit("tense_present_drift")),
        )
    )


def _line(c: Column) -> Column:
    """The words of a text, each between spaces, so that whole names are found by contains."""
    return F.concat(F.lit(" "), F.array_join(T.words(c), " "), F.lit(" "))


def who(speaker: Column, mentioned: Column, register_hint: Column, cast: Column) -> Column:
    """What the checks of names and register know of a chunk. cast: that of profile.cast."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce(mentioned, none), F.array(speaker)), lambda n: n != ""))).alias("names"),
        F.coalesce(register_hint.isin("informal", "tu"), F.lit(False)).alias("informal"),
        F.coalesce(cast["aliases"], F.array().cast("array<struct<alias:string,canonical:string>>")).alias("aliases"),
        F.coalesce(cast["addresses"], none).alias("addresses"),
        F.coalesce(cast["canonical"], none).alias("canonical"),
    )


def lines(names: Column) -> Column:
    """Each name with its words between spaces."""
    return F.transform(names, lambda n: F.struct(n.alias("name"), _line(n).alias("line")))


def names_here(source: Column, names: Column) -> Column:
    """The names that are words of the source, with or without its markers; the checks look at no others."""
    s = F.coalesce(source, F.lit(""))
    return F.array_intersect(names, F.concat(T.words(s), T.words(T.strip_markers(s))))


def who_here(source: Column, w: Column, addresses: Column) -> Column:
    """who() with the names alone that the checks look at beside this source. addresses: lines() of the cast's."""
    s = T.strip_markers(F.coalesce(source, F.lit("")))

    def of(x: Column) -> Column:
        scene = F.filter(w["names"], lambda n: F.contains(x["s"], n) & F.array_contains(w["canonical"], n))
        named = F.transform(F.filter(addresses, lambda a: F.contains(x["sl"], a["line"])), lambda a: a["name"])
        told = F.when(w["informal"], w["aliases"]).otherwise(F.array().cast("array<struct<alias:string,canonical:string>>"))
        return F.struct(scene.alias("names"), w["informal"].alias("informal"), told.alias("aliases"), F.coalesce(named, F.array().cast("array<string>")).alias("addresses"), scene.alias("canonical"))

    return T.let(F.struct(s.alias("s"), _line(s).alias("sl")), of)


def name_flags(source: Column, candidate: Column, w: Column) -> Column:
    """address_name_lost_X for aliases of the source, canonical names apart, and scene_name_lost_X for the chunk's own characters."""
    s, t = (T.strip_markers(F.coalesce(c, F.lit(""))) for c in (source, candidate))
    part = F.struct(s.alias("s"), _line(s).alias("sl"), _line(t).alias("tl"))

    def flags_of(x: Column) -> Column:
        lost = lambda n: ~F.contains(x["tl"], _line(n))
        address = F.filter(w["addresses"], lambda a: F.contains(x["sl"], _line(a)) & lost(a))
        scene = F.filter(w["names"], lambda n: F.contains(x["s"], n) & F.array_contains(w["canonical"], n) & lost(n))
        named = lambda ns, p: F.transform(ns, lambda n: F.concat(F.lit(p), n))
        return F.concat(named(address, "address_name_lost_"), named(scene, "scene_name_lost_"))

    return T.let(part, flags_of)


def informal_flags(candidate: Column, w: Column, intimate: Column | None = None) -> Column:
    """informal_register_hint_present where an informal chunk's candidate addresses one person as you in English.

    Not if the candidate names a speaker who has no intimate partner; the first alias beside a speech verb is the
    speaker. intimate: the names that have one, none by default.
    """
    t = T.strip_markers(F.coalesce(candidate, F.lit("")))
    told = T.unquoted(F.coalesce(candidate, F.lit("")))
    edge, verbs = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"), rf"(?<![\p{{L}}\p{{N}}_])(?:{L.SPEECH_VERBS})(?![\p{{L}}\p{{N}}_])"

    def speaks(a: Column) -> Column:
        name = F.concat(F.lit(edge[0] + r"\Q"), a["alias"], F.lit(r"\E" + edge[1]))
        return F.rlike(told, F.concat(F.lit("(?i)"), name, F.lit(r"[^.\n]{0,80}" + verbs + "|" + verbs + r"[^.\n]{0,80}"), name))

    speaker = F.get(F.transform(F.filter(w["aliases"], speaks), lambda a: a["canonical"]), 0)
    free = speaker.isNull() if intimate is None else speaker.isNull() | F.array_contains(intimate, speaker)
    hit = w["informal"] & T.has_speech(t) & T.has_phrase(t, L.SECOND_PERSON) & ~T.has_phrase(t, L.PLURAL_OR_FORMAL)
    return F.array_compact(F.array(F.when(hit, F.when(free, F.lit("informal_register_hint_present")))))


def english_leaks(source: Column, candidate: Column) -> Column:
    """Distinct English function words of the candidate, in order, that aren't part of the source."""
    low = F.lower(F.coalesce(source, F.lit("")))
    found = F.array_distinct(T.ascii_words(F.coalesce(candidate, F.lit("")), 2))
    watch = tuple(w for w in L.LEAK_WORDS if w not in L.LEAK_EXEMPT)
    return F.filter(found, lambda w: w.isin(*watch) & ~F.contains(low, w))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.filter(T.words(F.coalesce(c, F.lit(""))), lambda w: w.rlike("^[0-9]+$")))


def new_numbers(source: Column, candidate: Column) -> Column:
    """hallucinated_year:N for 1800..2099, hallucinated_number:N over 9, for numbers that the source lacks; in order of text."""
    extra = F.array_sort(F.array_except(numbers(candidate), numbers(source)))
    year = lambda n: n.rlike(r"^(?:1[89]\d{2}|20\d{2})$")
    kept = F.filter(extra, lambda n: year(n) | n.rlike(r"^0*[1-9]\d+$"))
    return F.transform(kept, lambda n: F.concat(F.when(year(n), F.lit("hallucinated_year:")).otherwise(F.lit("hallucinated_number:")), n))


def omission(source: Column, candidate: Column) -> Column:
    """possible_omission under 0.6 of the source's sentence ends, possible_inflation over 2, else null."""
    a, b = T.sentence_count(F.coalesce(source, F.lit(""))), T.sentence_count(F.coalesce(candidate, F.lit("")))
    return F.when(b * 10 < a * 6, F.lit("possible_omission")).when(b > a * 2, F.lit("possible_inflation"))


def untranslated_lines(source: Column, candidate: Column) -> Column:
    """Quoted or dashed lines of the candidate, three at most, with two or more English words that aren't in the source's."""
    pattern = F.lit(r"(?s)«\s*(.*?)\s*»|(?:^|\n)\s*—\s*([^\n—]+)")
    lines = lambda c: F.array_compact(F.concat(F.regexp_extract_all(c, pattern, F.lit(1)), F.regexp_extract_all(c, pattern, F.lit(2))))
    there = F.lower(F.array_join(lines(F.coalesce(source, F.lit(""))), " "))
    hits = lambda x: F.size(F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"([a-z']+)"), F.lit(1)), lambda w: w.isin(*L.DIALOGUE_ENGLISH) & ~F.contains(there, w)))
    found = F.filter(lines(F.coalesce(candidate, F.lit(""))), lambda x: (F.length(x) >= 3) & (hits(x) >= 2))
    return F.slice(found, 1, 3)


def all_flags(source: Column, draft: Column, candidate: Column, names: Column | None = None, glossary: Column | None = None, w: Column | None = None) -> Column:
    """Every check of a candidate, distinct and in order.

    names: the names that must be kept; glossary: flags of the glossary, as an array; w: who() of the record. Without
    them the checks that need them find nothing.
    """
    parts = [base_flags(source, draft, candidate, names)]
    if w is not None:
        parts.append(informal_flags(candidate, w))
    parts.append(style_flags(source, candidate))
    if w is not None:
        parts.append(name_flags(source, candidate, w))
    if glossary is not None:
        parts.append(F.coalesce(glossary, F.array().cast("array<string>")))
    parts += [
        F.transform(F.slice(english_leaks(source, candidate), 1, 3), lambda w: F.concat(F.lit("english_leak_"), w)),
        F.slice(new_numbers(source, candidate), 1, 2),
        F.array_compact(F.array(F.when(omission(source, candidate) == "possible_omission", F.lit("possible_omission")))),
        F.transform(F.slice(untranslated_lines(source, candidate), 1, 2), lambda _: F.lit("untranslated_dialogue")),
    ]
    return F.array_distinct(F.concat(*parts))


def penalty(flag: Column) -> Column:
    p = L.PENALTIES
    return (
        F.when(flag.isin(*L.SEVERE), p["severe"])
        .when(flag.isin(*L.MAJOR) | F.startswith(flag, F.lit("missing_name_")), p["major"])
        .when(flag.isin(*L.MEDIUM) | F.startswith(flag, F.lit("address_name_lost_")) | F.startswith(flag, F.lit("scene_name_lost_")), p["medium"])
        .otherwise(p["other"])
    )


def score10(source: Column, candidate: Column, flags: Column) -> Column:
    """Ten times the heuristic score, an integer: penalties of the flags, French and English markers, accents, length."""
    s, t = F.coalesce(source, F.lit("")), F.coalesce(candidate, F.lit(""))
    lost = F.aggregate(flags, F.lit(0), lambda a, f: a + penalty(f)) * 10
    part = F.struct(F.length(T.strip(t)).alias("a"), F.greatest(F.lit(1), F.length(T.strip(s))).alias("b"), T.word_tokens(s).alias("st"), T.word_tokens(t).alias("ct"), lost.alias("lost"))

    def total(x: Column) -> Column:
        near = (x["a"] * 10 >= x["b"] * 8) & (x["a"] * 10 <= x["b"] * 18)
        fr = F.size(F.filter(x["ct"], lambda w: w.isin(*L.FRENCH_MARKERS)))
        en = F.size(F.filter(x["ct"], lambda w: w.isin(*L.ENGLISH_MARKERS) & ~F.array_contains(x["st"], w)))
        accents = F.when(t.rlike(r"[^\x00-\x7f]"), 40).otherwise(0)
        return F.lit(1000) - x["lost"] + F.least(F.lit(250), fr * 4) - F.least(F.lit(250), en * 8) + accents + F.when(near, 50).otherwise(0)

    return T.let(part, total).cast("bigint")


def hard_flags(flags: Column) -> Column:
    starts = lambda f: sum((F.startswith(f, F.lit(p)).cast("int") for p in L.HARD_PREFIXES), F.lit(0)) > 0
    return F.size(F.filter(flags, lambda f: f.isin(*L.HARD_FLAGS) | starts(f)))


def adjusted_qe10(raw: Column, local10: Column, flags: Column) -> Column:
    """Ten times the quality estimate after penalties; the local score where there is none."""
    lose = lambda p, *names: F.when(F.arrays_overlap(flags, T.lit_array(names)), p).otherwise(0)
    bonus = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), (local10 - 1000) / 4))
    value = raw * 1000 - F.size(flags) * 120 - lose(400, "missing_inline_markers") - lose(400, "wrong_register_vous", "unexpected_vous") - lose(300, "prompt_leak") + bonus
    return F.coalesce(value, local10.cast("double"))


def accepted(hard_base: Column, score_base: Column, hard: Column, score: Column, strict: bool = True, margin10: int = 80) -> Column:
    """Whether a candidate may replace its base; scores are ten times the heuristic score."""
    near = score + margin10 >= score_base
    return near & ~((hard > hard_base) | ((hard == hard_base) & (hard > 0))) if strict else near


def patch_reasons(flags: Column, score: Column, raw: Column | None = None) -> Column:
    """Why a draft is to be patched: its flags, a low estimate, or without one a low score; none if it is good enough."""
    low = F.when(score < int(L.HEURISTIC_THRESHOLD * 10), F.lit("heuristic"))
    if raw is not None:
        low = F.when(raw.isNotNull(), F.when(raw < L.QE_THRESHOLD, F.lit("estimate"))).otherwise(low)
    reasons = F.array_compact(F.concat(F.transform(flags, lambda f: F.concat(F.lit("validator:"), f)), F.array(low)))
    fine = (score >= int(L.SKIP_THRESHOLD * 10)) & (hard_flags(flags) == 0)
    return F.when(fine, F.array().cast("array<string>")).otherwise(reasons)
