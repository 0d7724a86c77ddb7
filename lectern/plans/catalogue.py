"""Queries over the record model by operator, each with the SQL it must agree with where SQL can express it.

Names begin with the operator's id in the survey; projections P1 and on are proj1 and on, since pN names a training-data problem. Oracles are plain SQL of the stated rules for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import quality as Q
from ..functions import semantics as S
from ..functions import text as T
from ..operators import annotators, dialogue, evaluate, memo, memory, models, profile, rerank, similarity, strings, windows
from ..runtime import spread, table
from ..sources import epub, html
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- inputs ---------------------------------------------------------------------------------------------------
# A file of one row group is one task; spread() gives such small inputs to all cores and leaves larger ones alone.

_CHUNK = ("chunk_id", "book_id", "chapter", "chunk_idx", "source", "draft", "final", "alt_drafts", "speaker", "addressee", "register_hint", "mentioned", "flags", "loaded_at")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "chunks", *_CHUNK))


def current(spark: SparkSession, d: str) -> DataFrame:
    """Of chunks that came again, the one loaded last, then of the highest id."""
    return dialogue.last_by(chunks(spark, d), ["book_id", "chapter", "chunk_idx"], ["loaded_at", "chunk_id"])


def blocks(spark: SparkSession, d: str) -> DataFrame:
    u = spread(table(spark, d, "units", "unit_id", "book_id", "item_name", "block_pos", "text"))
    return u.select(F.col("book_id").alias("book"), F.col("item_name").alias("part"), F.coalesce("block_pos", F.lit(0)).alias("pos"), F.col("unit_id").alias("id"), "text")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents", "doc_id", "text", "lang"))


CURRENT = "(select * from chunks qualify row_number() over (partition by book_id, chapter, chunk_idx order by loaded_at desc, chunk_id desc) = 1)"
BLOCKS = "(select book_id as book, item_name as part, coalesce(block_pos, 0) as pos, unit_id as id, text from units)"
CAND = "coalesce(nullif(final, ''), draft)"


def candidate() -> F.Column:
    return F.coalesce(F.nullif("final", F.lit("")), "draft")


# --- SQL building blocks -----------------------------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(chr(40) + chr(91) + 'A-Za-zÀ-ÿ' + chr(39) + chr(93) + '+' + chr(41))}, 1)"


def wrd(x: str) -> str:
    return rf"regexp_extract_all({x}, '([\p{{L}}\p{{N}}_]+)', 1)"


def asc(x: str, k: int) -> str:
    return f"list_filter({wrd(f'lower({x})')}, lambda w: regexp_full_match(w, '[a-z]{{{k},}}'))"


def trim(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def sub(x: str, *rules: tuple[str, str]) -> str:
    for a, b in rules:
        x = f"regexp_replace({x}, {q(a)}, {q(b)}, 'g')"
    return x


def bare(x: str) -> str:
    return sub(x, (T.MARKER, ""))


def has(x: str, alternatives: str) -> str:
    return f"regexp_matches({x}, {q(rf'(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{alternatives})(?:$|[^\p{{L}}\p{{N}}_])')})"


def count_in(tokens: str, values) -> str:
    return f"len(list_filter({tokens}, lambda w: list_contains({lst(values)}, w)))"


def fr_hits(x: str) -> str:
    return count_in(tok(x), L.FRENCH_MARKERS)


def en_hits(s: str, x: str) -> str:
    return f"len(list_filter({tok(x)}, lambda w: list_contains({lst(L.ENGLISH_MARKERS)}, w) and not list_contains({tok(s)}, w)))"


SPEECH = "[\"“”«»]"


def _leak(x: str) -> str:
    return "(" + " or ".join(f"contains(lower({x}), {q(m.lower())})" for m in L.PROMPT_LEAKS) + ")"


def base_flags_sql(s: str, d: str, c: str) -> str:
    """Flags of base_flags as a list, of columns that aren't null."""
    t = trim(c)
    base = f"greatest(length({trim(d)}), length({trim(s)}), 1)"
    lost = rf"len(list_filter(regexp_extract_all({s}, '\[\[(ZX[A-Z]+[0-9]+X)\]\]', 1), lambda m: not contains({t}, '[[' || m || ']]') or not contains({t}, '[[/' || m || ']]'))) > 0"
    return f"""list_filter([
        case when {t} = '' then 'empty' end,
        case when {_leak(t)} then 'prompt_leak' end,
        case when {en_hits(s, t)} >= 4 and {en_hits(s, t)} > {fr_hits(t)} then 'english_heavy' end,
        case when {base} > 40 and (length({t}) * 10 > {base} * 22 or length({t}) * 100 < {base} * 35) then 'length_ratio' end,
        case when {lost} then 'missing_inline_markers' end,
        case when regexp_matches({s}, {q(SPEECH)}) and contains({t}, '"') then 'ascii_dialogue_quotes' end
    ], lambda f: f is not null)"""


def style_flags_sql(s: str, c: str) -> str:
    drift = rf"regexp_matches({bare(c)}, {q(rf'(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:ils?|elles?)\s+(?:{L.PRESENT_DRIFT})(?:$|[^\p{{L}}\p{{N}}_])')})"
    return f"""list_filter([
        case when regexp_matches({bare(s)}, {q(SPEECH)}) and not regexp_matches({bare(c)}, {q(r'(?:^|\s)(?:["«»]|[-–—]\s)')}) then 'dialogue_punctuation_lost' end,
        case when contains({bare(s)}, '?') and not contains({bare(c)}, '?') then 'question_punctuation_lost' end,
        case when not regexp_matches({bare(s)}, {q(SPEECH)}) and {has(bare(s), L.PAST_NARRATION)} and {drift} then 'tense_present_drift' end
    ], lambda f: f is not null)"""


PAIRS = f"(select chunk_id, book_id, coalesce(source, '') as s, coalesce(draft, '') as d, coalesce({CAND}, '') as c from chunks)"
_WATCH = tuple(w for w in L.LEAK_WORDS if w not in L.LEAK_EXEMPT)
LEAKS = f"list_filter({asc('c', 2)}, lambda w: list_contains({lst(_WATCH)}, w) and not contains(lower(s), w))"
NEW_NUMBERS = r"list_filter(list_distinct(list_filter({w}, lambda w: regexp_full_match(w, '[0-9]+'))), lambda n: not list_contains({v}, n))".format(w=wrd("c"), v=wrd("s"))
KEPT_NUMBERS = rf"list_filter({NEW_NUMBERS}, lambda n: regexp_full_match(n, '1[89][0-9]{{2}}|20[0-9]{{2}}') or regexp_full_match(n, '0*[1-9][0-9]+'))"


def sentences_sql(x: str) -> str:
    return rf"greatest(1, len(regexp_extract_all({x}, '[.!?»]\s')))"


def penalty_sql(f: str) -> str:
    p = L.PENALTIES
    return f"case when list_contains({lst(L.SEVERE)}, {f}) then {p['severe']} when list_contains({lst(L.MAJOR)}, {f}) or starts_with({f}, 'missing_name_') then {p['major']} when list_contains({lst(L.MEDIUM)}, {f}) then {p['medium']} else {p['other']} end"


def score_sql(s: str, c: str, flags: str) -> str:
    a, b = f"length({trim(c)})", f"greatest(1, length({trim(s)}))"
    return f"""(1000 - 10 * coalesce(list_sum(list_transform({flags}, lambda f: {penalty_sql('f')})), 0)
        + least(250, {fr_hits(c)} * 4) - least(250, {en_hits(s, c)} * 8)
        + case when regexp_matches({c}, '[^\\x00-\\x7f]') then 40 else 0 end
        + case when {a} * 10 >= {b} * 8 and {a} * 10 <= {b} * 18 then 50 else 0 end)::bigint"""


# --- texts ----------------------------------------------------------------------------------------------------------


@query(
    f"""with f as (select lang, {base_flags_sql("''", "''", "coalesce(text, '')")} as flags, {en_hits("''", "coalesce(text, '')")} as en, {fr_hits("coalesce(text, '')")} as fr from documents)
    select lang, flag, count(*) as n_docs, sum(en)::bigint as english, sum(fr)::bigint as french from (select lang, en, fr, unnest(case when len(flags) = 0 then ['none'] else flags end) as flag from f) group by lang, flag"""
)
def doc_quality_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Documents by language and flag, with their marker words."""
    x = F.coalesce("text", F.lit(""))
    e = documents(spark, d).select("lang", Q.base_flags(F.lit(""), F.lit(""), x).alias("flags"), Q.english_hits(F.lit(""), x).alias("en"), Q.french_hits(x).alias("fr"))
    flag = F.explode(F.when(F.size("flags") == 0, F.array(F.lit("none"))).otherwise(F.col("flags"))).alias("flag")
    return e.select("lang", "en", "fr", flag).groupBy("lang", "flag").agg(F.count("*").alias("n_docs"), F.sum("en").alias("english"), F.sum("fr").alias("french"))


@query(f"select doc_id, md5({trim(sub("translate(lower(text), '_-', '  ')", (r'[^a-z0-9]+', ' ')))}) as h from documents")
def f1_normalize(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("h"))


@query("select n, w as words, n as back, w as chapter from (select range as n, case when range < 20 then {o}[range + 1] when range % 10 = 0 then {t}[range // 10 - 1] else {t}[range // 10 - 1] || ' ' || {o}[range % 10 + 1] end as w from range(0, 100))".format(o=lst(L.ONES), t=lst(L.TENS)))
def f2_number_words(spark: SparkSession, d: str) -> DataFrame:
    n = spark.range(0, 100).withColumnRenamed("id", "n").withColumn("words", T.number_word(F.col("n")))
    return n.select("n", "words", T.word_number(F.col("words")).cast("bigint").alias("back"), T.number_word(T.chapter_number(F.concat(F.lit("Chapter_"), "words"))).alias("chapter"))


@query(f"select doc_id, len({tok('text')}) as n_tokens, len(list_distinct({tok('text')})) as n_distinct from documents")
def f3_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = T.word_tokens(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


def typography_sql(x: str) -> str:
    return trim(sub(f"translate({x}, '“”', '\"\"')", (r'"([^"\n]+)"', r"« \1 »"), (r"\s+([,.])", r"\1"), (r"\s+([;:!?])", r" \1"), (r"«\s+", "« "), (r"\s+»", " »"), (r"(^|[^\p{L}\p{N}_])([ldjmnstcçLDJMNSTCÇ])'\s+", r"\1\2'"), (r"\s{2,}", " ")))


@query(f"select chunk_id, md5({typography_sql('final')}) as h from chunks where final is not null")
def f4_typography(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where("final is not null").select("chunk_id", F.md5(T.french_typography(F.col("final"))).alias("h"))


_SQUEEZED = trim(sub("source", (r"\s+", " ")))


@query(f"select section_id, case when length({_SQUEEZED}) <= 60 then {_SQUEEZED} else rtrim(left({_SQUEEZED}, 60)) || ' ... [' || (length({_SQUEEZED}) - 60) || ' more chars]' end as shown from sections where source is not null")
def f5_progress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections", "section_id", "source").where("source is not null").select("section_id", T.progress_text(F.col("source"), 60).alias("shown"))


@query()
def f6_safe_stems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "books", "book_id", "title").select("book_id", T.safe_stem(F.col("title")).alias("stem"))


_ONE_LINE = trim(sub("coalesce(text, '')", (r"\s+", " ")))


@query(f"select doc_id, case when {_ONE_LINE} = '' then 'ValueError' when length({_ONE_LINE}) > 320 then left({_ONE_LINE}, 317) || '...' else {_ONE_LINE} end as shown from documents")
def f38_short_error(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.short_error(F.col("text"), F.lit("ValueError")).alias("shown"))


_TITLED = "list_transform(range(0, 100), lambda n: case when n < 20 then {o}[n + 1] when n % 10 = 0 then {t}[n // 10 - 1] else {t}[n // 10 - 1] || '_' || {o}[n % 10 + 1] end)".format(o=lst(w.title() for w in L.ONES), t=lst(w.title() for w in L.TENS))


@query(f"with c as (select distinct chapter, try_cast(regexp_extract(lower(regexp_replace(chapter, '[^A-Za-z0-9]+', ' ', 'g')), '(?:^| )(?:chapter|chap|ch) ([0-9]+)(?: |$)', 1) as int) as n from chunks where chapter is not null) select chapter, case when n < 100 then 'Chapter_' || ({_TITLED})[n + 1] when n is not null then 'Chapter_' || n else coalesce(nullif(trim(regexp_replace(chapter, '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'Chapter') end as label from c")
def f38_chapter_labels(spark: SparkSession, d: str) -> DataFrame:
    """The output label of every chapter's name."""
    return table(spark, d, "chunks", "chapter").where("chapter is not null").distinct().select("chapter", T.chapter_label(F.col("chapter")).alias("label"))


@query("select term, trim(regexp_replace(lower(term), '[^a-z0-9]+', '_', 'g'), '_') as slug from glossary")
def f7_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "glossary", "term").select("term", T.slug(F.col("term")).alias("slug"))


@query(f"select chunk_id, length(source) - length({bare('source')}) as n_marker, md5({sub(bare('source'), (r'"[^"]*"', ' '), ('“[^”]*”', ' '), ('«[^»]*»', ' '))}) as told from chunks where source is not null")
def f8_strip(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("source")
    return chunks(spark, d).where("source is not null").select("chunk_id", (F.length(s) - F.length(T.strip_markers(s))).cast("bigint").alias("n_marker"), F.md5(T.unquoted(s)).alias("told"))


@query(f"select unit_id, md5({trim(sub('marked_text', (r'\r\n?', chr(10)), (r'[ \t\n]+', ' '), (r'\s+(\[\[/?)', r' \1'), (r'(\]\])\s+', r'\1 ')))}) as h from units where marked_text is not null")
def f9_marked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "units", "unit_id", "marked_text").where("marked_text is not null").select("unit_id", F.md5(T.normalize_marked(F.col("marked_text"))).alias("h"))


@query()
def f10_repair_markers(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).where("source like '%[[ZX%' and final is not null").select("chunk_id", "source", F.col("final").alias("candidate"))
    r = strings.repair_markers(c, "source", "candidate")
    return r.select("chunk_id", (F.col("repaired") != F.col("candidate")).alias("changed"), F.size(Q.missing_markers(F.col("source"), F.col("repaired"))).alias("missing"))


@query(rf"select chunk_id, list_filter(list_distinct(regexp_extract_all(source, '\[\[(ZX[A-Z]+[0-9]+X)\]\]', 1)), lambda m: not contains(final, '[[' || m || ']]') or not contains(final, '[[/' || m || ']]')).len() as missing from chunks where source like '%[[ZX%' and final is not null")
def f10_missing_markers(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).where("source like '%[[ZX%' and final is not null")
    return c.select("chunk_id", F.size(Q.missing_markers(F.col("source"), F.col("final"))).cast("bigint").alias("missing"))


def _clean_sql(x: str) -> str:
    x = sub(trim(x), (r"(?i)^```(?:text|fr|french)?\s*", ""), (r"\s*```$", ""))
    for label in ("Corrected French:", "Repaired French:", "French:", "Traduction:"):
        x = f"(select case when starts_with(lower(v), {q(label.lower())}) then {trim(f'substr(v, {len(label) + 1})')} else v end from (select {x} as v))"
    return trim(sub(x, (r"(?i)\s*\(\s*\d+\s+s[eé]ances?\s*\)|\s*\(\s*session\s+\d+\s*\)|\s*\(\s*chapitre\s+\d+\s*\)", "")))


@query(f"select chunk_id, md5({_clean_sql('final')}) as h from chunks where final is not null")
def f11_clean(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where("final is not null").select("chunk_id", F.md5(T.clean_generated(F.col("final"))).alias("h"))


@query(r"select doc_id, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:20], ' ') as head from documents where text is not null")
def f12_trim(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", T.first_words(F.col("text"), 20).alias("head"))


@query(r"select chunk_id, greatest(1, len(list_filter(string_split_regex(coalesce(source, ''), '\s+'), lambda w: w <> '')), ceil(length(coalesce(source, '')) / 4.0)::int)::int as tokens from chunks")
def f13_tokens(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", T.estimate_tokens(F.col("source")).alias("tokens"))


@query()
def f14_split_long(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections", "section_id", "source")
    return windows.split_long(s, "section_id", "source", 60).groupBy("id").agg(F.count("*").alias("n_parts"), F.sum(F.length("text")).alias("n_chars"))


_FX15 = [(1, "Un\n[[ZXSEG1X]]\nDeux", 2), (2, "Un\nDeux\nTrois", 3), (3, "Un Deux", 2), (4, "A ZXSEG1X B [[ZXSEG2X]] C", 3), (5, "", 1)]


@query("select * from (values (1, 'Un|Deux'), (2, 'Un|Deux|Trois'), (3, null), (4, 'A|B|C'), (5, null)) t(grp, parts)")
def f15_group_split(spark: SparkSession, d: str) -> DataFrame:
    x = windows.split_grouped(spark.createDataFrame(_FX15, "grp int, text string, n int"), "text", "n")
    return x.select("grp", F.when(F.col("parts").isNotNull(), F.array_join("parts", "|")).alias("parts"))


@query()
def f16_memory_text(spark: SparkSession, d: str) -> DataFrame:
    """The normal form of every source; SQL has no NFKC, so the tests compare it with brute force."""
    m = table(spark, d, "correction_memory", "entry_id", "source").where("source is not null")
    return m.select("entry_id", F.md5(T.memory_text(F.col("source"))).alias("h"))


@query("select chunk_id, sha256(concat_ws(chr(31), coalesce(source, ''), coalesce(draft, ''), coalesce(final, ''))) as key from chunks")
def f17_hash_keys(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", T.content_key(F.col("source"), F.col("draft"), F.col("final")).alias("key"))


# --- validation and scores ----------------------------------------------------------------------------------------------


@query(f"select chunk_id, unnest({base_flags_sql('s', 'd', 'c')}) as flag from {PAIRS}")
def f18_validate(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", F.explode(Q.base_flags(F.col("source"), F.col("draft"), candidate())).alias("flag"))


_NAMES = f"(select book, name, n, row_number() over (partition by book order by n desc, name) as rank from (select book, name, count(*) as n from (select book_id as book, unnest(list_filter({wrd(bare("coalesce(source, '')"))}, lambda w: regexp_full_match(w, '[A-Z][a-z]+'))) as name from chunks) group by book, name having count(*) >= 2) qualify rank <= 40)"


def _chunk_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select(F.col("book_id").alias("book"), F.col("source").alias("text"))


@query(f"with p as (select chunk_id, book_id, list_distinct({wrd(trim('c'))}) as cw, list_distinct({wrd('s')}) as sw from {PAIRS}) select p.chunk_id, n.name from p join {_NAMES} n on n.book = p.book_id where list_contains(sw, n.name) and not list_contains(cw, n.name)")
def f18_missing_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the book's registry that the source has and the candidate lost."""
    names = profile.required_names(_chunk_blocks(spark, d))
    c = chunks(spark, d).join(names, F.col("book_id") == F.col("book"), "left")
    flags = F.filter(Q.base_flags(F.col("source"), F.col("draft"), candidate(), F.coalesce("names", F.array().cast("array<string>"))), lambda f: F.startswith(f, F.lit("missing_name_")))
    return c.select("chunk_id", F.explode(flags).alias("f")).select("chunk_id", F.substring("f", len("missing_name_") + 1, 1 << 20).alias("name"))


@query(f"select chunk_id, unnest({style_flags_sql('s', 'c')}) as flag from {PAIRS}")
def f19_style(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", F.explode(Q.style_flags(F.col("source"), candidate())).alias("flag"))


_F21 = f"select chunk_id, len(list_distinct({LEAKS})) as n_leaks from {PAIRS}"


@query(_F21)
def f21_english_leaks(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", F.size(Q.english_leaks(F.col("source"), candidate())).cast("bigint").alias("n_leaks"))


@query()
def f20_validate_full(spark: SparkSession, d: str) -> DataFrame:
    """All checks: glossary, names and register included."""
    return pipeline.with_cast(chunks(spark, d)).select("chunk_id", F.explode(_every_flag(spark, d)).alias("flag"))


def _every_flag(spark: SparkSession, d: str, c: F.Column | None = None) -> F.Column:
    """Flags of the candidate of with_cast's rows, or of c, by all checks."""
    c = candidate() if c is None else c
    s, t = (T.strip_markers(F.coalesce(x, F.lit(""))) for x in (F.col("source"), c))
    g = memory.glossary_column(table(spark, d, "glossary"), s, t)
    return Q.all_flags(F.col("source"), F.col("draft"), c, F.col("names"), F.array_sort(F.array_distinct(g)), F.col("who"))


@query()
def f22_untranslated_dialogue(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", F.size(Q.untranslated_lines(F.col("source"), candidate())).alias("n")).where("n > 0")


@query(f"select chunk_id, case when b * 10 < a * 6 then 'possible_omission' when b > a * 2 then 'possible_inflation' end as warning, a::bigint as src, b::bigint as tgt from (select chunk_id, {sentences_sql('s')} as a, {sentences_sql('c')} as b from {PAIRS})")
def f23_length_ratio(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: T.sentence_count(F.coalesce(c, F.lit(""))).cast("bigint")
    return chunks(spark, d).select("chunk_id", Q.omission(F.col("source"), candidate()).alias("warning"), n(F.col("source")).alias("src"), n(candidate()).alias("tgt"))


_SCORED = f"(select chunk_id, s, c, {base_flags_sql('s', 'd', 'c')} as flags from {PAIRS})"


@query(f"select chunk_id, {score_sql('s', 'c', 'flags')} as score10 from {_SCORED}")
def f24_score(spark: SparkSession, d: str) -> DataFrame:
    flags = Q.base_flags(F.col("source"), F.col("draft"), candidate())
    return chunks(spark, d).select("chunk_id", Q.score10(F.col("source"), candidate(), flags).alias("score10"))


@query(f"select chunk_id, round(raw * 1000 - len(flags) * 120 - case when list_contains(flags, 'missing_inline_markers') then 400 else 0 end - case when list_contains(flags, 'prompt_leak') then 300 else 0 end + greatest(-50.0, least(50.0, (score - 1000) / 4)))::bigint as qe10 from (select *, greatest(0, least(1000, score)) / 1000 as raw from (select *, {score_sql('s', 'c', 'flags')} as score from {_SCORED}))")
def f25_adjusted_estimate(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("chunk_id", Q.base_flags(F.col("source"), F.col("draft"), candidate()).alias("flags"), F.col("source"), candidate().alias("c"))
    c = models.estimate(c.withColumn("score10", Q.score10(F.col("source"), F.col("c"), F.col("flags"))))
    return c.select("chunk_id", F.round(Q.adjusted_qe10(F.col("raw"), F.col("score10"), F.col("flags"))).cast("bigint").alias("qe10"))


@query(f"select chunk_id, len(flags)::int as n_flags, (len(flags) > 0 or score < 940) and not (score >= 960 and len(list_filter(flags, lambda f: list_contains({lst(L.HARD_FLAGS)}, f))) = 0) as needs_patch from (select chunk_id, flags, {score_sql('s', 'c', 'flags')} as score from (select chunk_id, s, d as c, {base_flags_sql('s', 'd', 'd')} as flags from {PAIRS}))")
def proj15_patch_decisions(spark: SparkSession, d: str) -> DataFrame:
    flags = Q.base_flags(F.col("source"), F.col("draft"), F.col("draft"))
    c = chunks(spark, d).withColumn("f", flags).withColumn("score", Q.score10(F.col("source"), F.col("draft"), F.col("f")))
    return c.select("chunk_id", F.size("f").alias("n_flags"), (F.size(Q.patch_reasons(F.col("f"), F.col("score"))) > 0).alias("needs_patch"))


@query(f"select chunk_id, number from (select chunk_id, unnest(list_transform({KEPT_NUMBERS}, lambda n: case when regexp_full_match(n, '1[89][0-9]{{2}}|20[0-9]{{2}}') then 'hallucinated_year:' || n else 'hallucinated_number:' || n end)) as number from {PAIRS})")
def set4_new_numbers(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", F.explode(Q.new_numbers(F.col("source"), candidate())).alias("number"))


@query(f"select chunk_id, len(list_intersect(a, b))::int as inter, len(list_distinct(list_concat(a, b)))::int as n_union from (select chunk_id, list_distinct(list_filter({tok('s')}, lambda w: length(w) > 2 and not list_contains({lst(L.STOPWORDS)}, w))) as a, list_distinct(list_filter({tok('c')}, lambda w: length(w) > 2 and not list_contains({lst(L.STOPWORDS)}, w))) as b from {PAIRS})")
def f33_overlap(spark: SparkSession, d: str) -> DataFrame:
    a, b = (T.content_tokens(F.coalesce(c, F.lit(""))) for c in (F.col("source"), candidate()))
    return chunks(spark, d).select("chunk_id", F.size(F.array_intersect(a, b)).alias("inter"), F.size(F.array_union(a, b)).alias("n_union"))


# --- semantics ------------------------------------------------------------------------------------------------------------


@query(f"select chunk_id, emotion, n from (select chunk_id, unnest([{', '.join(f'{{e: {q(e)}, n: {count_in(asc("coalesce(source, " + q("") + ")", 3), ws.split())}}}' for e, ws in L.EMOTIONS.items())}], recursive := true) from chunks) t(chunk_id, emotion, n) where n > 0")
def f26_emotions(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("chunk_id", F.explode(S.emotion_counts(F.col("source"))).alias("emotion", "n"))
    return c.where("n > 0").select("chunk_id", "emotion", F.col("n").cast("bigint").alias("n"))


def _of(emotions: tuple[str, ...]) -> list[str]:
    return sorted({w for e in emotions for w in L.EMOTIONS[e].split()})


@query(f"select doc_id, {count_in(asc("coalesce(text, '')", 3), _of(L.POSITIVE))} as pos, {count_in(asc("coalesce(text, '')", 3), _of(L.NEGATIVE))} as neg, len({asc("coalesce(text, '')", 3)}) as n from documents")
def f27_sentiment(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, d).select("doc_id", S.polarity(t, L.POSITIVE).cast("bigint").alias("pos"), S.polarity(t, L.NEGATIVE).cast("bigint").alias("neg"), F.size(T.ascii_words(F.coalesce(t, F.lit("")), 3)).cast("bigint").alias("n"))


_ACTS = "list_filter([" + ", ".join(f"case when {f'regexp_matches(source, {q(p)})' if p in (r'\?', '!') else has('source', p)} then {q(a)} end" for a, p in L.SPEECH_ACTS.items()) + "], lambda a: a is not null)"


@query(f"select chunk_id, array_to_string(case when len(acts) > 1 then list_filter(acts, lambda a: a <> 'assertion') else acts end, ',') as acts, case when f and not i then 'formal' when i and not f then 'informal' else 'neutral' end as tone from (select chunk_id, {_ACTS} as acts, {has('source', L.FORMAL_POLITENESS)} as f, {has('source', L.INFORMAL_POLITENESS)} as i from chunks where source is not null)")
def f28_acts(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).where("source is not null")
    return c.select("chunk_id", F.array_join(S.speech_acts(F.col("source")), ",").alias("acts"), S.politeness(F.col("source")).alias("tone"))


@query("select * from (values (1, 1, 'Alice'), (1, 2, 'Bob'), (1, 3, ''), (1, 4, ''), (1, 5, ''), (2, 1, 'Carol'), (2, 2, '')) t(doc, idx, names)")
def f29_salience(spark: SparkSession, d: str) -> DataFrame:
    return _fx_chunk(spark).select("doc", "idx", F.array_join(S.entity_salience(F.col("source"), ["Alice", "Bob", "Carol"]), ",").alias("names"))


def _past_sql(x: str) -> str:
    return f"list_filter({asc(x, 2)}, lambda w: regexp_full_match(w, '[a-z]+(ed|t)') or list_contains({lst(L.STRONG_PAST)}, w))"


_KNOWN = sorted({w for ws in L.ASPECTS.values() for w in ws.split()})
_INF = f"case when list_contains({lst(L.IRREGULAR_PAST)}, v) then (map {{{', '.join(f'{q(a)}: {q(b)}' for a, b in L.IRREGULAR_PAST.items())}}})[v] when suffix(v, 'ied') then left(v, -3) || 'y' when suffix(v, 'ed') and length(v) >= 4 and v[-3] = v[-4] and not contains('aeiou', v[-3]) then left(v, -3) when suffix(v, 'ed') and length(v) > 2 and not contains('aeiou', v[-3]) and list_contains({lst(_KNOWN)}, left(v, -2) || 'e') then left(v, -2) || 'e' when suffix(v, 'ed') then left(v, -2) else v end"
_ASPECT = "case " + " ".join(f"when list_contains({lst(ws.split())}, inf) then {q(a)}" for a, ws in L.ASPECTS.items()) + " end"


@query(f"select book_id, aspect, count(*) as n from (select book_id, {_ASPECT} as aspect from (select book_id, {_INF} as inf from (select book_id, unnest({_past_sql("coalesce(source, '')")}) as v from chunks))) where aspect is not null group by book_id, aspect")
def f30_aktionsart(spark: SparkSession, d: str) -> DataFrame:
    return profile.aspect_counts(chunks(spark, d).select("book_id", F.col("source").alias("text")), ["book_id"])


def _FID(x: str) -> str:
    told = sub(f"coalesce({x}, '')", ('["«][^"»]*["»]', " "))
    return "(" + " + ".join(f"case when regexp_matches({told}, {q(p)}) then {w} else 0 end" for _, w, p in L.FID_SIGNALS) + ")"


@query(f"select chunk_id, {_FID('source')} as raw from chunks")
def f31_fid(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", S.fid_raw(F.col("source")).alias("raw"))


def _HIGH(x: str) -> str:
    return f"({count_in(asc(f"coalesce({x}, '')", 1), L.DOMINANT)} + 2 * len(regexp_extract_all(coalesce({x}, ''), {q(L.IMPERATIVES)})))"


def _LOW(x: str) -> str:
    return f"({count_in(asc(f"coalesce({x}, '')", 1), L.DEFERENT)} + 2 * len(regexp_extract_all(coalesce({x}, ''), {q(L.HEDGES)})))"


@query(f"select chunk_id, {_HIGH('source')} as high, {_LOW('source')} as low from chunks")
def f32_dominance(spark: SparkSession, d: str) -> DataFrame:
    high, low = S.dominance_parts(F.col("source"))
    return chunks(spark, d).select("chunk_id", high.cast("bigint").alias("high"), low.cast("bigint").alias("low"))


@query("select * from (values (1, true, 'Un|Deux'), (2, false, 'Un'), (3, false, null), (4, false, 'Un|')) t(id, valid, texts)")
def f34_window_json(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, 'x [{"index":1,"translation":"Un"},{"index":2,"translation":"Deux"}] y', [1, 2]), (2, '[{"index":1,"translation":"Un"}]', [1, 2]), (3, "no", [1]), (4, '[{"index":1,"translation":"Un"},{"index":2,"translation":""}]', [1, 2])]
    x = spark.createDataFrame(rows, "id int, raw string, expected array<int>").withColumn("p", models.window_json(F.col("raw")))
    return x.select("id", models.window_valid(F.col("p"), F.col("expected")).alias("valid"), F.when(F.col("p").isNotNull(), F.array_join(F.transform("p", lambda v: v["translation"]), "|")).alias("texts"))


@query("select * from (values ('chat', 'chat', 8), ('chat', 'chats', 6), ('', 'ab', -4), ('abc', 'axc', 3), ('Été', 'été', 6)) t(a, b, score)")
def f35_alignment(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([("chat", "chat"), ("chat", "chats"), ("", "ab"), ("abc", "axc"), ("Été", "été")], "a string, b string")
    return x.select("a", "b", strings.global_score(F.col("a"), F.col("b")).alias("score"))


_PREFIX = lambda x: f"left({sub(f'lower({x})', (r'\s', ''))}, 100)"


@query(f"select chunk_id, least(length(a), length(b))::int as n_compared, len(list_filter(range(1, 101), lambda i: i <= least(length(a), length(b)) and a[i] = b[i]))::int as n_match from (select chunk_id, {_PREFIX('s')} as a, {_PREFIX('c')} as b from {PAIRS})")
def f36_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    p = chunks(spark, d).select("chunk_id", "source", candidate().alias("c"))
    return evaluate.prefix_matches(p, ["chunk_id"], "source", "c")


_FORMAL = f"greatest(-4, least(4, len(list_intersect({lst([w for w in L.FORMAL_WORDS if w not in L.INFORMAL_WORDS])}, w)) - len(list_intersect({lst(L.INFORMAL_WORDS)}, w))))"


@query(rf"select doc_id, f::int as formality4, case when f < -2 then 'informal' when f > 2 then 'formal' else 'mixed' end as register from (select doc_id, {_FORMAL} as f from (select doc_id, list_distinct(string_split_regex(lower(coalesce(text, '')), '\s+')) as w from documents))")
def f37_register(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", S.formality4(F.col("text")).alias("formality4"), S.register(F.col("text")).alias("register"))


@query()
def proj26_hint_texts(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", S.hint_text(F.col("source")).alias("hints")).where("hints <> ''")


# --- predicates ------------------------------------------------------------------------------------------------------------


@query(f"select book_id, sum(case when length({trim('text')}) >= 2 and regexp_matches(text, '[A-Za-z]') then 1 else 0 end)::bigint as n_keep, count(*) as n_all from units where text is not null group by book_id")
def proj8_should_translate(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "units", "book_id", "text").where("text is not null")
    return u.groupBy("book_id").agg(F.sum(T.should_translate(F.col("text")).cast("bigint")).alias("n_keep"), F.count("*").alias("n_all"))


_HINTS = f"""list_filter([case when regexp_matches(s, {q(SPEECH)}) then 'dialogue' end, case when r = 'informal' then 'informal_dialogue_required' end,
    case when r = 'plural_or_formal_allowed' then 'plural_or_formal_allowed' end, case when not regexp_matches(s, {q(SPEECH)}) and {has('s', L.PAST_NARRATION)} then 'past_narration' end,
    case when contains(s, '?') then 'preserve_question' end], lambda h: h is not null)"""


@query(f"select chunk_id, array_to_string({_HINTS}, ',') as hints from (select chunk_id, {bare("coalesce(source, '')")} as s, register_hint as r from chunks)")
def proj21_style_hints(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", F.array_join(dialogue.style_hints(F.col("source"), F.col("register_hint"), F.lit(False)), ",").alias("hints"))


@query(f"select chunk_id, draft <> c as changed, len({base_flags_sql('s', 'd', 'c')}) > 0 as failed, regexp_matches(s, {q(SPEECH)}) as dialogue from (select chunk_id, draft, coalesce(source, '') as s, coalesce(draft, '') as d, {CAND} as c from chunks where draft is not null)")
def proj17_selection(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).where("draft is not null").withColumn("current", candidate())
    return c.select("chunk_id", models.selection("changed").alias("changed"), (F.size(Q.base_flags(F.col("source"), F.col("draft"), F.col("current"))) > 0).alias("failed"), T.has_speech(F.coalesce("source", F.lit(""))).alias("dialogue"))


@query("select chunk_id, array_to_string(list_transform(list_sort(list_filter(map_entries(alt_drafts), lambda e: e.value <> '')), lambda e: e.key || ': ' || e.value), chr(10)) as alts from chunks where alt_drafts is not null")
def proj23_alt_drafts(spark: SparkSession, d: str) -> DataFrame:
    e = F.array_sort(F.filter(F.map_entries("alt_drafts"), lambda x: x["value"] != ""))
    return chunks(spark, d).where("alt_drafts is not null").select("chunk_id", F.array_join(F.transform(e, lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "\n").alias("alts"))


# --- characters --------------------------------------------------------------------------------------------------------------

_FX_CHUNK = [
    (1, 1, '"Are you coming?" Alice asked.'), (1, 2, '"I promise," Bob said.'), (1, 3, "The room was cold and she felt afraid."),
    (1, 4, '"You two should go!"'), (1, 5, "Why would he leave now?"), (2, 1, "Carol walked to Paris in 1999."), (2, 2, '"Please, could you wait?"'),
]
_FX_ALIAS = [(1, "Alice", "Alice"), (2, "Al", "Alice"), (3, "Bob", "Bob"), (4, "Carol", "Carol")]
_FX_REL = [("Alice", "Bob", "intimate_partner"), ("Bob", "Alice", "intimate_partner"), ("Alice", "Carol", "friends"), ("Carol", "Alice", "friends")]


def _values(rows: list[tuple], names: str) -> str:
    return f"(values {', '.join('(' + ', '.join(q(v) if isinstance(v, str) else str(v) for v in r) + ')' for r in rows)}) t({names})"


def _fx_chunk(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_FX_CHUNK, "doc int, idx int, source string")


def _fx_alias(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_FX_ALIAS, "ord int, alias string, canonical string")


def _fx_rel(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_FX_REL, "a string, b string, type string")


@query(f"select a.alias, a.canonical, b.canonical as other, coalesce(r.type, '') as type from (select * from {_values(_FX_ALIAS, 'ord, alias, canonical')}) a cross join (select distinct canonical from {_values(_FX_ALIAS, 'ord, alias, canonical')}) b left join (select * from {_values(_FX_REL, 'a, b, type')}) r on r.a = a.canonical and r.b = b.canonical")
def j1_relations(spark: SparkSession, d: str) -> DataFrame:
    al = _fx_alias(spark)
    who = dialogue.canonical(al.select(F.col("alias").alias("name")), al)
    others = F.explode(F.array(*(F.lit(x) for x in ("Alice", "Bob", "Carol"))))
    p = who.select(F.col("name").alias("alias"), F.col("canonical").alias("a"), others.alias("b"))
    return dialogue.relation_of(p, _fx_rel(spark)).select("alias", F.col("a").alias("canonical"), F.col("b").alias("other"), "type")


@query(f"select distinct doc, idx, canonical, min(ord) over (partition by doc, idx, canonical) as ord from {_values(_FX_CHUNK, 'doc, idx, source')} join (select * from {_values(_FX_ALIAS, 'ord, alias, canonical')}) a on list_contains({wrd('source')}, alias)")
def j2_mentions(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.mentions(_fx_chunk(spark), ["doc", "idx"], "source", _fx_alias(spark)).select("doc", "idx", "canonical", "ord")


@query(f"select distinct least(a, b) as first, greatest(a, b) as second from {_values(_FX_REL, 'a, b, type')} where type = 'intimate_partner'")
def j3_intimate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.intimate_pairs(_fx_rel(spark))


def _rule(x: str, c: str) -> str:
    return f"regexp_matches({x}, '(?i)(?:' || array_to_string({c}, '|') || ')')"


@query(rf"""with p as (select chunk_id, ' ' || array_to_string({wrd(bare("coalesce(source, '')"))}, ' ') || ' ' as s, ' ' || array_to_string({wrd(bare(f"coalesce({CAND}, '')"))}, ' ') || ' ' as c from chunks),
    w as (select term, list_transform(source, lambda r: ' ' || replace(r, '\b', '') || ' ') as src, list_transform(preferred, lambda r: ' ' || replace(r, '\b', '') || ' ') as pre, list_transform(forbidden, lambda r: ' ' || replace(r, '\b', '') || ' ') as forb from glossary),
    j as (select chunk_id, term, len(pre) > 0 and len(list_filter(pre, lambda x: contains(lower(c), lower(x)))) = 0 as missing, len(list_filter(forb, lambda x: contains(lower(c), lower(x)))) > 0 as forbidden from p join w on len(list_filter(src, lambda x: contains(lower(s), lower(x)))) > 0)
    select flag, count(*) as n from (select 'glossary_missing_' || term as flag from j where missing union all select 'glossary_forbidden_' || term from j where forbidden) group by flag""")
def j4_glossary(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).withColumn("candidate", candidate())
    return memory.glossary_flags(c, ["chunk_id"], table(spark, d, "glossary"), "source", "candidate").groupBy("flag").agg(F.count("*").alias("n"))


_EDGES = "(select speaker, addressee, arg_max(case register_hint when 'tu' then 'informal' else 'plural_or_formal_allowed' end, (loaded_at, chunk_id)) as hint from chunks where speaker <> '' and addressee <> '' and register_hint in ('tu', 'vous') group by speaker, addressee)"


@query(f"select chunk_id, case when coalesce(register_hint, '') = '' and speaker <> '' and addressee <> '' and {has(bare("coalesce(source, '')"), L.SECOND_PERSON)} and not {has(bare("coalesce(source, '')"), L.PLURAL_OR_FORMAL)} then coalesce(e.hint, b.hint, '') else coalesce(register_hint, '') end as register_hint from chunks c left join {_EDGES} e using (speaker, addressee) left join {_EDGES} b on b.speaker = c.addressee and b.addressee = c.speaker")
def j5_register_fallback(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    known = c.where("speaker <> '' and addressee <> '' and register_hint in ('tu', 'vous')").select("speaker", "addressee", "loaded_at", "chunk_id", F.when(F.col("register_hint") == "tu", "informal").otherwise("plural_or_formal_allowed").alias("hint"))
    edges = dialogue.last_by(known, ["speaker", "addressee"], ["loaded_at", "chunk_id"])
    return dialogue.register_fallback(c, edges).select("chunk_id", "register_hint")


@query()
def w6_dialogue_fold(spark: SparkSession, d: str) -> DataFrame:
    """The ordered fold over every chapter of chunks, and of the fixtures whose cast it is."""
    cast = dialogue.Cast([(a, c) for _, a, c in _FX_ALIAS], _FX_REL)
    c = current(spark, d).select(F.concat_ws("/", "book_id", "chapter").alias("doc"), F.col("chunk_idx").alias("idx"), "source")
    fx = _fx_chunk(spark).select(F.concat(F.lit("fx/"), F.col("doc").cast("string")).alias("doc"), "idx", "source")
    return dialogue.dialogue_fold(c.unionByName(fx), cast).select("doc", "idx", "speaker", "addressee", "register")


# --- caches and memories ------------------------------------------------------------------------------------------------------

_KEY = ["book_id", "chapter", "chunk_idx"]


@query("select chunk_id from chunks c semi join checkpoint_lines k using (book_id, chapter, chunk_idx)")
def j6_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return memory.hits(chunks(spark, d), table(spark, d, "checkpoint_lines"), _KEY).select("chunk_id")


@query("select chunk_id from chunks c anti join checkpoint_lines k using (book_id, chapter, chunk_idx)")
def j6_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return memory.misses(chunks(spark, d), table(spark, d, "checkpoint_lines"), _KEY).select("chunk_id")


@query("select book_id, chapter, chunk_idx, arg_max(line_id, (logged_at, line_id)) as line_id, arg_max(coalesce(translation, '<null>'), (logged_at, line_id)) as translation from checkpoint_lines group by all")
def src11_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """The line last logged for an index holds, null as it may be."""
    k = memory.last_checkpoint(table(spark, d, "checkpoint_lines"), _KEY, ["logged_at", "line_id"])
    return k.select(*_KEY, "line_id", F.coalesce("translation", F.lit("<null>")).alias("translation"))


@query("select entry_id from correction_memory where source <> '' and final <> '' order by entry_id desc limit 5000")
def src12_newest_corrections(spark: SparkSession, d: str) -> DataFrame:
    return memory.newest(table(spark, d, "correction_memory", "entry_id", "source", "final"), "entry_id").select("entry_id")


@query("select chunk_id from (select * from chunks where coalesce(final, '') <> '' and coalesce(final, '') <> coalesce(draft, '') and len(coalesce(flags, [])) = 0 qualify row_number() over (partition by coalesce(source, ''), coalesce(draft, ''), coalesce(final, '') order by chunk_id) = 1) c where not exists (select 1 from correction_memory m where coalesce(m.source, '') = coalesce(c.source, '') and coalesce(m.draft, '') = coalesce(c.draft, '') and coalesce(m.final, '') = coalesce(c.final, ''))")
def snk6_new_corrections(spark: SparkSession, d: str) -> DataFrame:
    return memory.new_corrections(chunks(spark, d), table(spark, d, "correction_memory", "source", "draft", "final"), "chunk_id").select("chunk_id")


@query("select book_id, speaker, addressee, arg_max(register_hint, (loaded_at, chunk_id)) as hint from chunks where speaker <> '' and addressee <> '' and register_hint <> '' group by all")
def snk7_register_edges(spark: SparkSession, d: str) -> DataFrame:
    return memory.book_state(chunks(spark, d), "book_id", ["loaded_at", "chunk_id"])["register_edges"]


@query("select book_id, character, count(*) as count from (select book_id, unnest(mentioned) as character from chunks) where character <> '' group by all")
def snk7_characters(spark: SparkSession, d: str) -> DataFrame:
    return memory.book_state(chunks(spark, d), "book_id", ["loaded_at", "chunk_id"])["characters"]


@query("select entity, form, n, n_forms from (select entity, form, count(*) as n, count(*) over (partition by entity) as n_forms, row_number() over (partition by entity order by count(*) desc, form) as r from (select speaker as entity, register_hint as form from chunks where speaker <> '' and register_hint <> '') group by entity, form) where r = 1")
def a21_best_form(spark: SparkSession, d: str) -> DataFrame:
    """Of each speaker, the register most often seen, and in how many registers."""
    f = chunks(spark, d).where("speaker <> '' and register_hint <> ''").groupBy(F.col("speaker").alias("entity"), F.col("register_hint").alias("form")).agg(F.count("*").alias("n"))
    return memory.best_form(f)


@query(f"""select entity, count(*) as n from (select ' ' || array_to_string({wrd("lower(coalesce(source, ''))")}, ' ') || ' ' as s, coalesce({CAND}, '') as c from chunks)
    join (select entity, ' ' || array_to_string({wrd("lower(entity)")}, ' ') || ' ' as e from (select distinct unnest(mentioned) as entity from chunks)) on contains(s, e) and contains(c, entity) where len({wrd("entity")}) > 0 group by entity""")
def j11_entity_forms(spark: SparkSession, d: str) -> DataFrame:
    e = chunks(spark, d).select(F.explode("mentioned").alias("entity")).where("entity <> ''").distinct()
    return memory.entity_forms(chunks(spark, d).withColumn("c", candidate()), e, "source", "c")


@query()
def j7_latest_exact(spark: SparkSession, d: str) -> DataFrame:
    """The newest correction of the same source with a near enough draft and no flag."""
    m = table(spark, d, "correction_memory", "entry_id", "source", "draft", "final")
    flags = _every_flag(spark, d, F.col("candidate"))
    return similarity.latest_exact(pipeline.with_cast(chunks(spark, d)), "chunk_id", m, "entry_id", flags).select("chunk_id", "entry")


_CT = lambda x: f"list_distinct(list_filter({tok(x)}, lambda w: length(w) > 2 and not list_contains({lst(L.STOPWORDS)}, w)))"
_J8 = f"""with t as (select entry_id, list_sort({_CT('source')}) as t from correction_memory where source is not null), m as (select entry_id, min(entry_id) over (partition by t) as rep, t from t where len(t) > 0),
    e as (select rep, len(t) as n, unnest(t) as w from m where rep = entry_id),
    j as (select x.rep as rep_a, y.rep as rep_b, count(*) as inter, any_value(x.n) + any_value(y.n) - count(*) as n_union from e x join e y on x.w = y.w and x.rep <> y.rep group by all having inter * 100 >= n_union * 56)"""


def _j8(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Classes of entries of equal source tokens, and their pairs that are as similar as an example has to be."""
    m = table(spark, d, "correction_memory", "entry_id", "source")
    return similarity.similar_classes(m, "entry_id", "source", int(L.MEMORY_THRESHOLD * 100), 100)


@query(_J8 + " select rep_a, rep_b, inter::int as inter, n_union::int as n_union from j")
def j8_similar(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes; j8_classes has their members."""
    return _j8(spark, d)[1].withColumnRenamed("union", "n_union")


@query(_J8 + " select entry_id, rep from m")
def j8_classes(spark: SparkSession, d: str) -> DataFrame:
    return _j8(spark, d)[0]


@query(_J8 + ", p as (select a.entry_id, b.entry_id as other, coalesce(j.inter / j.n_union, 1) as s from m a join m b on a.entry_id <> b.entry_id left join j on j.rep_a = a.rep and j.rep_b = b.rep where a.rep = b.rep or j.inter is not null) select entry_id, other, rank from (select entry_id, other, row_number() over (partition by entry_id order by s desc, other)::int as rank from p) where rank <= 3")
def t7_examples(spark: SparkSession, d: str) -> DataFrame:
    members, links = _j8(spark, d)
    return similarity.class_examples(members, "entry_id", links)


def _memory_similar(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "correction_memory", "entry_id", "source", "draft", "register_hint")
    return similarity.memory_similar(m, "entry_id", None, "other")


@query()
def j8_memory_similar(spark: SparkSession, d: str) -> DataFrame:
    """Entries as similar as an example has to be, by source, draft and register; j8_similar's SQL goes by sources alone."""
    return _memory_similar(spark, d).withColumn("similarity", F.round("similarity", 6))


@query()
def t7_memory_examples(spark: SparkSession, d: str) -> DataFrame:
    """The three best examples by source, draft and register; t7_examples' SQL goes by sources alone."""
    return similarity.top_examples(_memory_similar(spark, d), "entry_id", "other", F.col("similarity")).select("entry_id", "other", "rank")


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y)))) as e from (select vec_id, list_transform(embedding, lambda x: x::double) as embedding from embeddings)),
    p as (select a.vec_id, b.vec_id as nn_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 4) as s from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)
    select vec_id, nn_id, row_number() over (partition by vec_id order by s desc, nn_id)::int as rank from p qualify rank <= 5""")
def j9_knn(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest of every vector whose id is divisible by 100, against all."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    nn = similarity.knn(v.where("vec_id % 100 = 0"), "vec_id", v.withColumnRenamed("vec_id", "nn_id"), "nn_id", "embedding", 6)
    w = nn.where("vec_id <> nn_id").select("vec_id", "nn_id", F.row_number().over(_by("vec_id", F.col("rank"))).alias("rank"))
    return w.where("rank <= 5")


def _by(key: str, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


# --- reranking ----------------------------------------------------------------------------------------------------------------

_CANDS = f"""(select chunk_id, coalesce(source, '') as s, coalesce(draft, '') as d, x.ord as ord, x.name as name, x.txt as c from (select chunk_id, source, draft, unnest(list_concat(
    [{{ord: 0::bigint, name: 'current', txt: {CAND}}}, {{ord: 1::bigint, name: 'draft', txt: draft}}],
    coalesce(list_transform(list_sort(map_keys(alt_drafts)), lambda k, i: {{ord: (i + 1)::bigint, name: k, txt: alt_drafts[k]}}), []))) as x from chunks) where x.txt <> '')"""
_CSCORED = f"(select *, {score_sql('s', 'c', 'flags')} as score, len(list_filter(flags, lambda f: list_contains({lst(L.HARD_FLAGS)}, f))) as hard from (select *, {base_flags_sql('s', 'd', 'c')} as flags from {_CANDS}))"


def _cands(spark: SparkSession, d: str) -> DataFrame:
    return rerank.scored(rerank.candidates(chunks(spark, d), ["chunk_id"]), full=False)


@query(f"select chunk_id, name, hard::int as hard, score as score10 from {_CSCORED} qualify row_number() over (partition by chunk_id order by hard, score desc, ord) = 1")
def t2_rerank(spark: SparkSession, d: str) -> DataFrame:
    return rerank.rerank(_cands(spark, d), ["chunk_id"]).select("chunk_id", "name", "hard", "score10")


@query(f"select chunk_id, name, score as score10 from {_CSCORED} qualify row_number() over (partition by chunk_id order by score desc, ord) = 1")
def t3_qe_choose(spark: SparkSession, d: str) -> DataFrame:
    return rerank.choose_estimated(_cands(spark, d), ["chunk_id"], "score10").select("chunk_id", "name", "score10")


@query(f"""with r as (select book, list(name) as names from {_NAMES} group by book), w as (select c.*, list_filter(coalesce(r.names, []), lambda x: list_contains({wrd('s')}, x)) as names, {wrd('c')} as cw from {_CSCORED} c join chunks k using (chunk_id) left join r on r.book = k.book_id)
    select chunk_id, name, complete from (select *, len(list_filter(names, lambda x: not list_contains(cw, x))) = 0 as complete from w) qualify row_number() over (partition by chunk_id order by complete desc, score desc, ord) = 1""")
def t4_best_hypothesis(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate among those that keep the names of the book's registry, if any does."""
    names = profile.required_names(_chunk_blocks(spark, d)).withColumnRenamed("book", "book_id")
    cands = rerank.scored(rerank.candidates(chunks(spark, d).join(names, "book_id", "left"), ["chunk_id", "names"]), full=False)
    return rerank.best_hypothesis(cands, ["chunk_id"], F.coalesce("names", F.array().cast("array<string>"))).select("chunk_id", "name", "complete")


@query(f"with s as (select * from {_CSCORED}) select s.chunk_id, s.name, s.score + 80 >= b.score and not (s.hard > b.hard or (s.hard = b.hard and s.hard > 0)) as accepted from s join s b on b.chunk_id = s.chunk_id and b.ord = 1")
def t5_accepted(spark: SparkSession, d: str) -> DataFrame:
    return rerank.accept(_cands(spark, d), ["chunk_id"]).select("chunk_id", "name", "accepted")


# --- windows -----------------------------------------------------------------------------------------------------------------

_W = "over (partition by book_id, chapter order by chunk_idx rows between {} preceding and {} following)"


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    c = spread(table(spark, d, "chunks", *_CHUNK, "participants", "style_hints"))
    return dialogue.last_by(c, ["book_id", "chapter", "chunk_idx"], ["loaded_at", "chunk_id"])


_SAID = lambda c, n: f"case when {c} <> '' then '{n}=' || {c} end"
_LISTED = lambda c, n: f"case when len({c}) > 0 then '{n}=' || array_to_string({c}, '/') end"
_META = f"concat_ws(', ', {_SAID('speaker', 'speaker')}, {_SAID('addressee', 'addressee')}, {_SAID('register_hint', 'register')}, {_LISTED('participants', 'scene')}, {_LISTED('style_hints', 'rules')})"
_OTHERS = "list_sort(list_filter(map_entries(alt_drafts), lambda e: e.value <> ''))"
_TARGET = f"'TARGET META: ' || coalesce(nullif({_META}, ''), 'speaker=unknown') || chr(10) || 'TARGET SOURCE:' || chr(10) || coalesce(source, '') || chr(10) || 'TARGET DRAFT:' || chr(10) || coalesce(draft, '') || case when len({_OTHERS}) > 0 then chr(10) || 'TARGET ALTERNATE DRAFTS:' || chr(10) || array_to_string(list_transform({_OTHERS}, lambda e: e.key || ': ' || e.value), chr(10)) else '' end"


@query(f"""with c as (select *, 'CTX ' || chunk_idx || ' FRENCH:' || chr(10) || coalesce({CAND}, '') as shown, {_TARGET} as target from {CURRENT})
    select book_id, chapter, chunk_idx, md5(array_to_string(list_concat(coalesce(list(shown) over (w rows between 2 preceding and 1 preceding), []), [target], coalesce(list(shown) over (w rows between 1 following and 2 following), [])), chr(10) || chr(10))) as h
    from c window w as (partition by book_id, chapter order by chunk_idx)""")
def w1_context(spark: SparkSession, d: str) -> DataFrame:
    """The context text of every chunk, two neighbours on each side."""
    return windows.context_text(_contexts(spark, d), ["book_id", "chapter"], "chunk_idx", 2).select("book_id", "chapter", "chunk_idx", F.md5("context").alias("h"))


_UNITS = "(select unit_id, book_id, item_name, coalesce(block_pos, 0) as pos, coalesce(text, '') as t from units)"


@query(f"select unit_id, md5(coalesce(array_to_string(list_filter(list(t) over (partition by book_id, item_name order by pos, unit_id rows between 3 preceding and 1 preceding), lambda x: {trim('x')} <> ''), chr(10) || chr(10)), '')) as before, md5('<<<' || t || '>>>') as target from {_UNITS}")
def w2_preceding(spark: SparkSession, d: str) -> DataFrame:
    """The three blocks before every block, and the block as target."""
    w = windows.preceding_text(blocks(spark, d), ["book", "part"], ["pos", "id"], F.col("id").alias("unit_id"), "text", 3)
    return w.select("unit_id", F.md5("before").alias("before"), F.md5("target").alias("target"))


def _w3(k: int) -> str:
    return f"array_to_string(list(t) over (partition by book_id, item_name order by pos, unit_id rows between {k} preceding and {k} following), chr(10) || chr(10))"


@query(f"select unit_id, md5({_w3(3)}) as light, md5({_w3(8)}) as heavy from {_UNITS} where {trim('t')} <> ''")
def w3_chunk_chapter(spark: SparkSession, d: str) -> DataFrame:
    """Every block with its neighbours, three (light) and eight (heavy) on each side."""
    b = blocks(spark, d)
    light, heavy = (windows.chapter_windows(b, ["book", "part"], ["pos", "id"], "id", "text", m).select(F.col("id").alias("unit_id"), F.md5("chunk").alias(m)) for m in ("light", "heavy"))
    return light.join(heavy, "unit_id")


_KEPT = f"list_filter(string_split(regexp_replace(text, {q('([.!?])' + chr(92) + 's+([A-Z>' + chr(34) + '])')}, {q(chr(92) + '1' + chr(31) + chr(92) + '2')}, 'g'), chr(31)), lambda x: length({trim('x')}) >= 5)"


@query(f"select doc_id, case len({_KEPT}) when 0 then null when 1 then md5(({_KEPT})[1]) else md5({trim(f'array_to_string({_KEPT}, {q(chr(32))})')}) end as h from documents where text is not null")
def w3_sentence_chunk(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", F.md5(windows.sentence_chunk(F.col("text"))).alias("h"))


_COUNTS = f"(select book_id, chapter, count(*) as n from {CURRENT} group by all)"


@query(f"select book_id, chapter, s::int as start, least(n, s + 5)::int as end from (select book_id, chapter, n, unnest(range(0, n, 3)) as s from {_COUNTS}) where least(n, s + 5) - s >= 2")
def w4_hop_windows(spark: SparkSession, d: str) -> DataFrame:
    n = current(spark, d).groupBy("book_id", "chapter").agg(F.count("*").alias("n"))
    return windows.hop_windows(n, ["book_id", "chapter"])


@query(f"select distinct book_id, chapter, greatest(0, e - 5)::int as start, e::int as end from (select book_id, chapter, least(n, greatest(0, pos - 2) + 5) as e from (select book_id, chapter, count(*) over (partition by book_id, chapter) as n, row_number() over (partition by book_id, chapter order by chunk_idx) - 1 as pos, source from {CURRENT}) where regexp_matches(coalesce(source, ''), {q(SPEECH)})) where e - greatest(0, e - 5) >= 2")
def w4_centred(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("book_id", "chapter")
    c = current(spark, d).select("book_id", "chapter", "source", F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy("chunk_idx")) - 1).alias("pos"))
    return windows.centred_windows(c.where(T.has_speech(F.coalesce("source", F.lit("")))), ["book_id", "chapter"])


_TOKENS = r"greatest(1, len(list_filter(string_split_regex(coalesce(source, ''), '\s+'), lambda w: w <> '')), ceil(length(coalesce(source, '')) / 4.0)::int)::int"


@query(f"""with recursive r as (select book_id, chapter, {_TOKENS} as tokens, row_number() over (partition by book_id, chapter order by length(coalesce(source, '')), chunk_id) as k from {CURRENT}),
    b as (select book_id, chapter, k, tokens, 0 as batch, 1 as held, tokens as used from r where k = 1 union all
          select r.book_id, r.chapter, r.k, r.tokens, case when b.used + r.tokens > 120 or b.held >= 4 then b.batch + 1 else b.batch end, case when b.used + r.tokens > 120 or b.held >= 4 then 1 else b.held + 1 end, case when b.used + r.tokens > 120 or b.held >= 4 then r.tokens else b.used + r.tokens end
          from b join r on r.book_id is not distinct from b.book_id and r.chapter is not distinct from b.chapter and r.k = b.k + 1)
    select book_id, chapter, batch, count(*) as n, sum(tokens)::bigint as tokens from b group by all""")
def w8_batches(spark: SparkSession, d: str) -> DataFrame:
    b = windows.batches(current(spark, d), ["book_id", "chapter"], "chunk_id", "source", 120, 4)
    return b.groupBy("book_id", "chapter", "batch").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


_SHORT = rf"({trim(bare("coalesce(source, '')"))} <> '' and length({trim(bare("coalesce(source, '')"))}) <= 60 and len(list_filter(string_split_regex(source, '\s+'), lambda w: w <> '')) <= 12)"


@query(f"""with c as (select book_id, chapter, chunk_idx, coalesce({_SHORT}, false) as short from {CURRENT}),
    r as (select *, sum(case when short and prev then 0 else 1 end) over (partition by book_id, chapter order by chunk_idx) as run from (select *, lag(short, 1, false) over (partition by book_id, chapter order by chunk_idx) as prev from c)),
    g as (select *, (row_number() over (partition by book_id, chapter, run order by chunk_idx) - 1) // 4 as part from r)
    select book_id, chapter, chunk_idx, short, min(chunk_idx) over (partition by book_id, chapter, run, part) as "group" from g""")
def w9_groups(spark: SparkSession, d: str) -> DataFrame:
    return windows.short_groups(current(spark, d), ["book_id", "chapter"], "chunk_idx", "source")


_SAMPLE = f"(select id from (select id, pos, greatest(1, n // 20) as step from (select id, count(*) over (partition by book) as n, row_number() over (partition by book order by id) - 1 as pos from {BLOCKS})) where pos % step = 0 and pos // step < 20)"


@query(f"select id from (select id, pos, greatest(1, n // 20) as step from (select id, count(*) over (partition by book) as n, row_number() over (partition by book order by id) - 1 as pos from {BLOCKS})) where pos % step = 0 and pos // step < 20")
def w10_sample(spark: SparkSession, d: str) -> DataFrame:
    return windows.systematic_sample(blocks(spark, d), ["book"], "id").select("id")


# --- books --------------------------------------------------------------------------------------------------------------------


@query(f"select book, name, n, rank::int as rank from {_NAMES}")
def a1_names(spark: SparkSession, d: str) -> DataFrame:
    return profile.chapter_names(_chunk_blocks(spark, d))


def delimited(x: str) -> str:
    """x with every word between chr(30) and chr(31), by which patterns see whole words."""
    return rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_]+)', chr(30) || '\1' || chr(31), 'g')"


def undelimited(xs: str) -> str:
    return f"list_transform({xs}, lambda x: replace(replace(x, chr(30), ''), chr(31), ''))"


_RUNS = undelimited(rf"regexp_extract_all({delimited(bare("coalesce(source, '')"))}, chr(30) || '[A-Z][a-z]+' || chr(31) || '(?:\s+' || chr(30) || '[A-Z][a-z]+' || chr(31) || ')?')")


@query(f"select book, name, count(*) as n from (select book_id as book, unnest({_RUNS}) as name from chunks) where not list_contains({lst(L.NAME_STOPWORDS)}, name) group by book, name")
def a2_name_candidates(spark: SparkSession, d: str) -> DataFrame:
    return profile.name_candidates(_chunk_blocks(spark, d))


@query("select distinct book, k.term, k.preferred from (select book_id as book, lower({b}) as t from chunks) join (values {v}) k(term, preferred) on contains(t, k.term)".format(b=bare("coalesce(source, '')"), v=", ".join(f"({q(a)}, {q(b)})" for a, b in L.KNOWN_TERMS.items())))
def a3_known_terms(spark: SparkSession, d: str) -> DataFrame:
    return profile.known_terms(_chunk_blocks(spark, d))


_SENT = r"(select book, id, generate_subscripts(ss, 1) - 1 as k, unnest(ss) as sentence from (select book, id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)) as ss from {b}))".format(b=BLOCKS)
_MID = rf"(select distinct book, name from (select book, regexp_replace(unnest(list_filter(string_split_regex(sentence, '\s+'), lambda w: w <> '')[2:]), '[^A-Za-z\-'']', '', 'g') as name from {_SENT}) where regexp_full_match(name, '[A-Z].{{2,}}') and upper(name) <> name and not list_contains({lst(L.NAME_STOPWORDS)}, name))"
_FREQ = f"(select book, name, count(*) as n from (select book, unnest({wrd("coalesce(text, '')")}) as name from {BLOCKS}) semi join {_MID} using (book, name) group by book, name)"
_TOP = f"(select f.book, name, n from {_FREQ} f join (select book, greatest(5, count(*) // 30) as least_n from {BLOCKS} group by book) l on l.book = f.book where n >= least_n)"


@query(f"select book, name, n from {_TOP}")
def a4_frequent_names(spark: SparkSession, d: str) -> DataFrame:
    return profile.frequent_names(blocks(spark, d))


_WIN = f"(select book, id, array_to_string(list(coalesce(text, '')) over (partition by book, part order by pos, id rows between 1 preceding and 1 following), ' ') as win from {BLOCKS})"
_PRES = f"(select distinct book, id, name from (select book, id, unnest({wrd('win')}) as name from {_WIN}) semi join {_TOP} using (book, name))"


_SWIN = r"(select book, {w} as words, {m} as m, {f} as f from (select book, array_to_string(list(sentence) over (partition by book order by part, pos, id, k rows between 1 preceding and 1 following), ' ') as win from (select book, part, pos, id, generate_subscripts(ss, 1) as k, unnest(ss) as sentence from (select *, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)) as ss from {b}))))".format(
    w=f"list_distinct({wrd('win')})", m=count_in(wrd("lower(win)"), L.MALE), f=count_in(wrd("lower(win)"), L.FEMALE), b=BLOCKS
)


@query(f"select book, name, sum(m)::bigint as m, sum(f)::bigint as f, case when sum(m) * 2 > sum(f) * 3 then 'male' when sum(f) * 2 > sum(m) * 3 then 'female' else 'neutral' end as gender from (select book, unnest(words) as name, m, f from {_SWIN}) semi join {_TOP} using (book, name) group by book, name")
def a5_genders(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return profile.genders(b, profile.frequent_names(b))


_AFF = f"(select c.book, a, b, cooc, x.n as solo_a, y.n as solo_b from (select p.book, p.name as a, r.name as b, count(*) as cooc from {_PRES} p join {_PRES} r on p.book = r.book and p.id = r.id and p.name < r.name group by all) c join (select book, name, count(*) as n from {_PRES} group by all) x on x.book = c.book and x.name = a join (select book, name, count(*) as n from {_PRES} group by all) y on y.book = c.book and y.name = b)"


@query(f"select * from {_AFF}")
def j10_affinity(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return profile.affinity(b, profile.frequent_names(b))


_OUT = r"[^\p{L}\p{N}_\n]"
_CLOSE = f"(select distinct n.book, n.name from {_TOP} n join {BLOCKS} b on b.book = n.book and regexp_matches(coalesce(b.text, ''), {q('(?:^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])')} || n.name || {q(f'(?:{_OUT}|{_OUT}[^' + chr(92) + f'n]{{0,78}}{_OUT})(?i:{L.INTIMATE})')}))"
_RELATIONS = f"(select book, a, b, type from (select f.book, a, b, case when x.name is not null or y.name is not null or cooc * cooc >= 0.3025 * solo_a * solo_b then 'intimate_partner' when cooc * cooc >= 0.0625 * solo_a * solo_b then 'friends' when cooc * cooc >= 0.0064 * solo_a * solo_b then 'acquaintance' end as type from {_AFF} f left join {_CLOSE} x on x.book = f.book and x.name = a left join {_CLOSE} y on y.book = f.book and y.name = b) where type is not null)"


@query(f"select book, a, b, type from {_RELATIONS} union all select book, b as a, a as b, type from {_RELATIONS}")
def a6_relationships(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return profile.relationships(b, profile.frequent_names(b))


@query(f"""with w as (select distinct book, id, k, unnest({wrd('sentence')}) as word from {_SENT}), others as (select book, name from {_MID} anti join {_TOP} using (book, name)),
    co as (select a.book, a.word as alias, c.word as canonical, count(*) as n from (select w.* from w semi join others o on o.book = w.book and o.name = w.word) a join (select w.* from w semi join {_TOP} t on t.book = w.book and t.name = w.word) c using (book, id, k) group by all),
    t as (select *, sum(n) over (partition by book, alias)::bigint as total, row_number() over (partition by book, alias order by n desc, canonical) as r from co)
    select book, alias, canonical, n, total from t where r = 1 and n >= 3 and n * 10 > total * 6""")
def a7_aliases(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return profile.aliases(b, profile.frequent_names(b))


def _upto_sql(n: int) -> str:
    run = "sum(length(coalesce(text, '')) + 1) over (partition by book order by part, pos, id rows between unbounded preceding and current row) - length(coalesce(text, '')) - 1"
    return f"(select book, left(text, ({n} - off)::int) as text from (select book, coalesce(text, '') as text, {run} as off from {BLOCKS}) where off < {n})"


def _phr(alts: str) -> str:
    return rf"len(list_filter(regexp_extract_all(replace(' ' || array_to_string({wrd('lower(text)')}, '  ') || ' ', '  ', '  '), {q(' (?:' + alts.replace(' ', '  ') + ') ')}), lambda x: true))"


@query(f"select book, sum({_phr(L.FIRST_PERSON)})::bigint as fp, sum({_phr(L.THIRD_PERSON)})::bigint as tp, case when sum({_phr(L.FIRST_PERSON)}) * 2 > sum({_phr(L.THIRD_PERSON)}) * 3 then 'first_person' else 'third_person' end as pov from {_upto_sql(30000)} group by book")
def a8_point_of_view(spark: SparkSession, d: str) -> DataFrame:
    return profile.point_of_view(blocks(spark, d))


@query(f"select book, sum({count_in(wrd('lower(text)'), L.PAST_TENSE)})::bigint as past, sum({count_in(wrd('lower(text)'), L.PRESENT_TENSE)})::bigint as present, case when sum({count_in(wrd('lower(text)'), L.PAST_TENSE)}) >= sum({count_in(wrd('lower(text)'), L.PRESENT_TENSE)}) then 'past' else 'present' end as tense from {_upto_sql(50000)} group by book")
def a8_tense(spark: SparkSession, d: str) -> DataFrame:
    return profile.tense(blocks(spark, d))


@query(f"select book, sum(case when regexp_matches(coalesce(text, ''), '[\"“«]') then 1 else 0 end)::bigint as n_dialogue, count(*) as n_blocks from {BLOCKS} group by book")
def a9_dialogue(spark: SparkSession, d: str) -> DataFrame:
    return profile.dialogue_share(blocks(spark, d))


@query(rf"select book, place, n from (select book, place, count(*) as n from (select book, unnest(regexp_extract_all(coalesce(text, ''), '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{L.PLACE_PREPOSITIONS})\s+([A-Z][a-z]{{2,}}(?:\s+[A-Z][a-z]+)*)', 1)) as place from {BLOCKS}) group by book, place qualify row_number() over (partition by book order by n desc, place) <= 20) where n >= 2")
def a10_places(spark: SparkSession, d: str) -> DataFrame:
    return profile.locations(blocks(spark, d))


_ACRONYMS = f"list_filter({wrd("coalesce(text, '')")}, lambda w: regexp_full_match(w, '[A-Z]{{2,6}}'))"
_AFTER_THE = undelimited(rf"regexp_extract_all({delimited("coalesce(text, '')")}, chr(30) || 'the' || chr(31) || '\s+(' || chr(30) || '[A-Z][a-z]+' || chr(31) || '(?:\s+' || chr(30) || '[A-Z][a-z]+' || chr(31) || '){{0,3}})', 1)")


@query(f"select book, name, n from (select book, name, count(*) as n from (select book, unnest(list_concat({_ACRONYMS}, {_AFTER_THE})) as name from {BLOCKS}) group by book, name qualify row_number() over (partition by book order by n desc, name) <= 20) where n >= 3")
def a10_organisations(spark: SparkSession, d: str) -> DataFrame:
    return profile.organisations(blocks(spark, d))


@query("select book, domain, array_to_string(list_sort(list(distinct word))[1:20], ',') as words from (select distinct book, unnest({w}) as word from {b}) join (values {v}) v(domain, word) using (word) group by book, domain having count(distinct word) >= 3".format(w=asc("coalesce(text, '')", 3), b=BLOCKS, v=", ".join(f"({q(a)}, {q(w)})" for a, ws in L.DOMAINS.items() for w in dict.fromkeys(ws.split()))))
def a11_domains(spark: SparkSession, d: str) -> DataFrame:
    return profile.domains(blocks(spark, d)).withColumn("words", F.array_join("words", ","))


_GRAM = lambda k: f"list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))"


@query(f"select book, phrase, n, row_number() over (partition by book order by n desc, phrase)::int as rank from (select book, phrase, count(*) as n from (select book, unnest(list_concat({_GRAM(2)}, {_GRAM(3)})) as phrase from (select book, {asc("coalesce(text, '')", 2)} as w from {BLOCKS})) group by all having count(*) >= 4) where not list_contains({lst(L.STOPWORDS)}, split_part(phrase, ' ', 1)) qualify rank <= 30")
def a12_phrases(spark: SparkSession, d: str) -> DataFrame:
    return profile.recurring_phrases(blocks(spark, d))


_SAYS = "(?:^|[^\\p{L}\\p{N}_])"
_GAP = "[^\\p{L}\\p{N}_.\\n]"
_SPOKEN = "regexp_extract_all(coalesce(text, ''), '[\"“]([^\"“”]{5,200})[\"”]', 1)"
_SPEECH_COUNTS = f"(select book, name, sum(nq)::bigint as n_quotes, sum(nw)::bigint as n_words from (select n.book, n.name, len({_SPOKEN}) as nq, coalesce(list_sum(list_transform({_SPOKEN}, lambda x: len(list_filter(string_split_regex(x, {q(chr(92) + 's+')}), lambda y: y <> '')))), 0) as nw from {BLOCKS} b join {_TOP} n on n.book = b.book and regexp_matches(coalesce(text, ''), {q(_SAYS)} || n.name || {q(f'(?:{_GAP}|{_GAP}[^.' + chr(92) + f'n]{{0,58}}{_GAP})(?i:said|asked|replied|shouted|whispered)(?:$|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])')})) group by all)"
_SPEECH_WORDS = f"(select book, name, string_agg(word, ',' order by r) as words from (select *, row_number() over (partition by book, name order by r) as k from (select book, name, word, row_number() over (partition by book, name order by count(*) desc, word) as r from (select b.book, n.name, unnest(list_filter({wrd(f"lower(array_to_string({_SPOKEN}, ' '))")}, lambda w: regexp_full_match(w, '[a-z]{{3,}}'))) as word from {BLOCKS} b join {_TOP} n on n.book = b.book and list_contains({wrd("lower(coalesce(text, ''))")}, lower(n.name))) group by book, name, word) where r <= 10 and not list_contains({lst(L.STOPWORDS)}, word)) where k <= 5 group by book, name)"


@query(f"select book, name, n_quotes, n_words from {_SPEECH_COUNTS}")
def a13_speech(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return profile.character_speech(b, profile.frequent_names(b))


@query(f"""select book, name, n, coalesce(gender, 'neutral') as gender, coalesce(round(n_words / greatest(n_quotes, 1), 1), 0) as mean_words, coalesce(words, '') as words
    from {_TOP} left join ({ORACLES['a5_genders']}) g using (book, name) left join {_SPEECH_COUNTS} using (book, name) left join {_SPEECH_WORDS} using (book, name)""")
def a13_characters(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return profile.character_profiles(b, profile.frequent_names(b)).withColumn("words", F.array_join("words", ","))


_KNOWN_TERMS = "(select distinct book, k.term, k.preferred from (select book, lower({b}) as t from {blocks}) join (values {v}) k(term, preferred) on contains(t, k.term))".format(b=bare("coalesce(text, '')"), blocks=BLOCKS, v=", ".join(f"({q(a)}, {q(b)})" for a, b in L.KNOWN_TERMS.items()))
_PHRASES = f"(select book, phrase, n, row_number() over (partition by book order by n desc, phrase)::int as rank from (select book, phrase, count(*) as n from (select book, unnest(list_concat({_GRAM(2)}, {_GRAM(3)})) as phrase from (select book, {asc("coalesce(text, '')", 2)} as w from {BLOCKS})) group by all having count(*) >= 4) where not list_contains({lst(L.STOPWORDS)}, split_part(phrase, ' ', 1)) qualify rank <= 30)"


@query(f"""with k as (select book, term, preferred, 1 as k from {_KNOWN_TERMS} union all
        select distinct book, w as term, (map {{{', '.join(f'{q(a)}: {q(b)}' for a, b in L.DOMAIN_FRENCH.items())}}})[w] as preferred, 2 from (select book, unnest({asc("coalesce(text, '')", 1)}) as w from {BLOCKS}) where list_contains({lst(L.DOMAIN_FRENCH)}, w) union all
        select book, phrase, '', 3 from {_PHRASES} where rank <= 10 and len(list_filter(string_split(phrase, ' '), lambda w: list_contains({lst(L.STOPWORDS)}, w))) = 0)
    select book, regexp_replace(term, '[^a-z0-9]+', '_', 'g') as term, arg_min(preferred, k) as preferred from k group by 1, 2""")
def a14_glossary_rules(spark: SparkSession, d: str) -> DataFrame:
    return profile.glossary_rules(blocks(spark, d))


@query(f"select book, name, round(avg((high - low) / greatest(high + low, 1)), 6) as dominance from (select book, {_HIGH('text')} as high, {_LOW('text')} as low, unnest(list_distinct({wrd("coalesce(text, '')")})) as name from {BLOCKS}) semi join {_TOP} using (book, name) group by book, name")
def a16_dominance(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return profile.entity_dominance(b, profile.frequent_names(b)).withColumn("dominance", F.round("dominance", 6))


_SEM = f"(select b.book, b.id, coalesce(text, '') as text, {_FID('text')} >= 4 as fid, {has("coalesce(text, '')", L.FORMAL_POLITENESS)} as f, {has("coalesce(text, '')", L.INFORMAL_POLITENESS)} as i, {asc("coalesce(text, '')", 3)} as w from {BLOCKS} b semi join {_SAMPLE} using (id))"
_HITS = ", ".join(f"{{emotion: {q(e)}, k: {k}, n: {count_in('w', ws.split())}}}" for k, (e, ws) in enumerate(L.EMOTIONS.items()))
_ARC = f"(select book, id, emotion, k, round(n / total, 3) as score from (select *, sum(n) over (partition by id) as total, row_number() over (partition by id order by n desc, k) as r from (select book, id, unnest([{_HITS}], recursive := true) from {_SEM}) t(book, id, emotion, k, n) where n > 0) where r <= 4)"
_MOOD = f"round(avg(case when len(w) = 0 then 0 else round(({count_in('w', _of(L.POSITIVE))} - {count_in('w', _of(L.NEGATIVE))}) / len(w) * 10, 3) end), 3)"
_ACTED = f"(select book, unnest(case when len(acts) > 1 then list_filter(acts, lambda a: a <> 'assertion') else acts end) as act from (select book, {_ACTS.replace('(source', '(text').replace('source,', 'text,')} as acts from {_SEM}))"
_LISTED_COUNTS = lambda x, what: f"(select book, string_agg({what} || ':' || n, ',' order by n desc, {what}) as {what}s from (select book, {what}, count(*) as n from {x} group by book, {what}) group by book)"
_ASPECTED = f"(select book, aspect from (select book, {_ASPECT} as aspect from (select book, {_INF} as inf from (select book, unnest({_past_sql('text')}) as v from {_SEM}))) where aspect is not null)"


@query(f"""with e as (select book, emotion, k, round(sum(score), 6) as n from {_ARC} group by all), t as (select book, string_agg(emotion, ',' order by n desc, k) as top_emotions from (select * from e qualify row_number() over (partition by book order by n desc, k) <= 3) group by book)
    select book, n_sampled, n_fid, round(n_fid / n_sampled, 2) as fid_ratio, sentiment, coalesce(top_emotions, '') as top_emotions, case when formal > 2 * informal then 'formal' when informal > 2 * formal then 'informal' else 'mixed' end as register, coalesce(acts, '') as acts, coalesce(aspects, '') as aspects
    from (select book, count(*) as n_sampled, count(*) filter (fid) as n_fid, count(*) filter (f and not i) as formal, count(*) filter (i and not f) as informal, {_MOOD} as sentiment from {_SEM} group by book) left join t using (book) left join {_LISTED_COUNTS(_ACTED, 'act')} using (book) left join {_LISTED_COUNTS(_ASPECTED, 'aspect')} using (book)""")
def a17_semantic_profile(spark: SparkSession, d: str) -> DataFrame:
    p = profile.semantic_profile(blocks(spark, d)).withColumn("top_emotions", F.array_join("top_emotions", ","))
    shown = lambda c, what: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(x[what], F.lit(":"), x["n"].cast("string"))), ","), F.lit(""))
    return p.withColumns({"acts": shown("acts", "act"), "aspects": shown("aspects", "aspect")})


@query(f"select book, id, emotion, score from {_ARC}")
def a17_emotional_arc(spark: SparkSession, d: str) -> DataFrame:
    return profile.emotional_arc(profile.semantic_sample(blocks(spark, d)))


@query(f"""with h as (select distinct s.book, s.id, t.name from (select book, id, unnest({wrd('lower(text)')}) as w from {_SEM}) s join {_TOP} t on t.book = s.book and lower(t.name) = s.w),
    e as (select h.book, name, emotion, round(sum(score), 6) as n from h join {_ARC} a on a.book = h.book and a.id = h.id group by all)
    select book, name, emotion, round(n / greatest(sum(n) over (partition by book, name), 1), 3) as share from e qualify row_number() over (partition by book, name order by n desc, emotion) <= 3""")
def a17_entity_emotions(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return profile.entity_emotions(profile.semantic_sample(b), profile.frequent_names(b))


@query()
def a17_hints(spark: SparkSession, d: str) -> DataFrame:
    return profile.semantic_hints(profile.semantic_profile(blocks(spark, d)))


@query(f"select book_id, flag, count(*) as n from (select book_id, unnest(list_concat({base_flags_sql('s', 'd', 'c')}, {style_flags_sql('s', 'c')})) as flag from {PAIRS}) group by all")
def a18_flag_histogram(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("book_id", F.concat(Q.base_flags(F.col("source"), F.col("draft"), candidate()), Q.style_flags(F.col("source"), candidate())).alias("flags"))
    return evaluate.flag_histogram(c, ["book_id"])


@query()
def a18_chapter_report(spark: SparkSession, d: str) -> DataFrame:
    c = pipeline.with_cast(chunks(spark, d)).withColumn("flags", _every_flag(spark, d)).drop("names", "who")
    return evaluate.chapter_report(c, ["book_id", "chapter"]).withColumn("flag_counts", F.to_json("flag_counts"))


_N = lambda x: trim(sub(f"lower({x})", (r"\s+", " ")))


_OVERLAP = f"""with p as (select entry_id, {_N('draft')} as a, {_N('final')} as b, unnest(range(1, 7)) as width from correction_memory where draft is not null and final is not null),
    g as (select entry_id, width, 0 as side, unnest(case when length(a) < width then [a] else list_transform(range(1, length(a) - width + 2), lambda i: substr(a, i, width)) end) as gram from p where a <> '' and b <> '' union all
          select entry_id, width, 1, unnest(case when length(b) < width then [b] else list_transform(range(1, length(b) - width + 2), lambda i: substr(b, i, width)) end) from p where a <> '' and b <> ''),
    c as (select entry_id, width, gram, count(*) filter (side = 0) as n0, count(*) filter (side = 1) as n1 from g group by all)
    select entry_id, width::int as width, sum(least(n0, n1))::bigint as overlap, sum(n0)::bigint as n_cand, sum(n1)::bigint as n_ref from c group by all"""


@query(_OVERLAP)
def a19_chrf_overlap(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "correction_memory", "entry_id", "draft", "final").where("draft is not null and final is not null")
    return similarity.ngram_overlap(m, ["entry_id"], "draft", "final")


@query(f"""with o as ({_OVERLAP}), p as (select entry_id, overlap / greatest(1, n_cand) as p, overlap / greatest(1, n_ref) as r from o)
    select entry_id, round(avg(case when p + r = 0 then 0 else 5 * p * r / (4 * p + r) end) * 100, 4) as chrf from p group by entry_id""")
def a19_chrf(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "correction_memory", "entry_id", "draft", "final")
    return similarity.chrf(similarity.ngram_overlap(m, ["entry_id"], "draft", "final"), ["entry_id"]).withColumn("chrf", F.round("chrf", 4))


@query(f"select chunk_id, len(a)::int as n_words, len(list_intersect(a, b))::int as n_matched, (len(b) - len({tok('s')}))::int as shift from (select chunk_id, s, list_distinct(list_filter({tok('s')}, lambda w: length(w) >= 3)) as a, {tok('c')} as b from {PAIRS})")
def a22_alignment_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.alignment_stats(chunks(spark, d).withColumn("c", candidate()), ["chunk_id"], "source", "c")


@query(f"select word, count(*) as n from (select unnest({asc("coalesce(text, '')", 3)}) as word from {BLOCKS}) where not list_contains({lst(L.STOPWORDS)}, word) group by word order by n desc, word limit 20")
def a23_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.term_counts(blocks(spark, d))


@query()
def a24_profile(spark: SparkSession, d: str) -> DataFrame:
    p = profile.profile(blocks(spark, d))
    return p.withColumns({c: F.to_json(c) for c, t in p.dtypes if t.startswith("array")})


# --- sets, models, pages ---------------------------------------------------------------------------------------------------------


@query("select chunk_id, array_to_string(list_sort(list_distinct(list_filter(mentioned, lambda x: x <> ''))), ',') as names from chunks where mentioned is not null")
def set1_distinct(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where("mentioned is not null").select("chunk_id", F.array_join(F.array_sort(T.ordered_distinct(F.col("mentioned"))), ",").alias("names"))


@query("select term, 'glossary' as origin from glossary union all select k.term, 'known' from (values {v}) k(term) where k.term not in (select term from glossary)".format(v=", ".join(f"({q(a)})" for a in L.KNOWN_TERMS)))
def set3_left_union(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(t, "known") for t in L.KNOWN_TERMS], "term string, origin string")
    return memory.left_union(table(spark, d, "glossary", "term").withColumn("origin", F.lit("glossary")), known, "term")


@query("select chunk_id, '[Translated ' || source || ']' as output from chunks where source is not null")
def u1_stub_model(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).where("source is not null")
    return models.infer(c, ["chunk_id"], "source", models.Stub()).select("chunk_id", F.element_at("outputs", 1).alias("output"))


@query()
def u17_literary_pipeline(spark: SparkSession, d: str) -> DataFrame:
    patcher = models.Substitution([('"', ""), ("...", "…")], "patcher")
    plain = models.Substitution([("  ", " ")], "editor")
    by = pipeline.Editors(patcher, plain, plain, plain, plain, plain)
    m = table(spark, d, "correction_memory", "entry_id", "source", "draft", "final")
    r = pipeline.literary(chunks(spark, d), by, table(spark, d, "glossary"), m)
    return r.select("chunk_id", F.col("final").alias("current"), (F.col("final") != F.col("draft")).alias("changed"))


_FX_HTML = "<html><head><title>T</title><style>p{}</style></head><body><h1>Chapter Two</h1><p>One <em>two</em> three.<br/>Four &amp; five.</p><div><p>x</p></div><ul><li>Item <b>bold</b></li></ul></body></html>"


def _fx_html(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, _FX_HTML), (2, "<p>a<p>b bc"), (3, None)], "page_id bigint, html string")


@query("select * from (values (1, 'Chapter Two'), (2, ''), (3, '')) t(page_id, heading)")
def proj5_first_heading(spark: SparkSession, d: str) -> DataFrame:
    return _fx_html(spark).select(F.col("page_id").cast("int").alias("page_id"), T.first_heading(F.coalesce("html", F.lit(""))).alias("heading"))


@query("select * from (values (1, 1, 'h1', 'Chapter Two', 'Chapter Two'), (1, 2, 'p', 'One two three. Four & five.', 'One [[ZXEM1X]]two[[/ZXEM1X]] three.Four & five.'), (1, 3, 'li', 'Item bold', 'Item [[ZXB1X]]bold[[/ZXB1X]]'), (2, 1, 'p', 'b bc', 'b bc')) t(page_id, block_pos, tag, text, marked_text)")
def proj1_html_units(spark: SparkSession, d: str) -> DataFrame:
    return html.units_of(_fx_html(spark), "page_id", "html").select(F.col("id").cast("int").alias("page_id"), "block_pos", "tag", "text", "marked_text")


@query("select * from (values (1, 'T Chapter Two' || chr(10) || 'One two three.' || chr(10) || 'Four & five.' || chr(10) || 'x' || chr(10) || 'Item bold'), (2, 'a b bc')) t(page_id, text)")
def src5_html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return _fx_html(spark).where("html is not null").select(F.col("page_id").cast("int").alias("page_id"), T.html_text(F.col("html")).alias("text"))


_FX_ITEMS = [("b", 1, "OEBPS/cover.xhtml", "c", "<h1>Chapter 2</h1>"), ("b", 2, "OEBPS/ch_1.xhtml", "i1", "<h1>Chapter One</h1>"), ("b", 3, "OEBPS/chapter-two.xhtml", "i2", "<h1>Second</h1>"), ("b", 4, "OEBPS/x.xhtml", "i3", "<title>chap 2</title>")]


@query("select * from (values ('OEBPS/cover.xhtml', -1000, false), ('OEBPS/ch_1.xhtml', 0, false), ('OEBPS/chapter-two.xhtml', 100, true), ('OEBPS/x.xhtml', 160, false)) t(name, score, by_name)")
def t1_pick_chapter(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame(_FX_ITEMS, "book_id string, spine_pos int, name string, item_id string, content string")
    return x.select("name", epub.chapter_score(F.col("name"), F.col("item_id"), F.col("content"), 2).alias("score"), F.coalesce(T.chapter_number(epub.stem(F.col("name"))) == 2, F.lit(False)).alias("by_name"))


# --- extensions: built-in Spark, not part of the record model ------------------------------------------------------------------------


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def ext_event_windows(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.memory import event_counts

    e = event_counts(table(spark, d, "events", "ts", "event_type", "value"))
    return e.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select book_id, chapter, count(*) as n from (select book_id, chapter, unnest(flags) from chunks) group by rollup (book_id, chapter)")
def ext_flag_rollup(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.flag_rollup(table(spark, d, "chunks", "book_id", "chapter", "flags"), "book_id", "chapter")


# --- memos and pipelines ------------------------------------------------------------------------------------------------------------------


@query("select * from (values ('', true), ('OK.', true), ('ok. fine', true), ('Not ok', false), ('Aucun problème', true)) t(critique, is_ok)")
def proj20_critique(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([("",), ("OK.",), ("ok. fine",), ("Not ok",), ("Aucun problème",)], "critique string")
    return x.select("critique", memo.critique_is_ok(F.col("critique")).alias("is_ok"))


@query(f"""with s as (select book_id, chapter, list(line order by chunk_idx, line)[1:24] as lines from (select book_id, chapter, chunk_idx, '- ' || chunk_idx || ': speaker=' || coalesce(nullif(speaker, ''), 'unknown') || ', addressee=' || coalesce(nullif(addressee, ''), 'unknown') || ', register=' || coalesce(nullif(register_hint, ''), 'default') as line from {CURRENT} where speaker <> '' or addressee <> '' or register_hint <> '') where chunk_idx is not null group by all),
    n as (select book as book_id, string_agg(name, ', ' order by rank) as kept from {_NAMES} where rank <= 20 group by book), t as (select book as book_id, string_agg('- ' || term || ' -> ' || preferred, chr(10) order by '- ' || term || ' -> ' || preferred) as known from (select distinct book, k.term, k.preferred from (select book_id as book, lower({bare("coalesce(source, '')")}) as x from chunks) join (values {', '.join(f'({q(a)}, {q(b)})' for a, b in L.KNOWN_TERMS.items())}) k(term, preferred) on contains(x, k.term)) group by book)
    select book_id, chapter, concat_ws(chr(10), 'Chapter: ' || chapter, 'Names to keep unchanged: ' || kept, 'Glossary:' || chr(10) || known, 'Dialogue state:' || chr(10) || array_to_string(lines, chr(10))) as memo from (select distinct book_id, chapter from {CURRENT}) left join n using (book_id) left join t using (book_id) left join s using (book_id, chapter)""")
def proj22_chapter_memos(spark: SparkSession, d: str) -> DataFrame:
    b = _chunk_blocks(spark, d)
    return memo.chapter_memo(current(spark, d), profile.chapter_names(b), profile.known_terms(b))


@query("select book_id, 'Book memory:' || chr(10) || 'Registers:' || chr(10) || string_agg(l, chr(10) order by l) as summary from (select book_id, '- ' || speaker || '->' || addressee || ': ' || arg_max(register_hint, (loaded_at, chunk_id)) as l from chunks where speaker <> '' and addressee <> '' and register_hint <> '' group by book_id, speaker, addressee) group by book_id")
def proj24_book_summaries(spark: SparkSession, d: str) -> DataFrame:
    edges = memory.book_state(chunks(spark, d), "book_id", ["loaded_at", "chunk_id"])["register_edges"]
    return memo.book_summary(edges, spark.createDataFrame([], "book_id string, term string, preferred string, count bigint"))


@query()
def proj25_style_notes(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    return memo.style_notes(b, profile.frequent_names(b))


@query()
def t6_safety(spark: SparkSession, d: str) -> DataFrame:
    """The last choice by all checks."""
    return pipeline.safest(pipeline.with_cast(chunks(spark, d)), ["chunk_id"], table(spark, d, "glossary")).select("chunk_id", "name")


@query(f"""with s as (select *, greatest(0, least(1000, score)) / 1000 as raw from {_CSCORED}), v as (select *, raw * 1000 - len(flags) * 120 - case when list_contains(flags, 'missing_inline_markers') then 400 else 0 end - case when list_contains(flags, 'prompt_leak') then 300 else 0 end + greatest(-50.0, least(50.0, (score - 1000) / 4)) as value from s)
    select v.chunk_id, v.name from v join v b on b.chunk_id = v.chunk_id and b.ord = 1 where v.ord = 1 or (v.score + 80 >= b.score and not (v.hard > b.hard or (v.hard = b.hard and v.hard > 0))) qualify row_number() over (partition by v.chunk_id order by v.value desc, v.ord) = 1""")
def t8_patch_by_estimate(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.patch_by_estimate(chunks(spark, d), ["chunk_id"]).select("chunk_id", "name")


@query(f"""with k as (select * from (select book_id, chapter, chunk_idx, translation from checkpoint_lines qualify row_number() over (partition by book_id, chapter, chunk_idx order by logged_at desc, line_id desc) = 1) where translation is not null),
    c as (select book_id, chapter, chunk_idx, source from {CURRENT} where source is not null)
    select book_id, chapter, chunk_idx, case when k.translation is not null then k.translation else {typography_sql(_clean_sql("('[Translated ' || source || ']')"))} end as draft from c left join k using (book_id, chapter, chunk_idx)""")
def u3_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts from checkpoints, else from the stand-in model; equal sources are sent once."""
    done = memory.last_checkpoint(table(spark, d, "checkpoint_lines"), _KEY, ["logged_at", "line_id"]).where("translation is not null")
    c = current(spark, d).select(*_KEY, "source").where("source is not null")
    empty = spark.createDataFrame([], "namespace string, key string, value string")
    drafts, _ = pipeline.draft(c, _KEY, models.Stub(), empty, done)
    return drafts.select(*_KEY, "draft")


@query(f"select chunk_id, (len(found) > 0 or score < 940) and not (score >= 960 and len(list_filter(found, lambda f: list_contains({lst(L.HARD_FLAGS)}, f))) = 0) and has_source as has_second from (select p.chunk_id, found, {score_sql('s', 'c', 'found')} as score, k.source is not null as has_source from (select chunk_id, s, d as c, {base_flags_sql('s', 'd', 'd')} as found from {PAIRS}) p join chunks k using (chunk_id) where k.draft is not null)")
def u18_arbitration(spark: SparkSession, d: str) -> DataFrame:
    a = pipeline.arbitrate(chunks(spark, d).where("draft is not null"), ["chunk_id"], models.Stub("second"))
    return a.select("chunk_id", F.coalesce(F.map_contains_key("alt_drafts", "second"), F.lit(False)).alias("has_second"))


_MARKED = "list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 1) = '!')[1:5]"


@query(f"select chunk_id, case when length(t) >= 40 then array_to_string(list_transform({_MARKED}, lambda i: '[EXCLAMATION] one mark (offset ' || (i - 1) || ')'), '; ') else '' end as messages from (select chunk_id, coalesce(final, '') as t from chunks)")
def src16_grammar(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a checker, here a stand-in, for every final text."""
    m = annotators.grammar_messages(chunks(spark, d), ["chunk_id"], "final", annotators.Marks())
    return m.select("chunk_id", F.array_join("messages", "; ").alias("messages"))


_KNOWN_AS = "(select distinct speaker as alias from chunks where speaker <> '')"


@query(f"""with k as (select list(alias) as known from {_KNOWN_AS}), c as (select chunk_id, speaker, {wrd(bare("coalesce(source, '')"))} as w, known from chunks, k)
    select chunk_id, case when coalesce(speaker, '') <> '' then speaker when len(list_filter(w, lambda x: lower(x) in ('he', 'she', 'they', 'i', 'me'))) > 0 then coalesce(list_filter(list_transform(w, lambda x: rtrim(x, chr(39) || 's')), lambda x: list_contains(known, x))[1], speaker) else speaker end as speaker from c""")
def u14_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Speakers of chunks without one, from the clusters of a stand-in."""
    c = chunks(spark, d)
    aliases = c.where("speaker <> ''").select(F.col("speaker").alias("alias"), F.col("speaker").alias("canonical")).distinct()
    return annotators.resolve_speakers(c, ["chunk_id"], aliases, annotators.OneCluster()).select("chunk_id", "speaker")


_SAMPLES = f"(select book_id, chapter, string_agg('SOURCE:' || chr(10) || coalesce(source, '') || chr(10) || 'DRAFT:' || chr(10) || coalesce(draft, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by chunk_idx) as samples from (select * from {CURRENT} qualify row_number() over (partition by book_id, chapter order by chunk_idx) <= 3) group by all)"


@query(f"with m as ({ORACLES['proj22_chapter_memos']}) select book_id, chapter, md5(memo || chr(10) || chr(10) || 'LLM MEMO:' || chr(10) || '[Translated DETERMINISTIC MEMORY:' || chr(10) || memo || chr(10) || chr(10) || 'SAMPLES:' || chr(10) || coalesce(samples, '') || ']') as h from m left join {_SAMPLES} using (book_id, chapter)")
def u15_model_memos(spark: SparkSession, d: str) -> DataFrame:
    """Chapter memos followed by what a model, here the stand-in, makes of them."""
    m = annotators.model_memos(proj22_chapter_memos(spark, d), current(spark, d), ["book_id", "chapter"], "chunk_idx", models.Stub())
    return m.select("book_id", "chapter", F.md5("memo").alias("h"))


@query()
def w5_window_revision(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("book_id", "chapter").orderBy("chunk_idx")
    rows = current(spark, d).where("draft is not null").select("book_id", "chapter", (F.row_number().over(w) - 1).alias("pos"), "source", "draft", F.col("draft").alias("current"))
    return pipeline.revise_windows(rows, ["book_id", "chapter"], "pos", models.Substitution([("  ", " ")], "window"))
