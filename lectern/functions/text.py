"""Scalar text functions as built-in column expressions; Python only for Unicode normalisation."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicons as L

MARKER = r"\[\[/?ZX[A-Z]+[0-9]+X\]\]"


def rep(c: Column, *rules: tuple[str, str]) -> Column:
    """Regular-expression rewrites, one after the other."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def lit_array(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def strip(c: Column) -> Column:
    """Without white space at both ends, line breaks included."""
    return rep(c, (r"^\s+", ""), (r"\s+$", ""))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def strip_markers(c: Column) -> Column:
    return F.regexp_replace(c, MARKER, "")


def unquoted(c: Column) -> Column:
    """Without markers and quoted dialogue."""
    return rep(strip_markers(c), (r'"[^"]*"', " "), ("“[^”]*”", " "), ("«[^»]*»", " "))


def normalize_text(c: Column) -> Column:
    return strip(rep(F.translate(F.lower(c), "_-", "  "), (r"[^a-z0-9]+", " ")))


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and apostrophes."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([A-Za-zÀ-ÿ']+)"), F.lit(1))


def words(c: Column) -> Column:
    """Runs of letters, digits and _ with their case: what \\b delimits, without its differences between engines."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def ascii_words(c: Column, least: int) -> Column:
    """Lower-cased whole words of least or more ASCII letters."""
    return F.filter(words(F.lower(c)), lambda w: w.rlike(f"^[a-z]{{{least},}}$"))


def spaced(c: Column) -> Column:
    """Runs without white space, in order."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def french_typography(c: Column) -> Column:
    return strip(
        rep(
            F.translate(c, "“”", '""'),
            (r'"([^"\n]+)"', "« $1 »"),
            (r"\s+([,.])", "$1"),
            (r"\s+([;:!?])", " $1"),
            (r"«\s+", "« "),
            (r"\s+»", " »"),
            (r"(^|[^\p{L}\p{N}_])([ldjmnstcçLDJMNSTCÇ])'\s+", "$1$2'"),
            (r"\s{2,}", " "),
        )
    )


def progress_text(c: Column, most: int) -> Column:
    t = squeeze(c)
    cut = F.concat(F.rtrim(F.substring(t, 1, most)), F.lit(" ... ["), (F.length(t) - most).cast("string"), F.lit(" more chars]"))
    return F.when((F.lit(most) <= 0) | (F.length(t) <= most), t).otherwise(cut)


def slug(c: Column, most: int = 80) -> Column:
    return F.substring(rep(F.lower(c), (r"[^a-z0-9]+", "_"), (r"^_+|_+$", "")), 1, most)


def normalize_marked(c: Column) -> Column:
    return strip(rep(c, (r"\r\n?", "\n"), (r"[ \t\n]+", " "), (r"\s+(\[\[/?)", " $1"), (r"(\]\])\s+", "$1 ")))


def clean_generated(c: Column) -> Column:
    """Without code fences, leading labels and appended session or chapter notes."""
    t = rep(strip(c), (r"(?i)^```(?:text|fr|french)?\s*", ""), (r"\s*```$", ""))
    for label in ("Corrected French:", "Repaired French:", "French:", "Traduction:"):
        t = F.when(F.startswith(F.lower(t), F.lit(label.lower())), strip(F.substring(t, len(label) + 1, 1 << 30))).otherwise(t)
    t = rep(t, (r"(?i)\s*\(\s*\d+\s+s[eé]ances?\s*\)|\s*\(\s*session\s+\d+\s*\)|\s*\(\s*chapitre\s+\d+\s*\)", ""))
    return strip(t)


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(spaced(c), 1, n), " ")


def estimate_tokens(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.greatest(F.lit(1), F.size(spaced(t)), F.ceil(F.length(t) / 4).cast("int"))


def let(c: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def number_word(c: Column) -> Column:
    """0..99 in words, null otherwise."""
    tens = F.element_at(lit_array(L.TENS), F.floor(c / 10).cast("int") - 1)
    ones = F.element_at(lit_array(L.ONES), (c % 10).cast("int") + 1)
    small = F.element_at(lit_array(L.ONES), c.cast("int") + 1)
    return (
        F.when((c >= 0) & (c < 20), small)
        .when((c >= 20) & (c < 100) & (c % 10 == 0), tens)
        .when((c > 20) & (c < 100), F.concat_ws(" ", tens, ones))
    )


def word_number(c: Column) -> Column:
    """The number that figures or words 0..99 name, null otherwise."""
    names = [*L.ONES, *L.TENS, *(f"{a} {b}" for a in L.TENS for b in L.ONES)]
    values = [*range(20), *range(20, 100, 10), *(10 * (k + 2) + j for k in range(8) for j in range(20))]

    def number(t: Column) -> Column:
        at = F.array_position(lit_array(names), t).cast("int")
        return F.when(t.rlike("^[0-9]+$"), t.try_cast("int")).when(at > 0, F.element_at(lit_array(values), at))

    return let(normalize_text(c), number)


def chapter_number(c: Column) -> Column:
    """The number after chapter, chap or ch: of two words, else of one."""
    rest = F.split(F.regexp_extract(normalize_text(c), r"(?:^| )(?:chapter|chap|ch) (.+)$", 1), " ")
    return let(rest, lambda p: F.coalesce(word_number(F.array_join(F.slice(p, 1, 2), " ")), word_number(F.element_at(p, 1))))


def short_error(c: Column, kind: Column, most: int = 320) -> Column:
    """An error's text on one line, cut to most characters; its kind where it says nothing."""
    one = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(one == "", kind).when(F.length(one) > most, F.concat(F.substring(one, 1, most - 3), F.lit("..."))).otherwise(one)


def chapter_label(c: Column) -> Column:
    """The name under which a chapter's output goes: its number in words, Chapter_N above those, else its text in
    letters and figures."""
    n = chapter_number(c)
    words = F.replace(F.initcap(number_word(n)), F.lit(" "), F.lit("_"))
    plain = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    numbered = F.concat(F.lit("Chapter_"), F.coalesce(words, n.cast("string")))
    return F.when(n.isNotNull(), numbered).when(plain == "", "Chapter").otherwise(plain)


def should_translate(c: Column) -> Column:
    return (F.length(strip(c)) >= 2) & c.rlike("[A-Za-z]")


def has_speech(c: Column) -> Column:
    return c.rlike("[\"“”«»]")


def has_phrase(c: Column, alternatives: str) -> Column:
    """Any of the alternatives as whole words, without case."""
    return c.rlike(rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{alternatives})(?:$|[^\p{{L}}\p{{N}}_])")


def sentence_count(c: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(c, F.lit(r"[.!?»]\s")))


def html_text(c: Column) -> Column:
    """Text of HTML: scripts dropped, breaks and block ends as line breaks, common entities decoded."""
    t = rep(
        c,
        (r"(?is)<script[^>]*>.*?</script>", " "),
        (r"(?is)<style[^>]*>.*?</style>", " "),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(?:p|div|h\d|li)>", "\n"),
        (r"<[^>]+>", " "),
        ("&nbsp;|&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&amp;", "&"), (" ", " "),
        (r"[ \t\r\f\x0b]+", " "), (r"\n\s+", "\n"), (r"\n{2,}", "\n"),
    )
    return strip(t)


def first_heading(c: Column) -> Column:
    def tag(name: str) -> Column:
        inner = F.regexp_extract(c, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
        return F.nullif(squeeze(F.regexp_replace(inner, "<[^>]+>", " ")), F.lit(""))

    return F.coalesce(*(tag(x) for x in ("h1", "h2", "h3", "title")), F.lit(""))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def memory_text(c: Column, normalise: bool = True) -> Column:
    """The form in which memories compare texts. ASCII and Latin-1 texts need no normalisation, so no Python."""
    t = F.lower(strip_markers(c))
    t = nfkc(t) if normalise else t
    return strip(F.regexp_replace(t, r"[^a-z0-9À-ÿ']+", " "))


@F.pandas_udf(StringType())
def keyboard_text(s: pd.Series) -> pd.Series:
    """ASCII keyboard form: replacements, NFKD, the rest dropped."""
    table = str.maketrans(L.KEYBOARD)

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        flat = unicodedata.normalize("NFKD", x.translate(table)).encode("ascii", "ignore").decode()
        return " ".join(y for y in flat.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ").split(" ") if y)

    return s.map(one)


def safe_stem(c: Column) -> Column:
    t = rep(keyboard_text(c), (r"[^A-Za-z0-9._ -]+", "_"), (r"\s+", " "), (r"^[ ._]+|[ ._]+$", ""))
    return F.when(t == "", F.lit("book")).otherwise(t)


def content_key(*cs: Column) -> Column:
    """Content address: sha256 of the parts, nulls as empty."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(c.cast("string"), F.lit("")) for c in cs)), 256)


def content_tokens(c: Column) -> Column:
    """Distinct tokens of three or more letters that aren't stopwords."""
    t = word_tokens(c)
    return F.array_distinct(F.filter(t, lambda w: (F.length(w) > 2) & ~w.isin(*L.STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def ordered_distinct(c: Column) -> Column:
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))
