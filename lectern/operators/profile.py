"""The profile of a book: names, genders, relations, places, phrases, domains, point of view and tone.

Blocks are (book, part, pos, id, text): part is a file of the book, pos a place in it, id unique. Every aggregate is keyed by book and pre-aggregated, and the hot book's rows are
spread by their tokens or by their position, never gathered in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import semantics as S
from ..functions import text as T
from ..runtime import shared_table


def _top(counts: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def capitalised(blocks: DataFrame) -> DataFrame:
    """(book, name, n): words of an ASCII capital and small letters, with their counts."""
    names = F.filter(T.words(T.strip_markers(F.coalesce("text", F.lit("")))), lambda w: w.rlike("^[A-Z][a-z]+$"))
    return blocks.select("book", F.explode(names).alias("name")).groupBy("book", "name").agg(F.count("*").alias("n"))


def chapter_names(blocks: DataFrame, least: int = 2, most: int = 40) -> DataFrame:
    """(book, name, n, rank): the most frequent capitalised words, counted twice or more; ties by name."""
    return _top(capitalised(blocks).where(F.col("n") >= least), ["book"], most, [F.col("n").desc(), F.col("name")])


def required_names(blocks: DataFrame) -> DataFrame:
    """(book, names): chapter_names as an array, ordered by rank."""
    return chapter_names(blocks).groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))


def name_candidates(blocks: DataFrame) -> DataFrame:
    """(book, name, n): capitalised runs of one or two words that aren't stopwords."""
    runs = F.regexp_extract_all(T.strip_markers(F.coalesce("text", F.lit(""))), F.lit(r"(?<![\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)(?![\p{L}\p{N}_])"), F.lit(1))
    c = blocks.select("book", F.explode(runs).alias("name")).where(~F.col("name").isin(*L.NAME_STOPWORDS))
    return c.groupBy("book", "name").agg(F.count("*").alias("n"))


def known_terms(blocks: DataFrame) -> DataFrame:
    """(book, term, preferred): known terms that some block contains."""
    low = F.lower(T.strip_markers(F.coalesce("text", F.lit(""))))
    hits = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.struct(F.lit(t).alias("term"), F.lit(f).alias("preferred"))) for t, f in L.KNOWN_TERMS.items())))
    return blocks.select("book", F.explode(hits).alias("h")).select("book", "h.*").distinct()


def sentences(blocks: DataFrame) -> DataFrame:
    """(book, id, k, sentence): cut after . ! ? and white space."""
    cut = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?])\s+", "$1\u001f"), "\u001f")
    return blocks.select("book", "id", F.posexplode(cut).alias("k", "sentence"))


def mid_sentence_names(blocks: DataFrame) -> DataFrame:
    """(book, name): capitalised words after a sentence's first, cleaned to ASCII letters, of three letters or more."""
    w = F.slice(T.spaced(F.col("sentence")), 2, 1 << 20)
    clean = F.transform(w, lambda x: F.regexp_replace(x, r"[^A-Za-z\-']", ""))
    c = sentences(blocks).select("book", F.explode(clean).alias("name"))
    fine = c["name"].rlike("^[A-Z].{2,}$") & (F.upper("name") != F.col("name")) & ~F.col("name").isin(*L.NAME_STOPWORDS)
    return c.where(fine).distinct()


def name_frequencies(blocks: DataFrame) -> DataFrame:
    """(book, name, n): whole-word counts of the mid-sentence names."""
    all_words = blocks.select("book", F.explode(T.words(F.coalesce("text", F.lit("")))).alias("name")).groupBy("book", "name").agg(F.count("*").alias("n"))
    return all_words.join(mid_sentence_names(blocks), ["book", "name"], "left_semi")


def frequent_names(blocks: DataFrame) -> DataFrame:
    """name_frequencies of max(5, blocks // 30) or more."""
    n = blocks.groupBy("book").agg(F.greatest(F.lit(5), F.floor(F.count("*") / 30)).alias("_least"))
    return name_frequencies(blocks).join(n, "book").where(F.col("n") >= F.col("_least")).drop("_least")


def windows_of_three(blocks: DataFrame) -> DataFrame:
    """(book, part, pos, id, window): each block with its neighbours in the same part, a file of the book."""
    w = Window.partitionBy("book", "part").orderBy("pos", "id").rowsBetween(-1, 1)
    near = F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(w), " ")
    return blocks.select("book", "part", "pos", "id", near.alias("window"))


def _present(windows: DataFrame, names: DataFrame) -> DataFrame:
    """(book, id, name): names in each window, each once."""
    w = windows.select("book", "id", F.explode(F.array_distinct(T.words(F.col("window")))).alias("name"))
    return w.join(names.select("book", "name"), ["book", "name"])


def beside(sentences: DataFrame, value: str) -> DataFrame:
    """sentences (book, part, pos, id, k, value) with before and after: the neighbours' values in the book.

    Neighbours are found within a part, a file of the book; the sentences at a part's ends take the last and the first
    one of the parts beside it, so that no book is one task.
    """
    at = F.struct("pos", "id", "k")
    ends = sentences.groupBy("book", "part").agg(F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"))
    w = Window.partitionBy("book").orderBy("part")
    ends = ends.select("book", "part", F.lag("_last").over(w).alias("_before"), F.lead("_first").over(w).alias("_after"))
    inner = Window.partitionBy("book", "part").orderBy("pos", "id", "k")
    s = sentences.withColumns({"_b": F.lag(value).over(inner), "_a": F.lead(value).over(inner)}).join(ends, ["book", "part"])
    return s.withColumns({"before": F.coalesce("_b", "_before"), "after": F.coalesce("_a", "_after")}).drop("_a", "_b", "_before", "_after")


def genders(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(book, name, m, f, gender): pronouns in the windows of three sentences that hold each name; 1.5 times decides.

    A block's end ends a sentence; sentences are read once, and windows add up what was found in them.
    """
    cut = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?])\s+", "$1\u001f"), "\u001f")
    s = blocks.select("book", "part", "pos", "id", F.posexplode(cut).alias("k", "sentence"))
    s = s.select("book", "part", "pos", "id", "k", T.words(F.col("sentence")).alias("w"))
    count = lambda group: F.size(F.filter("w", lambda x: F.lower(x).isin(*group)))
    held = s.select("book", "part", "pos", "id", "k", F.struct(F.array_distinct(F.filter("w", lambda x: x.rlike("^[A-Z]"))).alias("w"), count(L.MALE).alias("m"), count(L.FEMALE).alias("f")).alias("x"))
    three = beside(held, "x")
    none = F.array().cast("array<string>")
    words = F.array_distinct(F.concat(*(F.coalesce(F.col(c)["w"], none) for c in ("before", "x", "after"))))
    total = lambda n: sum((F.coalesce(F.col(c)[n], F.lit(0)) for c in ("before", "x", "after")), F.lit(0))
    w = three.select("book", F.explode(words).alias("name"), total("m").alias("m"), total("f").alias("f"))
    g = w.join(names.select("book", "name"), ["book", "name"]).groupBy("book", "name").agg(F.sum("m").alias("m"), F.sum("f").alias("f"))
    label = F.when(F.col("m") * 2 > F.col("f") * 3, "male").when(F.col("f") * 2 > F.col("m") * 3, "female").otherwise("neutral")
    return g.withColumn("gender", label)


def affinity(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(book, a, b, cooc, solo_a, solo_b), a < b, of names that share a window of three blocks.

    The affinity is cooc / sqrt(solo_a * solo_b); pairs that never meet have 0 and no row. Pairs are made within
    a window, whose names are few, not within a book.
    """
    p = _present(windows_of_three(blocks), names)
    solo = p.groupBy("book", "name").agg(F.count("*").alias("n"))
    held = p.groupBy("book", "id").agg(F.array_sort(F.collect_set("name")).alias("ns"))
    a = held.select("book", "ns", F.posexplode("ns").alias("k", "a"))
    pairs = a.select("book", "a", F.explode(F.slice("ns", F.col("k") + 2, F.size("ns"))).alias("b"))
    c = pairs.groupBy("book", "a", "b").agg(F.count("*").alias("cooc"))
    s = lambda x: solo.select("book", F.col("name").alias(x), F.col("n").alias(f"solo_{x}"))
    return c.join(s("a"), ["book", "a"]).join(s("b"), ["book", "b"]).select("book", "a", "b", "cooc", "solo_a", "solo_b")


def relationships(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(book, a, b, type): partners if an intimate word follows either name within 80 characters or the affinity is
    0.55 or more, friends from 0.25, acquaintance from 0.08; both directions."""
    aff = affinity(blocks, names)
    near = rf"(?<![\p{{L}}\p{{N}}_])([A-Za-z'\-]+)(?=(?![\p{{L}}\p{{N}}_]).{{0,80}}?(?<![\p{{L}}\p{{N}}_])(?:(?i){L.INTIMATE}))"
    close = blocks.where(F.col("text").rlike(f"(?i)(?:{L.INTIMATE})")).select("book", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(near), F.lit(1)))).alias("name")).distinct()
    close = close.withColumn("close", F.lit(True))
    c = lambda x: close.select("book", F.col("name").alias(x), F.col("close").alias(f"_{x}"))
    j = aff.join(c("a"), ["book", "a"], "left").join(c("b"), ["book", "b"], "left")
    # score >= s  <=>  cooc^2 >= s^2 solo_a solo_b
    at = lambda s: F.col("cooc") * F.col("cooc") >= s * s * F.col("solo_a") * F.col("solo_b")
    kind = F.when(F.coalesce("_a", "_b", F.lit(False)) | at(0.55), "intimate_partner").when(at(0.25), "friends").when(at(0.08), "acquaintance")
    one = j.select("book", "a", "b", kind.alias("type")).where("type is not null")
    return one.unionByName(one.select("book", F.col("b").alias("a"), F.col("a").alias("b"), "type"))


def aliases(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(book, alias, canonical, n, total): other mid-sentence names whose company in sentences is one name in more than 6 of 10, thrice or more."""
    s = sentences(blocks)
    w = s.select("book", "id", "k", F.explode(F.array_distinct(T.words(F.col("sentence")))).alias("word"))
    canon = w.join(names.select("book", F.col("name").alias("word")), ["book", "word"]).withColumnRenamed("word", "canonical")
    others = mid_sentence_names(blocks).join(names.select("book", "name"), ["book", "name"], "left_anti")
    cand = w.join(others.select("book", F.col("name").alias("word")), ["book", "word"]).withColumnRenamed("word", "alias")
    co = cand.join(canon, ["book", "id", "k"]).groupBy("book", "alias", "canonical").agg(F.count("*").alias("n"))
    totals = co.groupBy("book", "alias").agg(F.sum("n").alias("total"), F.min_by(F.struct("canonical", "n"), F.struct(-F.col("n"), F.col("canonical"))).alias("top"))
    return totals.select("book", "alias", "top.*", "total").where("n >= 3 and n * 10 > total * 6")


def cast(blocks: DataFrame, characters: DataFrame) -> DataFrame:
    """(book, cast): the characters' names, each its own alias, and the other aliases that the text has for them.

    cast: struct of aliases, an array of (alias, canonical), and the arrays canonical and addresses, the aliases that
    aren't canonical. characters: (book, name).
    """
    own = characters.select("book", "name").distinct()
    pairs = own.select("book", F.col("name").alias("alias"), F.col("name").alias("canonical")).unionByName(aliases(blocks, own).select("book", "alias", "canonical"))
    pair = F.array_sort(F.collect_set(F.struct("alias", "canonical"))).alias("aliases")
    g = pairs.groupBy("book").agg(pair, F.array_sort(F.collect_set("canonical")).alias("canonical"))
    addresses = F.array_except(F.transform("aliases", lambda a: a["alias"]), "canonical").alias("addresses")
    return g.select("book", F.struct("aliases", addresses, "canonical").alias("cast"))


def _upto(blocks: DataFrame, chars: int) -> DataFrame:
    """The blocks of each book's first characters, the last one cut; blocks are joined by line breaks.

    Running lengths are summed in two levels, over the parts of a book and within each, so no book is one task.
    """
    b = blocks.select("book", "part", "pos", "id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text") + 1
    totals = b.groupBy("book", "part").agg(F.sum(n).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("book").orderBy("part")) - F.col("_n")
    first = totals.select("book", "part", before.alias("_before")).where(F.col("_before") < chars)
    upto = F.sum(n).over(Window.partitionBy("book", "part").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, 0)) - n
    c = b.join(first, ["book", "part"]).withColumn("_at", upto + F.col("_before")).where(F.col("_at") < chars)
    return c.select("book", F.substring("text", F.lit(1), (F.lit(chars) - F.col("_at")).cast("int")).alias("text"))


def point_of_view(blocks: DataFrame) -> DataFrame:
    """(book, fp, tp, pov): phrases of first and third person in the first 30,000 characters."""
    line = lambda: F.concat(F.lit(" "), F.array_join(T.words(F.lower("text")), " "), F.lit(" "))
    count = lambda alts: F.regexp_count(line(), F.lit(rf" (?:{alts})(?= )"))
    c = _upto(blocks, 30_000).groupBy("book").agg(F.sum(count(L.FIRST_PERSON)).alias("fp"), F.sum(count(L.THIRD_PERSON)).alias("tp"))
    return c.withColumn("pov", F.when(F.col("fp") * 2 > F.col("tp") * 3, "first_person").otherwise("third_person"))


def tense(blocks: DataFrame) -> DataFrame:
    """(book, past, present, tense) of the first 50,000 characters."""
    count = lambda group: F.size(F.filter(T.words(F.lower("text")), lambda x: x.isin(*group)))
    c = _upto(blocks, 50_000).groupBy("book").agg(F.sum(count(L.PAST_TENSE)).alias("past"), F.sum(count(L.PRESENT_TENSE)).alias("present"))
    return c.withColumn("tense", F.when(F.col("past") >= F.col("present"), "past").otherwise("present"))


def dialogue_share(blocks: DataFrame) -> DataFrame:
    """(book, n_dialogue, n_blocks)."""
    return blocks.groupBy("book").agg(F.sum(F.coalesce("text", F.lit("")).rlike('["“«]').cast("int")).alias("n_dialogue"), F.count("*").alias("n_blocks"))


def locations(blocks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(book, place, n): words after a preposition of place, twice or more, of the twenty most frequent; without regard to case."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{L.PLACE_PREPOSITIONS})\s+([A-Z][a-z]{{2,}}(?:\s+[A-Z][a-z]+)*)"), F.lit(1))
    c = blocks.select("book", F.explode(found).alias("place")).groupBy("book", "place").agg(F.count("*").alias("n"))
    if names is not None:
        c = c.join(names.select("book", F.col("name").alias("place")), ["book", "place"], "left_anti")
    return _top(c, ["book"], 20, [F.col("n").desc(), F.col("place")]).where("n >= 2").drop("rank")


def organisations(blocks: DataFrame) -> DataFrame:
    """(book, name, n): acronyms and capitalised phrases after `the`, thrice or more, of the twenty most frequent."""
    t = F.coalesce("text", F.lit(""))
    acronyms = F.filter(T.words(t), lambda w: w.rlike("^[A-Z]{2,6}$"))
    phrases = F.regexp_extract_all(t, F.lit(r"(?<![\p{L}\p{N}_])the\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})(?![\p{L}\p{N}_])"), F.lit(1))
    c = blocks.select("book", F.explode(F.concat(acronyms, phrases)).alias("name")).groupBy("book", "name").agg(F.count("*").alias("n"))
    return _top(c, ["book"], 20, [F.col("n").desc(), F.col("name")]).where("n >= 3").drop("rank")


def domains(blocks: DataFrame) -> DataFrame:
    """(book, domain, words): sorted distinct words of each domain, the first twenty, where there are three or more."""
    spark = blocks.sparkSession
    vocabulary = spark.createDataFrame([(d, w) for d, ws in L.DOMAINS.items() for w in dict.fromkeys(ws.split())], "domain string, word string")
    w = blocks.select("book", F.explode(F.array_distinct(T.ascii_words(F.coalesce("text", F.lit("")), 3))).alias("word"))
    hits = w.join(F.broadcast(vocabulary), "word").select("book", "domain", "word").distinct()
    g = hits.groupBy("book", "domain").agg(F.array_sort(F.collect_set("word")).alias("words"))
    return g.where(F.size("words") >= 3).withColumn("words", F.slice("words", 1, 20))


def recurring_phrases(blocks: DataFrame, least: int = 4, most: int = 30) -> DataFrame:
    """(book, phrase, n, rank): runs of two or three words of two letters or more that don't begin with a stopword; ties by phrase."""
    w = blocks.select("book", T.ascii_words(F.coalesce("text", F.lit("")), 2).alias("w"))
    grams = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))).otherwise(F.array().cast("array<string>"))
    c = w.select("book", F.explode(F.concat(grams(2), grams(3))).alias("phrase")).groupBy("book", "phrase").agg(F.count("*").alias("n"))
    c = c.where((F.col("n") >= least) & ~F.substring_index("phrase", " ", 1).isin(*L.STOPWORDS))
    return _top(c, ["book"], most, [F.col("n").desc(), F.col("phrase")])


def character_speech(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(book, name, n_quotes, n_words): quotations of blocks in which the name is said to speak."""
    t = F.coalesce("text", F.lit(""))
    said = F.regexp_extract_all(t, F.lit(r"(?<![\p{L}\p{N}_])([A-Z]\p{L}*)(?![\p{L}\p{N}_])(?=[^.\n]{0,60}?(?<![\p{L}\p{N}_])(?i:said|asked|replied|shouted|whispered)(?![\p{L}\p{N}_]))"), F.lit(1))
    quotes = F.regexp_extract_all(t, F.lit('["“]([^"“”]{5,200})["”]'), F.lit(1))
    b = blocks.select("book", F.explode(F.array_distinct(said)).alias("name"), F.size(quotes).alias("nq"), F.aggregate(quotes, F.lit(0), lambda a, q: a + F.size(T.spaced(q))).alias("nw"))
    return b.join(names.select("book", "name"), ["book", "name"]).groupBy("book", "name").agg(F.sum("nq").alias("n_quotes"), F.sum("nw").alias("n_words"))


_QUOTES = r'["“]([^"“”]{5,200})["”]'


def speech_words(blocks: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """(book, name, words): of the ten words said most in the blocks that hold a name, without case, the first that aren't
    stopwords; ties by word."""
    t = F.coalesce("text", F.lit(""))
    said = F.regexp_extract_all(F.lower(F.array_join(F.regexp_extract_all(t, F.lit(_QUOTES), F.lit(1)), " ")), F.lit(r"(?<![\p{L}\p{N}_])([a-z]{3,})(?![\p{L}\p{N}_])"), F.lit(1))
    held = blocks.select("book", F.array_distinct(T.words(F.lower(t))).alias("_h"), said.alias("_s")).where("size(_s) > 0")
    held = held.select("book", F.explode("_h").alias("_w"), "_s").join(names.select("book", "name", F.lower("name").alias("_w")), ["book", "_w"])
    n = held.select("book", "name", F.explode("_s").alias("word")).groupBy("book", "name", "word").agg(F.count("*").alias("n"))
    top = _top(n, ["book", "name"], 10, [F.col("n").desc(), F.col("word")]).where(~F.col("word").isin(*L.STOPWORDS))
    listed = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "word"))), 1, most), lambda x: x["word"])
    return top.groupBy("book", "name").agg(listed.alias("words"))


def character_profiles(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(book, name, n, gender, mean_words, words): how often a name comes, its gender, the mean length of what its
    speaker says, to a tenth, and its frequent words; 0 and none for a silent one. names: (book, name, n)."""
    s = character_speech(blocks, names).select("book", "name", F.round(F.col("n_words") / F.greatest("n_quotes", F.lit(1)), 1).alias("mean_words"))
    j = names.select("book", "name", "n").join(genders(blocks, names).select("book", "name", "gender"), ["book", "name"], "left")
    j = j.join(s, ["book", "name"], "left").join(speech_words(blocks, names), ["book", "name"], "left")
    return j.select("book", "name", "n", F.coalesce("gender", F.lit("neutral")).alias("gender"), F.coalesce("mean_words", F.lit(0.0)).alias("mean_words"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def glossary_rules(blocks: DataFrame) -> DataFrame:
    """(book, term, preferred): known terms, then domain terms, then the ten most recurrent phrases without stopword; the first wins."""
    low = T.ascii_words(F.coalesce("text", F.lit("")), 1)
    dom = F.filter(F.array_distinct(low), lambda w: w.isin(*L.DOMAIN_FRENCH))
    french = F.create_map(*(F.lit(x) for kv in L.DOMAIN_FRENCH.items() for x in kv))
    second = blocks.select("book", F.explode(dom).alias("term")).distinct().withColumn("preferred", F.element_at(french, F.col("term")))
    third = recurring_phrases(blocks).where(F.col("rank") <= 10).where(~F.exists(F.split("phrase", " "), lambda w: w.isin(*L.STOPWORDS)))
    parts = [(1, known_terms(blocks)), (2, second), (3, third.select("book", F.col("phrase").alias("term"), F.lit("").alias("preferred")))]
    u = None
    for k, p in parts:
        q = p.select("book", F.regexp_replace("term", "[^a-z0-9]+", "_").alias("term"), "preferred", F.lit(k).alias("k"))
        u = q if u is None else u.unionByName(q)
    return u.groupBy("book", "term").agg(F.min_by("preferred", "k").alias("preferred"))


def aspect_counts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, aspect, n) of past verbs whose class is known."""
    v = blocks.select(*keys, F.explode(S.past_verbs(F.col("text"))).alias("verb")).groupBy(*keys, "verb").agg(F.count("*").alias("n"))
    return v.withColumn("aspect", S.aspect(F.col("verb"))).where("aspect <> 'unknown'").groupBy(*keys, "aspect").agg(F.sum("n").alias("n"))


def entity_dominance(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(book, name, dominance): mean dominance of the blocks that hold the name."""
    b = blocks.select("book", S.dominance(F.col("text")).alias("d"), F.explode(F.array_distinct(T.words(F.coalesce("text", F.lit(""))))).alias("name"))
    return b.join(names.select("book", "name"), ["book", "name"]).groupBy("book", "name").agg(F.avg("d").alias("dominance"))


def semantic_sample(blocks: DataFrame) -> DataFrame:
    """(book, id, text, emotions, sentiment, acts, tone, fid): twenty evenly spaced blocks of a book and what each says.

    emotions: the block's four strongest, by share; fid: whether it reads as free indirect discourse.
    """
    from .windows import systematic_sample

    t = F.coalesce("text", F.lit(""))
    s = systematic_sample(blocks, ["book"], "id").select("book", "id", t.alias("text"))
    text = F.col("text")
    return s.select("book", "id", "text", S.emotion_scores(text).alias("emotions"), F.round(S.sentiment(text), 3).alias("sentiment"), S.speech_acts(text).alias("acts"), S.politeness(text).alias("tone"), (S.fid_raw(text) >= 4).alias("fid"))


def emotional_arc(sample: DataFrame) -> DataFrame:
    """(book, id, emotion, score) of the sampled blocks, in the order of their ids."""
    return sample.select("book", "id", F.explode("emotions").alias("e")).select("book", "id", "e.*")


def semantic_profile(blocks: DataFrame) -> DataFrame:
    """(book, n_sampled, n_fid, fid_ratio, sentiment, top_emotions, register, acts, aspects) of a book's sample.

    top_emotions: the three of the highest sums of scores, ties in the lexicon's order; register: formal or informal if
    more than twice as many blocks are polite in that way, else mixed; acts and aspects: arrays of (what, n), most first.
    """
    one = shared_table(semantic_sample(blocks), "semantic-sample")
    formal, informal = (F.sum((F.col("tone") == x).cast("int")) for x in ("formal", "informal"))
    g = one.groupBy("book").agg(F.count("*").alias("n_sampled"), F.sum(F.col("fid").cast("int")).alias("n_fid"), F.round(F.avg("sentiment"), 3).alias("sentiment"), formal.alias("_f"), informal.alias("_i"))
    order = {e: k for k, e in enumerate(L.EMOTIONS)}
    place = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    felt = emotional_arc(one).groupBy("book", "emotion").agg(F.round(F.sum("score"), 6).alias("n"))
    felt = felt.groupBy("book").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.element_at(place, F.col("emotion")).alias("k"), "emotion"))).alias("_e"))

    def counted(df: DataFrame, what: str, name: str) -> DataFrame:
        n = df.groupBy("book", what).agg(F.count("*").alias("n"))
        return _counts(n, what, name)

    acts = counted(one.select("book", F.explode("acts").alias("act")), "act", "acts")
    aspects = _counts(aspect_counts(one, ["book"]), "aspect", "aspects")
    j = g.join(felt, "book", "left").join(acts, "book", "left").join(aspects, "book", "left")
    return j.select(
        "book", "n_sampled", "n_fid", F.round(F.col("n_fid") / F.col("n_sampled"), 2).alias("fid_ratio"), "sentiment",
        F.coalesce(F.transform(F.slice("_e", 1, 3), lambda x: x["emotion"]), F.array().cast("array<string>")).alias("top_emotions"),
        F.when(F.col("_f") > 2 * F.col("_i"), "formal").when(F.col("_i") > 2 * F.col("_f"), "informal").otherwise("mixed").alias("register"), "acts", "aspects",
    )


def _counts(counts: DataFrame, what: str, name: str) -> DataFrame:
    """(book, name): an array of (what, n), most first."""
    one = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_n"), F.col(what).alias("what"))))
    return counts.groupBy("book").agg(F.transform(one, lambda x: F.struct(x["what"].alias(what), (-x["_n"]).alias("n"))).alias(name))


def entity_emotions(sample: DataFrame, names: DataFrame) -> DataFrame:
    """(book, name, emotion, share): the three strongest emotions of the sampled blocks that hold a name, without case."""
    held = sample.select("book", "emotions", F.explode(F.array_distinct(T.words(F.lower("text")))).alias("_w"))
    held = held.join(names.select("book", "name", F.lower("name").alias("_w")), ["book", "_w"])
    e = held.select("book", "name", F.explode("emotions").alias("e")).groupBy("book", "name", F.col("e.emotion").alias("emotion")).agg(F.round(F.sum("e.score"), 6).alias("n"))
    w = Window.partitionBy("book", "name")
    total = F.greatest(F.sum("n").over(w), F.lit(1.0))
    e = e.withColumn("share", F.round(F.col("n") / total, 3)).withColumn("_k", F.row_number().over(w.orderBy(F.col("n").desc(), "emotion")))
    return e.where("_k <= 3").select("book", "name", "emotion", "share")


def semantic_hints(profiles: DataFrame) -> DataFrame:
    """(book, hints): what a translator is told of a book, a line each; profiles of semantic_profile."""
    frequent = F.filter(F.slice("acts", 1, 2), lambda a: (a["act"] != "assertion") & (a["n"] > 2))
    said = lambda hint, c: F.replace(F.lit(L.HINTS[hint]), F.lit("{}"), c)
    told = F.transform(frequent, lambda a: said("act", a["act"]))
    advice = F.create_map(*(F.lit(x) for kv in L.TENSE_ADVICE.items() for x in kv))
    aspect = F.get("aspects", F.lit(0))["aspect"]
    percent = F.round(F.col("fid_ratio") * 100).cast("int").cast("string")
    tense = F.concat(said("aspect", aspect), F.coalesce(F.element_at(advice, aspect), F.lit(L.HINTS["any tense"])), F.lit("."))
    lines = F.concat(
        F.array(F.when(F.size("top_emotions") > 0, said("emotions", F.array_join("top_emotions", ", "))), F.when(F.col("register") == "formal", L.HINTS["formal"]).when(F.col("register") == "informal", L.HINTS["informal"])),
        F.coalesce(told, F.array().cast("array<string>")),
        F.array(F.when(F.col("fid_ratio") > 0.2, said("fid", percent)), F.when(aspect.isNotNull(), tense)),
    )
    return profiles.select("book", F.array_join(F.array_compact(lines), "\n").alias("hints"))


def profile(blocks: DataFrame) -> DataFrame:
    """One row a book: names with genders, relations and aliases, point of view, tense, dialogue, places, organisations,
    domains, phrases, glossary and the semantic profile."""
    freq = shared_table(frequent_names(blocks), "frequent-names")
    listed = lambda df, c, n: df.groupBy("book").agg(F.array_sort(F.collect_list(c)).alias(n))
    out = dialogue_share(blocks)
    for part in (
        point_of_view(blocks).select("book", "pov"), tense(blocks).select("book", "tense"),
        listed(freq, F.struct("name", "n"), "characters"), listed(locations(blocks, freq), "place", "places"),
        listed(organisations(blocks), "name", "organisations"), listed(domains(blocks), "domain", "domains"),
        listed(recurring_phrases(blocks), "phrase", "phrases"), listed(genders(blocks, freq), F.struct("name", "gender"), "genders"),
        listed(relationships(blocks, freq).where("a < b"), F.struct("a", "b", "type"), "relations"), listed(aliases(blocks, freq), F.struct("alias", "canonical"), "aliases"),
        listed(glossary_rules(blocks), F.struct("term", "preferred"), "glossary"), semantic_profile(blocks),
    ):
        out = out.join(part, "book", "left")
    return out
