"""Findings of the first advice: each test failed before its change."""

from pyspark.sql import functions as F

from lectern.functions import quality as Q
from lectern.plans import pipeline


def test_name_and_register_flags(spark):
    rows = [
        (1, "Al saw Alice and Bob.", "Alice a vu Bob.", "Alice", ["Bob", ""], "tu"),
        (2, "Al saw Alice and Bob.", "Al a vu quelqu'un.", "Alice", ["Bob", "Zed"], None),
        (3, "Zed left.", "« You know, » dit-elle.", None, None, "tu"),
        (4, "Zed left.", "« You know, » Bob said.", None, None, "informal"),
        (5, "Zed left.", "« You know, » dit-elle.", None, None, "vous"),
    ]
    df = spark.createDataFrame(rows, "id int, s string, c string, speaker string, mentioned array<string>, register_hint string")
    aliases = "array(struct('Al' as alias, 'Alice' as canonical), struct('Alice' as alias, 'Alice' as canonical), struct('Bob' as alias, 'Bob' as canonical))"
    df = df.withColumn("cast", F.expr(f"struct({aliases} as aliases, array('Al') as addresses, array('Alice', 'Bob') as canonical)"))
    w = Q.who(F.col("speaker"), F.col("mentioned"), F.col("register_hint"), F.col("cast"))
    names = ("address_name_lost_", "scene_name_lost_", "informal_register")
    flags = Q.all_flags(F.col("s"), F.lit(""), F.col("c"), w=w)
    got = {r.id: [f for f in r.f if f.startswith(names)] for r in df.select("id", flags.alias("f")).collect()}
    assert got[1] == ["address_name_lost_Al"]
    assert got[2] == ["scene_name_lost_Alice", "scene_name_lost_Bob"]
    assert got[3] == ["informal_register_hint_present"] and got[4] == got[5] == []


_CHUNK = "chunk_id bigint, book_id string, chapter string, chunk_idx int, source string, draft string, final string, alt_drafts map<string,string>, speaker string, mentioned array<string>, register_hint string"


def test_rerank_keeps_names_and_glossary(spark):
    s = "Marbo opened the gate. Then Marbo went home with the others."
    rows = [
        (1, "b", "c", 0, s, "Marbo ouvrit la porte. Puis Marbo rentra avec les autres.", "Il ouvrit la porte. Puis il rentra chez lui avec les autres.", {}, "", [], ""),
        (2, "b", "c", 1, "The gate of Marbo was closed again.", "La porte de Marbo était de nouveau fermée.", "La grille de Marbo était de nouveau fermée.", {}, "", [], ""),
    ]
    rules = spark.createDataFrame([("gate", ["gate"], ["porte"], ["grille"])], "term string, source array<string>, preferred array<string>, forbidden array<string>")
    got = pipeline.safest(pipeline.with_cast(spark.createDataFrame(rows, _CHUNK)), ["chunk_id"], rules)
    assert {r.chunk_id: r.name for r in got.collect()} == {1: "draft", 2: "draft"}


def test_latest_exact_passes_over_faulty_finals(spark):
    from lectern.operators import similarity

    s, good, draft = "“Did Bob leave?” asked Ann.", "« Bob est-il parti ? » demanda Ann.", "« Bob est parti ? » demanda Ann."
    memory = [(1, s, draft, good), (2, s, draft, "Bob est parti."), (3, s, draft, ""), (4, "Other.", draft, good)]
    m = spark.createDataFrame(memory, "entry_id bigint, source string, draft string, final string")
    r = spark.createDataFrame([(10, s, draft), (11, s, ""), (12, "Nothing.", draft)], "chunk_id bigint, source string, draft string")
    got = similarity.latest_exact(r, "chunk_id", m, "entry_id").collect()
    assert sorted((x.chunk_id, x.entry, x.candidate) for x in got) == [(10, 1, good), (11, 1, good)]


def test_memory_similarity_has_drafts_and_register(spark, tmp_path):
    import random
    import re
    import unicodedata

    import __spark_entry__ as e
    from lectern.functions import lexicons as L

    rng = random.Random(5)
    vocabulary = [a + b + "el" for a in "bcdfg" for b in ("ar", "or", "ul")]
    text = lambda: " ".join(rng.sample(vocabulary, rng.randint(0, 9)))
    rows = [(k, text() + rng.choice(["", " [[ZXEM1X]]ﬁn[[/ZXEM1X]]", " fin"]), rng.choice([text(), None]), rng.choice(["tu", "vous", "", None])) for k in range(90)]
    for k in range(0, 90, 3):  # half a source, the same draft
        rows[k + 1] = (k + 1, " ".join(rows[k][1].split()[:4]) + " " + text(), rows[k][2], rows[k + 1][3])
    spark.createDataFrame(rows, "entry_id bigint, source string, draft string, register_hint string").write.parquet(str(tmp_path / "correction_memory.parquet"))

    def tokens(t):
        t = unicodedata.normalize("NFKC", re.sub(r"\[\[/?ZX[A-Z]+[0-9]+X\]\]", "", t or "").lower())
        return {w for w in re.sub(r"[^a-z0-9À-ÿ']+", " ", t).split() if len(w) > 2 and w not in L.STOPWORDS}

    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    want = {}
    for a in rows:
        for b in rows:
            js, jd = jac(tokens(a[1]), tokens(b[1])), jac(tokens(a[2]), tokens(b[2]))
            s = min(1.0, max(js, 0.65 * js + 0.35 * jd) + (0.05 if a[3] and a[3] == b[3] else 0.0))
            if a[0] != b[0] and s >= 0.56:
                want[a[0], b[0]] = round(s, 6)
    got = {(r.entry_id, r.other): r.similarity for r in e.queries()["j8_memory_similar"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 30
    best = {(r.entry_id, r.rank): r.other for r in e.queries()["t7_memory_examples"](spark, str(tmp_path)).collect()}
    for k in {a for a, _ in want}:
        order = sorted((b for a, b in want if a == k), key=lambda b: (-want[k, b], b))[:3]
        assert [best[k, i + 1] for i in range(len(order))] == order


def test_memory_text_of_every_source(spark, tmp_path):
    import hashlib
    import re
    import unicodedata

    import __spark_entry__ as e

    texts = ["Déjà vu — ﬁn", "ＡＢＣ　d", "été Été", "A B…", "½ ² Ⅳ [[ZXEM1X]]x[[/ZXEM1X]]", "plain text", ""]
    rows = [*enumerate(texts), (99, None)]
    spark.createDataFrame(rows, "entry_id bigint, source string").write.parquet(str(tmp_path / "correction_memory.parquet"))

    def one(t):
        t = unicodedata.normalize("NFKC", re.sub(r"\[\[/?ZX[A-Z]+[0-9]+X\]\]", "", t).lower())
        return hashlib.md5(re.sub(r"[^a-z0-9À-ÿ']+", " ", t).strip().encode()).hexdigest()

    got = {r.entry_id: r.h for r in e.queries()["f16_memory_text"](spark, str(tmp_path)).collect()}
    assert got == {k: one(t) for k, t in enumerate(texts)}


def test_literary_goes_on_after_the_critic(spark):
    from lectern.operators import models

    S = models.Substitution
    ok = S([], "quiet")
    rows = [
        (1, "b", "c", 0, "Marbo closed the old gate at night.", "Marbo closed the gate and was with the old.", "", {"alt": "Marbo ferma la vieille porte de nuit."}, "", [], ""),
        (2, "b", "c", 1, "Then Marbo slept until noon.", "Puis Marbo dormit jusque midi, avec été.", "", {}, "", [], ""),
    ]
    c = spark.createDataFrame(rows, _CHUNK)
    rules = spark.createDataFrame([], "term string, source array<string>, preferred array<string>, forbidden array<string>")
    memory = spark.createDataFrame([], "entry_id bigint, source string, draft string, final string")
    window = S([("jusque midi", "jusqu'à midi")], "window")
    got = {r.chunk_id: r.final for r in pipeline.literary(c, pipeline.Editors(ok, ok, ok, ok, ok, window), rules, memory).collect()}
    assert got == {1: "Marbo ferma la vieille porte de nuit.", 2: "Puis Marbo dormit jusqu'à midi, avec été."}


def test_literary_reads_the_rules_once_and_keeps_chunks_without_a_chapter(spark, monkeypatch):
    from lectern.operators import models

    ok = models.Substitution([], "quiet")
    rows = [
        (1, "b", None, 0, "Marbo slept until noon.", "Marbo dormit jusqu'à midi, avec été.", "", {}, "", [], ""),
        (2, "b", "c", 1, "Then Marbo slept until noon.", "Puis Marbo dormit jusqu'à midi, avec été.", "", {}, "", [], ""),
    ]
    rules = spark.createDataFrame([("noon", ["noon"], ["midi"], ["minuit"])], "term string, source array<string>, preferred array<string>, forbidden array<string>")
    memory = spark.createDataFrame([], "entry_id bigint, source string, draft string, final string")
    read, collect = [], type(rules).collect
    with monkeypatch.context() as m:
        m.setattr(type(rules), "collect", lambda df: read.append(df.columns) or collect(df))
        out = pipeline.literary(spark.createDataFrame(rows, _CHUNK), pipeline.Editors(ok, ok, ok, ok, ok, ok), rules, memory)
    assert read.count(["term", "source", "preferred", "forbidden"]) == 1
    assert {r.chunk_id: r.final for r in out.collect()} == {k: r[5] for k, r in ((r[0], r) for r in rows)}


def test_cast_of_a_chunk_is_what_its_source_names(spark):
    from lectern.operators import profile

    said = "“Good evening, Mister Marbo,” [[ZXEM1X]]said[[/ZXEM1X]] Lina Vasseur. Then Marbo and Lina went to Olden Keep."
    rows = [(k, "b", "c", k, t, "Bonsoir, dit-elle.", "", {}, h, m, "Lina") for k, (t, h, m) in enumerate([(said, "tu", ["Marbo", "Lina"]), ("Then Marbo slept. I saw Olden Keep.", "", ["Marbo", "Orso"]), ("nobody came.", "tu", []), (None, "", None)] * 4)]
    c = spark.createDataFrame(rows, _CHUNK)
    b = c.select(F.col("book_id").alias("book"), F.col("chapter").alias("part"), F.col("chunk_idx").alias("pos"), F.col("chunk_id").alias("id"), F.col("source").alias("text"))
    there = c.select(F.col("book_id").alias("book"), F.explode(F.concat(F.coalesce("mentioned", F.array().cast("array<string>")), F.array("speaker"))).alias("name"))
    known = profile.required_names(b).join(profile.cast(b, there), "book", "full").withColumnRenamed("book", "book_id")
    whole = c.join(known, "book_id", "left").withColumn("who", Q.who(F.col("speaker"), F.col("mentioned"), F.col("register_hint"), F.col("cast")))
    flags = Q.all_flags(F.col("source"), F.col("draft"), F.concat(F.col("draft"), F.lit(" « You » said Lina.")), F.col("names"), None, F.col("who"))
    want = {r.chunk_id: r.flags for r in whole.select("chunk_id", flags.alias("flags")).collect()}
    got = {r.chunk_id: r for r in pipeline.with_cast(c).select("chunk_id", "names", "who", flags.alias("flags")).collect()}
    assert {k: r.flags for k, r in got.items()} == want and any("name" in f for f in want[0])
    assert got[2].names == [] and got[2].who.names == [] and got[1].who.aliases == []
