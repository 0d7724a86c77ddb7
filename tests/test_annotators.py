"""What follows from annotators' answers; contexts, numbering, reports and labels on small inputs."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import annotators as A
from lectern.operators import memory, profile, similarity, windows
from lectern.sources import records


Says = A.Answers


def _tok(text, pos, head=0, **kw):
    return {"text": text, "pos": pos, "head": head, **kw}


def test_parsed_tokens(spark):
    past = {"tense": "Past"}
    mixed = [_tok("Il", "PRON", 1), _tok("entra", "VERB", 1, verb_form="Fin", **past), _tok("a", "AUX", 3), _tok("parlé", "VERB", 3, verb_form="Part", **past)]
    plain = [_tok("Il", "PRON", 1), _tok("entra", "VERB", 1, verb_form="Fin", **past), _tok("fermée", "ADJ", 1, verb_form="Part", **past)]
    nouns = [_tok("porte", "NOUN", 0, gender="Fem", number="Sing"), _tok("grand", "ADJ", 0, gender="Masc", number="Sing"), _tok("verts", "ADJ", 0, gender="Masc", number="Plur"), _tok("beau", "ADJ", 3, gender="Masc")]
    table = {"a": [json.dumps(mixed)], "b": [json.dumps(plain)], "c": [json.dumps(nouns)], "d": ["no json"]}
    df = spark.createDataFrame([(k, k) for k in "abcde"], "id string, text string")
    p = A.parsed(df, ["id"], "text", Says(table))
    got = {r.id: (r.mix, r.agree) for r in p.select("id", A.tense_mixing(F.col("tokens")).alias("mix"), A.agreement_errors(F.col("tokens")).alias("agree")).collect()}
    assert got["a"][0] == "tense_mixing: passé simple (entra) and passé composé (parlé) in same paragraph"
    assert got["b"] == (None, []) and got["d"] == got["e"] == (None, [])
    assert got["c"][1] == ["gender_mismatch: 'porte' (Fem) + 'grand' (Masc)", "gender_mismatch: 'porte' (Fem) + 'verts' (Masc)", "number_mismatch: 'porte' (Sing) + 'verts' (Plur)"]


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "court\n" + "x" * 61 + "\n\n" + " y" * 40), (2, "court\naussi"), (3, None)], "id int, text string")
    got = sorted((r.id, r.par, r.paragraph) for r in A.paragraphs(df, ["id"], "text").collect())
    assert got == [(1, 0, "x" * 61), (1, 1, (" y" * 40).strip()), (2, 0, "court\naussi"), (3, 0, "")]


def test_grammar_messages(spark):
    df = spark.createDataFrame([(1, "!" * 50), (2, "court !"), (3, None), (4, "z" * 40)], "id int, text string")
    got = {r.id: r.messages for r in A.grammar_messages(df, ["id"], "text", A.Marks()).collect()}
    assert len(got[1]) == 5 and got[1][0] == "[EXCLAMATION] one mark (offset 0)" and got[2] == got[3] == got[4] == []


def test_speakers(spark):
    rows = [(1, "a", ""), (2, "b", None), (3, "c", "Zoe"), (4, "d", None), (5, "e", None), (6, None, None)]
    df = spark.createDataFrame(rows, "id int, source string, speaker string")
    aliases = spark.createDataFrame([("Al", "Alice"), ("bob", "Bob"), ("Carol", "Carol")], "alias string, canonical string")
    clusters = {"a": [["the door", "it"], ["Al's", "she"], ["Carol", "I"]], "b": [["Bob", "they"]], "d": [["Carol", "the woman"]], "c": [["Al", "he"]]}
    m = Says({k: [json.dumps(v)] for k, v in clusters.items()} | {"": [""]})
    got = {r.id: r.speaker for r in A.resolve_speakers(df, ["id"], aliases, m).collect()}
    assert got == {1: "Alice", 2: "Bob", 3: "Zoe", 4: None, 5: None, 6: None}


def test_memos_and_glossaries(spark):
    memos = spark.createDataFrame([("b", "1", "M1"), ("b", "2", "M2")], "book_id string, chapter string, memo string")
    chunks = spark.createDataFrame([("b", "1", k, f"s{k}", None) for k in range(5)], "book_id string, chapter string, chunk_idx int, source string, draft string")
    old = spark.createDataFrame([("b", "before")], "book_id string, memo string")
    asked = "DETERMINISTIC MEMORY:\nM1\n\nCROSS-CHAPTER STYLE MEMO:\nbefore\n\nSAMPLES:\nSOURCE:\ns0\nDRAFT:\n\n\n---\n\nSOURCE:\ns1\nDRAFT:\n"
    got = {r.chapter: r.memo for r in A.model_memos(memos, chunks, ["book_id", "chapter"], "chunk_idx", Says({asked: [" N "]}), old, 2).collect()}
    assert got == {"1": "M1\n\nLLM MEMO:\nN", "2": "M2"}
    books = spark.createDataFrame([("x", "  un texte"), ("y", "autre"), ("z", None)], "book_id string, text string")
    m = Says({"un texte": ['Voici : {"rope": {"source": ["rope"], "preferred": ["corde"]}}'], "autre": ["rien"]})
    rows = [tuple(r) for r in A.model_glossary(books, "book_id", "text", m).collect()]
    assert rows == [("x", "rope", ["rope"], ["corde"], [])]


def test_contexts(spark):
    rows = [("b", k, f"S{k}", f"D{k}" if k else None, "" if k == 1 else None, "Al" if k == 1 else "", "Bo", "tu", ["Al", "Bo"], [], {"z": "Z", "a": "A", "m": ""}) for k in range(3)]
    c = spark.createDataFrame(rows, "book string, idx int, source string, draft string, final string, speaker string, addressee string, register_hint string, participants array<string>, style_hints array<string>, alt_drafts map<string,string>")
    got = {r.idx: r.context for r in windows.context_text(c, ["book"], "idx", 1).collect()}
    assert got[1] == "CTX 0 FRENCH:\n\n\nTARGET META: speaker=Al, addressee=Bo, register=tu, scene=Al/Bo\nTARGET SOURCE:\nS1\nTARGET DRAFT:\nD1\nTARGET ALTERNATE DRAFTS:\na: A\nz: Z\n\nCTX 2 FRENCH:\nD2"
    bare = spark.createDataFrame([("b", 0, None, None, None, None, None, None, None, None, None)], c.schema)
    assert windows.context_text(bare, ["book"], "idx", 1).first().context == "TARGET META: speaker=unknown\nTARGET SOURCE:\n\nTARGET DRAFT:\n"


def test_windows_of_blocks(spark):
    b = spark.createDataFrame([("b", k, t) for k, t in enumerate(["a", " ", "c", None, "e", "f"])], "book string, pos int, text string")
    got = {r.pos: (r.before, r.target) for r in windows.preceding_text(b, ["book"], ["pos"], "pos", "text", 3).collect()}
    assert got[0] == ("", "<<<a>>>") and got[4] == ("c", "<<<e>>>") and got[3] == ("a\n\nc", "<<<>>>")
    light = {r.pos: r.chunk for r in windows.chapter_windows(b, ["book"], ["pos"], "pos", "text").collect()}
    assert light[0] == light[4] == "a\n\nc\n\ne\n\nf" and set(light) == {0, 2, 4, 5}
    s = spark.createDataFrame([("Un deux. Trois quatre! Non. Fin",), ("x. Y",), ("",), ("  seul et unique",)], "t string")
    assert [r[0] for r in s.select(windows.sentence_chunk(F.col("t"))).collect()] == ["Un deux. Trois quatre!", None, None, "  seul et unique"]


@pytest.mark.parametrize("n", [0, 1, 19, 20, 57, 400])
def test_sample_against_brute_force(spark, n):
    rows = [("hot", i * 7) for i in range(n)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(rows, "book string, id int")
    got = sorted(r.id for r in windows.systematic_sample(df, ["book"], "id").where("book = 'hot'").collect())
    step = max(1, n // 20)
    assert got == [i * 7 for i in range(0, n, step)][:20]
    placed = {r.id: (r.pos, r.n) for r in windows.numbered(df, ["book"], "id").where("book = 'hot'").collect()}
    assert placed == {i * 7: (i, n) for i in range(n)}


def test_genders_over_ends_of_files(spark):
    b = spark.createDataFrame([("b", "1", 0, 1, "Zora came. He left."), ("b", "2", 0, 2, "She sat. Zora saw her. Nobody."), ("c", "1", 0, 3, None)], "book string, part string, pos int, id int, text string")
    names = spark.createDataFrame([("b", "Zora", 9)], "book string, name string, n int")
    # windows with Zora: 0-1, 0-2, 2-4, 3-5, 4-5 of the six sentences, over the end of the file
    got = profile.genders(b, names).first()
    text = ["Zora came.", "He left.", "She sat.", "Zora saw her.", "Nobody."]
    held = [w for k in range(5) if "Zora" in (w := " ".join(text[max(0, k - 1) : k + 2]))]
    count = lambda ws: sum(x.strip(".").lower() in ws for w in held for x in w.split())
    assert (got.m, got.f) == (count({"he", "him", "his"}), count({"she", "her", "hers"}))


def test_texts(spark):
    df = spark.createDataFrame([("  a\n b ",), ("",), (None,), ("x" * 400,)], "t string")
    assert [r[0] for r in df.select(T.short_error(F.col("t"), F.lit("KeyError"))).collect()] == ["a b", "KeyError", "KeyError", "x" * 317 + "..."]
    df = spark.createDataFrame([("Chapter 1",), ("chapter twenty-one",), ("ch 120",), ("Épilogue: fin!",), ("…",)], "t string")
    assert [r[0] for r in df.select(T.chapter_label(F.col("t"))).collect()] == ["Chapter_One", "Chapter_Twenty_One", "Chapter_120", "pilogue_fin", "Chapter"]


def test_cache_is_written_once_and_its_last_value_holds(spark):
    calls = spark.sparkContext.accumulator(0)
    cache = spark.createDataFrame([("m", "a", "old", 1), ("m", "a", "new", 2), ("other", "b", "x", 3)], "namespace string, key string, value string, t int").withColumn("created_at", F.timestamp_seconds("t"))

    def call(df):
        def once(x):
            calls.add(1)
            return x

        return df.select("key", F.udf(once)(F.col("key")).alias("value"))

    df = spark.createDataFrame([("a",), ("b",), ("b",)], "q string")
    answers, new = memory.memoised(df, cache, "m", F.col("q"), call)
    assert sorted((r.q, r.value) for r in answers.collect()) == [("a", "new"), ("b", "b"), ("b", "b")]
    assert [r.value for r in new.collect()] == ["b"] and calls.value == 1


def test_records_at_the_edges(spark, tmp_path):
    for k, lines in enumerate((['{"index": 1, "translation": "un"}'], ['{"index": 1, "translation": "deux"}', '{"index": 1, "translation": "trois"}'])):
        f = tmp_path / "lines" / f"z{9 - k}.json"  # the later file's name comes first
        f.parent.mkdir(exist_ok=True)
        f.write_text("\n".join(lines))
        os.utime(f, (1000 + k, 1000 + k))
    c = records.checkpoint_lines(spark, str(tmp_path / "lines"))
    assert memory.last_checkpoint(c, ["index"], ["seq"]).first().translation == "trois"
    (tmp_path / "memo.txt").write_text("\n Ton vif. \n")
    assert [r.memo for r in records.memo_text(spark, str(tmp_path / "memo.txt")).collect()] == ["Ton vif."]
    assert records.memo_text(spark, str(tmp_path / "none.txt")).count() == 0
    df = spark.createDataFrame([("b", None, 2)], "book string, note string, a int")
    for _ in range(2):
        records.write_report(df, str(tmp_path / "report"))
        records.append_summary(df, str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ['{"book":"b","note":null,"a":2}']
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ['{"a":2,"book":"b","note":null}'] * 2


def test_similar_classes_and_examples_with_hot_copies(spark):
    rng = random.Random(3)
    words = [f"mot{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    base = [rng.sample(words, 12) for _ in range(12)]
    rows = [(k, " ".join(w if rng.random() > 0.12 else rng.choice(words) for w in rng.choice(base))) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(80)] + [(300, None), (301, ""), (302, "a b")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    members, links = similarity.similar_classes(df, "id", "text", 56, 100)
    sets = {i: frozenset(t.split()) for i, t in rows if t and i < 300}
    reps = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert {r.id: r.rep for r in members.collect()} == reps
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b) for a in set(reps.values()) for b in set(reps.values()) if a != b and jac(a, b) >= 0.56}
    assert {(r.rep_a, r.rep_b) for r in links.collect()} == want and want
    got = sorted((r.id, r["rank"], r.other) for r in similarity.class_examples(members, "id", links).collect())
    best = []
    for i in sets:
        near = sorted((j for j in sets if j != i and jac(i, j) >= 0.56), key=lambda j: (-jac(i, j), j))
        best += [(i, k, j) for k, j in enumerate(near[:3], 1)]
    assert got == sorted(best)


def test_semantic_profile_and_hints(spark):
    texts = ["He felt joy and happy hope. Would you please come?", "She walked. She arrived?", None, ""] + ["Please sit, sir. Could you open it?"] * 4
    b = spark.createDataFrame([("b", "1", k, k, t) for k, t in enumerate(texts)] + [("c", "1", 0, 100, None)], "book string, part string, pos int, id int, text string")
    p = profile.semantic_profile(b)
    got = {r.book: r for r in p.collect()}
    assert got["b"].n_sampled == 8 and got["b"].register == "formal" and got["c"].register == "mixed" and got["c"].sentiment == 0 and got["c"].top_emotions == []
    assert {a.act for a in got["b"].acts} and sum(a.n for a in got["b"].acts) >= 5 and [a.n for a in got["b"].acts] == sorted((a.n for a in got["b"].acts), reverse=True)
    arc = profile.emotional_arc(profile.semantic_sample(b)).collect()
    assert arc and all(r.id == 0 for r in arc) and abs(sum(r.score for r in arc) - 1) < 0.01
    hints = {r.book: r.hints for r in profile.semantic_hints(p).collect()}
    assert hints["c"] == "" and "Text uses formal register; prefer 'vous' in ambiguous dialogue." in hints["b"].split("\n")
    assert hints["b"].startswith("Dominant emotional register: ") and "Frequent speech act: " in hints["b"]


def test_characters(spark):
    said = '“Come home now, dear boat,” Zora said. Milo slept.'
    b = spark.createDataFrame([("b", "1", k, k, said if k < 3 else "Milo saw Zora.") for k in range(6)], "book string, part string, pos int, id int, text string")
    names = spark.createDataFrame([("b", "Zora", 6), ("b", "Milo", 6), ("b", "Nil", 5)], "book string, name string, n int")
    got = {r.name: r for r in profile.character_profiles(b, names).collect()}
    assert (got["Zora"].mean_words, got["Zora"].words[:2]) == (5.0, ["boat", "come"]) and got["Milo"].mean_words == 0.0
    assert (got["Nil"].gender, got["Nil"].mean_words, got["Nil"].words) == ("neutral", 0.0, [])
