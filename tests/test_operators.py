"""Operators on small tables: orders, ties, nulls, repeats and empty inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import dialogue, evaluate, memory, models, profile, rerank, similarity, strings, windows


def test_batches(spark):
    texts = {2: "a b", 3: "a b c", 5: "a b c d e", 9: "a b c d e f g h i", 20: " ".join("a" * 20), 21: " ".join("a" * 21)}
    rows = [(1, k, texts[n]) for k, n in enumerate((2, 3, 5, 9, 9, 20, 21))]
    df = spark.createDataFrame(rows, "doc int, id int, text string")
    got = windows.batches(df, ["doc"], "id", "text", 20, 4).collect()
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append(r.tokens)
    assert [sorted(v) for _, v in sorted(by.items())] == [[2, 3, 5, 9], [9], [20], [21]]
    assert windows.batches(df.limit(0), ["doc"], "id", "text").count() == 0


def test_hop_and_centred(spark):
    c = spark.createDataFrame([("a", 10), ("b", 7), ("c", 1), ("d", 0)], "doc string, n int")
    got = sorted((r.doc, r.start, r.end) for r in windows.hop_windows(c, ["doc"]).collect())
    assert got == [("a", 0, 5), ("a", 3, 8), ("a", 6, 10), ("b", 0, 5), ("b", 3, 7)]
    s = spark.createDataFrame([("a", p, 10) for p in (0, 4, 9)], "doc string, pos int, n int")
    assert sorted((r.start, r.end) for r in windows.centred_windows(s, ["doc"]).collect()) == [(0, 5), (2, 7), (5, 10)]


def test_short_groups(spark):
    rows = [(1, k, t) for k, t in enumerate(["Hi."] * 6 + ["x" * 70] + ["Yes."], 1)]
    g = {r.idx: r.group for r in windows.short_groups(spark.createDataFrame(rows, "doc int, idx int, s string"), ["doc"], "idx", "s").collect()}
    assert g == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 8}


def test_dialogue_fold():
    cast = dialogue.Cast([("Alice", "Alice"), ("Al", "Alice"), ("Bob", "Bob"), ("Carol", "Carol")], [("Alice", "Bob", "intimate_partner"), ("Bob", "Alice", "intimate_partner"), ("Alice", "Carol", "friends")])
    rows = [(1, '"Are you coming?" Alice asked.'), (2, '"I promise," Bob said.'), (3, "The room was cold."), (4, '"You two should go!"'), (5, None)]
    got = list(dialogue.fold_chapter(rows, cast))
    assert [g[1:4] for g in got] == [("Alice", "Bob", "informal"), ("Bob", "Alice", "informal"), ("", "", ""), ("Alice", "Bob", "plural_or_formal_allowed"), ("", "", "")]
    assert got[0][4] == ["Alice"] and got[0][5] == ["Alice", "Bob"]


def test_mentions_of_long_aliases(spark):
    c = spark.createDataFrame([(1, "Mary Ann met Ann."), (2, None), (3, "Marianne")], "id int, t string")
    a = spark.createDataFrame([(1, "Mary Ann", "M"), (2, "Ann", "A")], "ord int, alias string, canonical string")
    assert sorted((r.id, r.canonical) for r in dialogue.mentions(c, ["id"], "t", a).collect()) == [(1, "A"), (1, "M")]


def test_rerank_order_and_ties(spark):
    rows = [(1, 0, "a", 1, 900), (1, 1, "b", 0, 100), (1, 2, "c", 0, 100), (2, 1, "x", 0, 5), (2, 0, "y", 0, 5)]
    df = spark.createDataFrame(rows, "k int, ord int, name string, hard int, score10 bigint")
    for seed in range(3):
        shuffled = df.orderBy(F.rand(seed))
        assert {r.k: r.name for r in rerank.rerank(shuffled, ["k"]).collect()} == {1: "b", 2: "y"}


def test_similar_above_is_complete(spark):
    rng = random.Random(3)
    vocabulary = [a + b + "el" for a in "bcdfg" for b in ("ar", "or", "ul", "in", "et", "os", "am", "ip")]
    rows = [(k, " ".join(rng.sample(vocabulary, rng.randint(0, 12)))) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, text string")
    other = df.withColumnRenamed("id", "other")
    got = {(r.id, r.other) for r in similarity.similar_above(df, "id", other, "other", "text", 56, 100).collect()}
    sets = {k: set(t.split()) for k, t in rows}
    want = {(a, b) for a in sets for b in sets if sets[a] and sets[b] and len(sets[a] & sets[b]) * 100 >= 56 * len(sets[a] | sets[b])}
    assert got == want


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(90, 8))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(90, None), (91, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, e array<double>")
    got = similarity.knn(df.where("vec_id < 5"), "vec_id", df.withColumnRenamed("vec_id", "nn"), "nn", "e", 4).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(5):
        s = np.round(u @ u[q], 4)
        want = sorted(range(90), key=lambda i: (-s[i], i))[:4]
        assert [r.nn for r in sorted((r for r in got if r.vec_id == q), key=lambda r: r["rank"])] == want


def test_chrf(spark):
    rows = [(1, "le chat noir", "le chat noir"), (2, "le chat noir", "le chien noir"), (3, "ab", "ab"), (4, "", "x"), (5, None, "x")]
    o = similarity.ngram_overlap(spark.createDataFrame(rows, "id int, a string, b string"), ["id"], "a", "b")
    assert {r.id: round(r.chrf, 2) for r in similarity.chrf(o, ["id"]).collect()} == {1: 100.0, 2: 44.17, 3: 100.0}


def test_new_corrections_idempotent(spark):
    rows = [(1, "s", "d", "f", []), (2, "s", "d", "f", []), (3, "s", "d", "d", []), (4, "t", None, "f", ["x"]), (5, "u", None, "f", None), (6, None, "d", None, [])]
    df = spark.createDataFrame(rows, "id int, source string, draft string, final string, flags array<string>")
    empty = df.select("source", "draft", "final").limit(0)
    added = memory.new_corrections(df, empty, "id")
    assert sorted(r.id for r in added.collect()) == [1, 5]
    assert memory.new_corrections(df, added.select("source", "draft", "final"), "id").count() == 0


def test_memoised_calls_once(spark):
    req = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, t string")
    cache = spark.createDataFrame([("n", "b", "B")], "namespace string, key string, value string")
    answers, new = memory.memoised(req, cache, "n", F.col("t"), lambda d: d.select("key", F.upper("key").alias("value")))
    assert sorted((r.id, r.value) for r in answers.collect()) == [(1, "A"), (2, "A"), (3, "B")]
    assert new.count() == 1


def test_glossary_flags(spark):
    rules = spark.createDataFrame([("hockey", [r"\bhockey\b"], [r"\bhockey\b"], []), ("trail", [r"\btrails?\b"], [r"\bsentiers?\b"], [r"\bpiste\b"])], "term string, source array<string>, preferred array<string>, forbidden array<string>")
    p = spark.createDataFrame([(1, "A Trail", "une piste"), (2, "hockey", "Le hockey"), (3, None, None)], "id int, s string, t string")
    got = sorted((r.id, r.flag) for r in memory.glossary_flags(p, ["id"], rules, "s", "t").collect())
    assert got == [(1, "glossary_forbidden_trail"), (1, "glossary_missing_trail")]


def test_infer_isolates_failures(spark):
    class Failing:  # local, so that workers get it by value
        name = "failing"

        def load(self):
            pass

        def run(self, texts, contexts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [[t.upper()] for t in texts]

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "id int, t string")
    got = {r.id: (r.outputs, r.error) for r in models.infer(df.coalesce(1), ["id"], "t", Failing()).collect()}
    assert got[1] == (["OK"], None) and got[3] == (None, None)
    assert got[2][0] is None and got[2][1].startswith("ValueError")


def test_repair_leaves_no_marker_missing(spark):
    from lectern.functions import quality as Q

    rows = [(1, "[[ZXB1X]]now[[/ZXB1X]] go", "allez maintenant"), (2, "[[ZXI1X]]x[[/ZXI1X]]", "y"), (3, "plain", "simple"), (4, None, None)]
    r = strings.repair_markers(spark.createDataFrame(rows, "id int, s string, c string"), "s", "c")
    got = {x.id: x.repaired for x in r.collect()}
    assert got == {1: "allez [[ZXB1X]]maintenant[[/ZXB1X]]", 2: "y [[ZXI1X]]x[[/ZXI1X]]", 3: "simple", 4: None}
    assert r.where(F.size(Q.missing_markers(F.col("s"), F.col("repaired"))) > 0).count() == 0


def test_profile_of_a_book(spark):
    rows = [("b", "ch1", k, k, t) for k, t in enumerate(["Then Alice saw him. He met Alice.", "So Alice ran. His dog barked.", "Alone with Alice he stayed.", "Again Alice and Bob met.", "The Alice again.", None, ""])]
    b = spark.createDataFrame(rows, "book string, part string, pos int, id int, text string")
    names = profile.frequent_names(b)
    assert [(r.name, r.n) for r in names.collect()] == [("Alice", 6)]
    assert [(r.m, r.f, r.gender) for r in profile.genders(b, names).collect()][0][2] == "male"
    assert profile.profile(b).count() == 1
    assert profile.profile(b.limit(0)).count() == 0


def test_prefix_matches(spark):
    p = spark.createDataFrame([(1, "a b c", "abX"), (2, None, "x"), (3, "", "")], "id int, a string, b string")
    assert {r.id: (r.n_compared, r.n_match) for r in evaluate.prefix_matches(p, ["id"], "a", "b").collect()} == {1: (3, 2), 2: (0, 0), 3: (0, 0)}


@pytest.mark.parametrize("a,b,score", [("", "", 0), ("ab", "", -4), ("abc", "abc", 6)])
def test_global_alignment(a, b, score):
    assert strings._score(a, b, 2, -1, -2) == score


def test_prefix_candidates_of_frequent_tokens(spark):
    """Every token is frequent, so that pairs of prefixes are nearly all pairs; few but the similar ones leave the join."""
    import random

    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(120)]
    sets = [frozenset(rng.sample(vocabulary, rng.randint(8, 30))) for _ in range(1100)]
    for k in range(0, 1000, 5):  # an inexact repeat
        sets[k + 1] = frozenset([*sorted(sets[k])[2:], rng.choice(vocabulary)])
    jac = lambda x, y: len(x & y) * 100 >= len(x | y) * 56
    want = {(a, b) for a in range(1100) for b in range(a + 1, 1100) if jac(sets[a], sets[b])}
    df = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "id bigint, tokens array<string>")
    got = [(r._l, r._r) for r in similarity.prefix_candidates(df, None, 56, 100).collect()]
    assert len(got) == len(set(got)) and want <= set(got) and 150 < len(want) and len(got) < 0.02 * 1100 * 1100 / 2
    half = df.where("id < 700").withColumnRenamed("id", "left"), df.where("id >= 400").withColumnRenamed("id", "right")
    two = {(r.left, r.right) for r in similarity.similar_tokens(half[0], "left", half[1], "right", 56, 100).collect()}
    assert two == {(a, b) for a in range(700) for b in range(400, 1100) if jac(sets[a], sets[b])}


def test_memory_similar_of_one_table_is_that_of_two(spark):
    rows = [(k, " ".join(f"word{(k // 3 + j) % 40}" for j in range(9 + k % 3)), f"mot{k // 2} autre{k // 2} fin", "tu" if k % 2 else None) for k in range(120)]
    m = spark.createDataFrame(rows, "id bigint, source string, draft string, register_hint string")
    pairs = lambda df: sorted((r.id, r.other, round(r.similarity, 9)) for r in df.collect())
    one = pairs(similarity.memory_similar(m, "id", None, "other"))
    two = pairs(similarity.memory_similar(m, "id", m.withColumnRenamed("id", "other"), "other").where("id <> other"))
    assert one == two and len(one) > 120


def test_entity_forms_repeats_no_text_for_its_words(spark):
    rows = [("Al saw Mr Zed near the zedwood.", "Al vit Mr Zed."), ("al, MR ZED", "Mr Zed"), ("Mr. Zed", "al"), (None, "Al"), ("Al Al", None)]
    c = spark.createDataFrame(rows, "s string, t string")
    e = spark.createDataFrame([("Al",), ("Mr Zed",), ("Zed",), ("—",), ("wood",)], "entity string")
    df = memory.entity_forms(c, e, "s", "t")
    assert {r.entity: r.n for r in df.collect()} == {"Al": 1, "Mr Zed": 2, "Zed": 2}
    generated = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in x]
    assert generated and not any("_t#" in x for x in generated)


def test_links_are_verified_where_they_meet(spark, monkeypatch):
    """Of a self-join only what is shuffled with the rows and the links themselves are written, no candidates."""
    rng = random.Random(21)
    vocabulary = [f"mot{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(90)]
    sets = {k: frozenset(rng.sample(vocabulary, rng.randint(1, 14))) for k in range(500)}
    sets |= {500 + k: frozenset(list(sets[k])[1:] or ["seul"]) for k in range(300)}
    df = spark.createDataFrame([(k, " ".join(sorted(v))) for k, v in sets.items()], "entry_id bigint, source string")
    written = []
    keep = similarity.shared_table
    monkeypatch.setattr(similarity, "shared_table", lambda t, label: written.append(label) or keep(t, label))
    members, links = similarity.similar_classes(df, "entry_id", "source", 56, 100)
    rep = {}
    for k, v in sorted(sets.items()):
        rep.setdefault(v, k)
    assert {(r.entry_id, r.rep) for r in members.collect()} == {(k, rep[v]) for k, v in sets.items()}
    want = {(rep[a], rep[b], len(a & b), len(a | b)) for a in rep for b in rep if a != b and len(a & b) * 100 >= len(a | b) * 56}
    got = [tuple(r) for r in links.collect()]
    assert set(got) == want and len(got) == len(want) > 300
    assert "candidates" not in written


def test_candidates_of_long_sets_are_few(spark):
    import random

    from lectern.operators import similarity as S

    rng = random.Random(12)
    common, rest = [f"c{k}" for k in range(34)], [f"w{k}" for k in range(600)]
    sets = [sorted({*common, *rng.sample(rest, 30)}) for _ in range(160)]  # about a third of two sets' tokens in both
    sets += [[x for x in sets[k] if x != sets[k][k % 30]] for k in range(12)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(sets)], "id bigint, tokens array<string>")
    got = [(r["_l"], r["_r"]) for r in S.prefix_candidates(df, None, 51, 100).collect()]
    near = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len({*sets[a]} & {*sets[b]}) * 100 >= 51 * len({*sets[a]} | {*sets[b]})}
    assert near <= {*got} and len(got) == len({*got}) and len(near) >= 12 and len(got) < len(near) + 300
