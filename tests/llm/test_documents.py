"""Alignment, leakage, mixing and encodings."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import alignment as L
from lectern.llm import leakage as K
from lectern.llm import mixing as X
from lectern.llm import mojibake as G

W = "alpha beta gamma delta omega sigma kappa lambda theta zeta".split()


def test_alignment_of_names_numbers_and_cognates():
    m = L.Model()
    s = "Zora counted 12 lamps. Milo slept in 1920. Nobody came to Paris. Tavek left."
    t = "Milo dormit en 1920. Zora compta 12 lampes, et personne ne vint à Paris. Un ajout sans pareil."
    assert L.align(s, t, m) == [(1, 2), (2, 1), (3, 2)]
    assert L.align("", t, m) == L.align(s, "", m) == []


def test_alignment_table(spark):
    df = spark.createDataFrame([(1, "Zora saw 7.", "Zora vit 7."), (2, "x", None), (3, None, "y"), (4, "", "")], "section_id bigint, source string, final string")
    assert [tuple(r) for r in L.sentence_pairs(df, "section_id", "source", "final", L.Model()).collect()] == [(1, 1, 1)]



def _words(rng, n):
    return [f"w{rng.randint(0, 400)}" for _ in range(n)]


def _edited(rng, ws, rate):
    out = []
    for w in ws:
        x = rng.random()
        if x < rate / 3:
            continue
        out.append(f"v{rng.randint(0, 400)}" if x < 2 * rate / 3 else w)
        if 2 * rate / 3 <= x < rate:
            out.append("ajout")
    return out


def _exhaustive(item, text):
    """Whether text holds item, from the fewest edits for every number of matches at every pair of ends."""
    n, best = len(item), {}
    for i in range(len(item) + 1):
        for j in range(len(text) + 1):
            cell = {0: 0}
            if i and j:
                same = item[i - 1] == text[j - 1]
                for m, e in best[i - 1, j - 1].items():
                    k, cost = (m + 1, e) if same else (m, e + 1)
                    cell[k] = min(cell.get(k, 10**9), cost)
            for before in ((i - 1, j), (i, j - 1)):
                for m, e in best.get(before, {}).items():
                    cell[m] = min(cell.get(m, 10**9), e + 1)
            best[i, j] = cell
            if any(m >= max(1, K.SHARE * n) and e * (1 - K.EDITS) <= K.EDITS * m + 1e-9 for m, e in cell.items()):
                return True
    return False


def _d(ws):
    return K.digests(ws, {})


def test_verification_is_exact():
    rng = random.Random(3)
    seen = {True: 0, False: 0}
    for _ in range(250):
        item = [f"w{rng.randint(0, 12)}" for _ in range(rng.randint(1, 20))]
        n = len(item)
        part = item[rng.randint(0, n // 3) : n - rng.randint(0, n // 3)]
        text = _words(rng, rng.randint(0, 4)) + _edited(rng, part, 0.14) + _words(rng, rng.randint(0, 4))
        want = _exhaustive(item, text)
        seen[want] += 1
        assert K.holds(_d(item), _d(text)) == want
    assert min(seen.values()) > 40


def test_leaks_recall_and_precision(spark):
    rng = random.Random(9)
    items = [(k, _words(rng, n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15, *range(16, 66, 2)])]
    docs, want = [], set()
    for d in range(360):
        body = _words(rng, 60)
        if d % 2:
            k, ws = items[rng.randrange(len(items))]
            n = len(ws)
            part = ws if d % 4 == 1 else ws[n // 4 : n // 4 + (n + 1) // 2 + n // 10]
            body[30:30] = _edited(rng, part, 0.1)
        text = " ".join(body)
        text = text.title() if d % 3 == 0 else text.replace(" ", "\n[p. 12]\n", 3).replace("w1", "w\u00ad1")
        docs.append((d, text))
        words = K.comparable(text)
        for k, ws in items:
            # what shares too few words with an item, in any order, needn't be aligned
            if sum(1 for w in ws if w in words) >= K.SHARE * len(ws) and _exhaustive(ws, words):
                want.add((d, k))
    docs += [(1000, None), (1001, ""), (1002, "court"), (1003, "...")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(5))
    it = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(99, None), (98, "")], "item_id bigint, text string")
    rows = [tuple(r) for r in K.leaks(df, "doc_id", "text", it, "item_id", "text").collect()]
    assert len(rows) == len(set(rows)) and len(want) > 150
    assert set(rows) <= want
    assert len(set(rows)) >= 0.98 * len(want)
    assert {x for x in want if len(items[x[1]][1]) < K.RUN_ITEM} <= set(rows)  # short items are found exactly
    in_blocks = [tuple(r) for r in K.leaks(df, "doc_id", "text", it, "item_id", "text", block_words=60).collect()]
    assert sorted(in_blocks) == sorted(rows)
    twice = K.leaks(df.unionByName(df), "doc_id", "text", it.unionByName(it.where("item_id = 20").withColumn("text", F.lit("x"))), "item_id", "text")
    assert sorted(tuple(r) for r in twice.collect()) == sorted(rows)
    assert K.leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert K.leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_half_leaks_are_found_at_every_size():
    """Halves of items with an edit in ten words, against the exhaustive check."""
    rng = random.Random(21)
    for n in (14, 20, 24, 32, 50, 90, 170):
        items = [(k, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))) for k in range(20)]
        x = K.index_items(items)
        docs, want = [], set()
        for d in range(60):
            k = rng.randrange(20)
            ws = items[k][1].split()
            m = min(n, n // 2 + n // 16 + 2)
            a = rng.randint(0, n - m)
            body = _words(rng, 20) + _edited(rng, ws[a : a + m], 0.1) + _words(rng, 20)
            docs.append((d, body))
            if K.holds(_d(ws), _d(body)):  # exact by test_verification_is_exact
                want.add((d, k))
        got = set(K._group(docs, x, {}))
        assert len(want) > 15 and got <= want and len(got) >= 0.95 * len(want)


def test_places_of_any_size():
    item = [f"item{k}" for k in range(40)]
    filler = [f"x{k % 977}" for k in range(600_000)]
    x = K.index_items([(1, "nothing of the kind stands there at all in any of these long texts of ours"), (2, " ".join(item))])
    assert list(K._group([(7, filler + item[:25]), (8, ["x1"])], x, {})) == [(7, 2)]


def test_holds_needs_half():
    item = [f"w{k}" for k in range(40)]
    assert K.holds(_d(item), _d(item[10:30]))
    assert not K.holds(_d(item), _d(item[10:29]))
    assert not K.holds(_d(item), _d([w for k, w in enumerate(item) if k % 3]))
    assert not K.holds(_d(item), _d(list(reversed(item))))
    # half of twenty words with an edit between them
    assert K.holds(_d(item[:20]), _d(item[3:5] + ["neu"] + item[6:14]))


def test_walk_is_local():
    """Two windows with one word changed share some key more often than not."""
    rng = random.Random(1)
    for size, words in enumerate(K.window_sizes()):
        shared = 0
        for _ in range(60):
            ws = _words(rng, words)
            other = list(ws)
            other[rng.randrange(words)] = "neu"
            a, b = (K.window_keys(np.append(_d(x), np.uint64(0)), np.array([0]), np.array([words]), [size]) for x in (ws, other))
            shared += bool((a == b).any())
        assert shared > 30


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_permutation(n):
    k = np.arange(n)
    out = X._permuted(k, np.full(n, n, np.uint64), np.full(n, 99, np.uint64))
    assert sorted(out.tolist()) == list(range(n))


def test_mixture(spark):
    rng = random.Random(3)
    rows = [(k, " ".join("x" * rng.randint(0, 90)), rng.choice(["a"] * 6 + ["b", "b", "c", None])) for k in range(600)]
    rows += [(600, None, "a"), (601, "", "b"), (602, "   ", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.1, 1), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    m = X.mix(df, "doc_id", "text", "source", targets, block=16, shard_slots=100)
    n = {}
    for _, t, s in rows:
        n[s] = n.get(s, 0) + len((t or "").split())
    total = sum(n.values())
    got = {r.source: r for r in m.report.collect()}
    for s, share, most in (("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.1, 1), ("none", 0.1, 5)):
        assert got[s].tokens == n.get(s, 0)
        assert got[s].short == (n.get(s, 0) * most < share * total)
        if not got[s].short:
            assert abs(got[s].drawn_tokens - share * total) <= 48
        assert (got[s].empty_slots > 0) == got[s].short
    d = m.draws
    assert d.select("shard").distinct().count() > 5 and d.groupBy("shard").agg(F.countDistinct("slot").alias("n")).where("n > 101").count() == 0
    spans = d.groupBy("doc_id", "first_token").agg(F.count("*").alias("c"), F.first("source").alias("s")).collect()
    assert all(r.c <= {"a": 1, "b": 3, "c": 1}[r.s] for r in spans)
    size = {k: len((t or "").split()) for k, t, _ in rows}
    assert all(0 <= r.first_token <= r.last_token < size[r.doc_id] for r in d.collect())
    assert d.groupBy("slot").agg(F.sum(F.col("last_token") - F.col("first_token") + 1).alias("n")).where("n > 16").count() == 0
    assert {tuple(r) for r in X.mix(df, "doc_id", "text", "source", targets, block=16, shard_slots=100).draws.collect()} == {tuple(r) for r in d.collect()}
    empty = X.mix(df.limit(0), "doc_id", "text", "source", targets)
    assert {(r.tokens, r.short) for r in empty.report.collect()} == {(0, False)} and empty.draws.count() == 0


def test_slots_needed_are_over_the_blocks_just_where_tokens_fall_short():
    rng = random.Random(6)
    for _ in range(3000):
        tokens, repeats, block = rng.randint(1, 400), rng.randint(0, 5), rng.choice([1, 7, 16, 512])
        target = rng.choice([rng.uniform(0, 1500), float(tokens * repeats), tokens * repeats + 1e-3])
        assert (X._slots_needed(target, tokens, block) > repeats * -(-tokens // block)) == (tokens * repeats < target)


def test_draws_meet_the_quotas():
    rng = np.random.default_rng(1)
    left = np.array([10**11, 3, 0, 5 * 10**10])
    drawn = X._draw(rng, left, 10**9)
    assert drawn.sum() == 10**9 and abs(drawn[0] / 10**9 - 2 / 3) < 0.01
    assert X._draw(rng, np.array([2, 0, 3]), 9).tolist() == [2, 0, 3]
    assert X._draw(rng, np.array([], np.int64), 4).tolist() == []


def test_token_counts(spark):
    from lectern.llm.queries import TOKENIZER

    if not Path(TOKENIZER).exists():
        pytest.skip("no tokenizer file")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = [(1, "Le chat dort."), (2, None), (3, ""), (4, "<|endoftext|> été\n" * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: r.n_tokens for r in X.token_counts(df, "doc_id", "text", TOKENIZER).collect()}
    assert got[1] == len(t.encode("Le chat dort.", add_special_tokens=False).ids) > 2 and got[2] == got[3] == 0 and got[4] > 100


FRENCH = "Le garçon éleva la tête. « Où êtes-vous allé ? » demanda l'aînée, à côté de la forêt. L'été brûle déjà les prés. Noël arrive après la moisson…"
SOUND = ["Straße, Größe, Übermut.", "Ветер унёс последнее письмо.", "Zażółć gęślą jaźń, łąka śpi.", "Что? Где? Когда?", "L'ÉTÉ À LA PLAGE, ÇA VA.", "√2 × 3 ≈ 4,24 — ½ + ¼ = ¾.", "├── I\n├── II\n└── III", "été déjà", "Señor Ângelo São Paião parlait peu.", "n° 4 — © 1921, 10 £", "« Quoi ? » dit-il. ? oui", "Perché no? È così."]


@pytest.fixture(scope="module")
def classifier(spark):
    rows = [(k, f"{FRENCH} Nombre {k} ici, près du café n° {k}.") for k in range(300)] + [(300 + k, s) for k, s in enumerate(SOUND * 12)]
    return G.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")


EASTERN = ["Ветер унёс последнее письмо, и никто его не нашёл.", "Źdźbło trawy rosło ąż do nieba, łąka śniła."]
PLAIN = "Le garçon éleva la tête. Où êtes-vous allé ? demanda l'aînée, à côté de la forêt. L'été brûle déjà les prés. Noël arrive après la moisson."


@pytest.mark.parametrize("chain", [c for c in G.CHAINS if c != "sound"])
def test_chains_are_inverted(classifier, chain):
    """Each chain restores the whole text, or the one without quotation marks where its encodings lack them."""
    tried = [(t, G.garble(t, chain)) for t in (FRENCH, PLAIN, *EASTERN)]
    tried = [(t, b) for t, b in tried if b and b != t and "�" not in b]
    text, bad = next(((t, b) for t, b in tried if not b.endswith("\x85")), tried[0])
    restored, wrong, chains = G.examine(bad, classifier)
    assert wrong >= 3 and chains and restored == text


@pytest.mark.parametrize("text", [*SOUND, FRENCH])
def test_sound_texts_stay(classifier, text):
    assert G.examine(text, classifier)[:2] == (text, 0)


def test_lossy_texts_count(spark, classifier):
    rows = [(1, FRENCH.replace("é", "�")), (2, FRENCH.replace("é", "?").replace("ê", "?")), (3, None), (4, ""), (5, "a � b"), (6, FRENCH)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in G.garbled(df, "doc_id", "text", classifier=classifier).collect()) == [1, 2]
    assert G.garbled(df.limit(0), "doc_id", "text").count() == 0
