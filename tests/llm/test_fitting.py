"""Fitting over whole tables: against a plain version on lists, and rows that a sample would leave out."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import alignment as L
from lectern.llm import answers as A
from lectern.llm import fitting


def _greedy(sets, least=4):
    """The cover of answers.fit_lexicon, word by word."""
    n, n_t = len(sets), Counter(t for _, wt in sets for t in wt)
    common = {t for t, c in n_t.items() if c >= max(4, A.COMMON * n)}
    where, out = defaultdict(list), {}
    for k, (ws, _) in enumerate(sets):
        for w in ws:
            where[w].append(k)
    for w, at in where.items():
        c, picked, left = len(at), set(), at
        if c < least:
            continue
        if sum(1 for k in at if w in sets[k][1]) >= 0.5 * c:
            out[w] = frozenset((w,))
            continue
        while len(left) > 0.03 * c and len(picked) < 8:
            beside, best, value = Counter(t for k in left for t in sets[k][1]), "", 0.0
            for t, k in beside.items():
                if k * n >= 3.0 * n_t[t] * len(left) and t not in common and k >= 0.08 * len(left) and (k >= 3 or picked):
                    x = k / len(left) * math.log(k * n / (len(left) * n_t[t]))
                    if x > value or (x == value and t < best):
                        best, value = t, x
            if not best:
                break
            picked.add(best)
            left = [k for k in left if best not in sets[k][1]]
        if picked and len(left) <= 0.07 * c:
            out[w] = frozenset(picked)
    return out


def test_cover_is_the_greedy_one(spark):
    rng = random.Random(3)
    words = {f"w{k}": [f"m{k}", f"n{k}", f"o{k}"][: rng.randint(1, 3)] for k in range(60)}
    pairs = []
    for _ in range(1500):
        ws = rng.sample(sorted(words), rng.randint(2, 6)) + [f"Nom{rng.randint(0, 40)}"]
        pairs.append((" ".join(ws), " ".join([rng.choice(words.get(w, [w])) for w in ws if rng.random() > 0.01] + ["le"])))
    m = A.Model()
    A.fit_lexicon(spark.createDataFrame(pairs, "source string, text string"), m)
    want = _greedy([(set(s.lower().split()), set(t.lower().split())) for s, t in pairs])
    assert m.renders == want and len(want) > 80 and m.pairs == 1500 and m.common == {"le"}


def _rare(spark, rows, seed, share):
    """Pairs of which six, outside the sample of a hash of the id, hold a word that no other pair holds."""
    rng = random.Random(6)
    out = spark.range(rows).where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(share)) != 0).orderBy("id").limit(6).collect()
    rare = {r.id for r in out}
    text = lambda names: (f"{names[0]} saw the {names[1]}.", f"{names[0]} vit le {names[2]}.")
    nouns = [("cat", "chat"), ("dog", "chien"), ("boat", "bateau"), ("hat", "chapeau"), ("door", "portail"), ("lamp", "falot"), ("bench", "banc"), ("bell", "grelot")]
    return [(k, *text((rng.choice(["Zora", "Milo", "Tavek"]), *(("shuttle", "navette") if k in rare else rng.choice(nouns))))) for k in range(rows)]


def test_lexicon_is_of_all_pairs(spark):
    df = spark.createDataFrame(_rare(spark, 8100, 3, 2), "chunk_id bigint, source string, final string")
    assert L.lexicon(df, "source", "final").renders["shuttle"] == {"navette"}


def test_answers_are_fitted_on_all_rows(spark):
    df = spark.createDataFrame([(k, s, t, t, "m", "p") for k, s, t in _rare(spark, 5100, 11, 2)], "chunk_id bigint, source string, draft string, final string, model string, patcher string")
    m = A.fit(df)
    assert m.renders["shuttle"] == {"navette"} and "navette" in m.seen and m.pairs == 5100
    scores = {(r.chunk_id, r.field): r.cut_log_odds for r in A.cut_scores(df.where("chunk_id < 40"), m).collect()}
    assert len(scores) == 80 and max(scores.values()) < m.threshold


def test_regression_finds_the_least_loss(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (400, 3)).astype(np.uint16) + np.array([0, 6, 12], np.uint16)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 2.5)))).astype(int)
    df = spark.createDataFrame([(bytearray(a.tobytes()), int(b), k % 3) for k, (a, b) in enumerate(zip(x, y))], "x binary, y int, fold int")
    w = fitting.regression(df, 18, 3)
    for k, own in enumerate([*(np.arange(400) % 3 != f for f in range(3)), np.ones(400, bool)]):
        z = w[k][x[own]].sum(axis=1)
        grad = np.bincount(x[own].ravel(), np.repeat(1 / (1 + np.exp(-z)) - y[own], 3), 18) + fitting.PRIOR * w[k]
        assert np.abs(grad).max() < 2.0
    at = np.array([-1.0, 1.0])
    held = fitting.held_out(df, w, at)
    assert held.sum() == 400 and held[1].sum() == y.sum() and held[1, 2] > held[0, 2]


def test_packed_examples_count_as_single_ones(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 18, (300, 3)).astype(np.uint16)
    rows = [(a.tolist(), int(a[0] > 8), k % 3) for k, a in enumerate(x)]
    schema = "x binary, y int, fold int"
    single = spark.createDataFrame([(bytearray(np.array(a, np.uint16).tobytes()), y, f) for a, y, f in rows], schema)
    monkey = A.FEATURES
    try:
        A.FEATURES = 3
        groups = list(A._packed(iter(rows), most=7))
    finally:
        A.FEATURES = monkey
    assert len(groups) < 60 and sum(len(g[0]) for g in groups) == 300 * 6 and max(len(g[0]) for g in groups) == 42
    packed = spark.createDataFrame([(bytearray(g), y, f) for g, y, f in groups], schema)
    w = fitting.regression(packed, 18, 3, 3)
    assert np.allclose(w, fitting.regression(single, 18, 3), atol=1e-6)
    at = np.array([-1.0, 1.0])
    assert (fitting.held_out(packed, w, at, 3) == fitting.held_out(single, w, at)).all()
