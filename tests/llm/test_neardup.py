"""Near-duplicates against brute force, with repeats, hot copies and empty records."""

import random

import numpy as np
import pytest

from lectern.llm import neardup as N
from lectern.llm.textform import words


def _registers(*sets):
    h = [N.digests(x, {}) for x in sets]
    return N.registers(np.concatenate(h), np.repeat(np.arange(len(h)), [len(x) for x in h]), len(h))


def test_registers_estimate_jaccard():
    rng = random.Random(4)
    for size, share in ((90, 0.5), (90, 0.75), (90, 0.9), (20, 0.75), (3000, 0.75)):
        off = []
        for _ in range(30):
            both = {f"w{rng.random()}" for _ in range(int(size * share))}
            only = [{f"w{rng.random()}" for _ in range(int(size * (1 - share) / 2))} for _ in range(2)]
            a, b = both | only[0], both | only[1]
            r = _registers(a, b)
            off.append(N.estimate(np.array([(r[0] == r[1]).mean()]), np.array([len(a)]), np.array([len(b)]))[0] - len(both) / len(a | b))
        assert abs(np.mean(off)) < 0.04 and max(map(abs, off)) < 0.35


def test_band_recall():
    rng = random.Random(8)
    for words in (40, 80, 140):
        found = 0
        for _ in range(300):
            union = [f"w{rng.random()}" for _ in range(words)]
            both, rest = union[: -(-3 * words // 4)], union[-(-3 * words // 4) :]
            k = N.band_keys(_registers(set(both + rest[::2]), set(both + rest[1::2])))
            found += bool((k[0] == k[1]).any())
        assert found >= 0.97 * 300


def test_leading_zeros_are_exact():
    h = np.array([1, 2, 3, 2**47, 2**47 - 1, 2**40 + 5, 2**56 - 1], dtype=np.uint64)
    r = [int(N.registers(np.array([x], np.uint64), np.array([0]), 1)[0, 0]) for x in h]
    assert len(set(r)) == len(r) and all(0 <= x < 2**16 for x in r)
    assert (N.registers(np.array([5], np.uint64), np.array([0]), 1) == N.registers(np.array([5], np.uint64), np.array([0]), 1)[0, 0]).all()


@pytest.mark.parametrize("crowd", [1, 100])
def test_against_brute_force(spark, crowd):
    rng = random.Random(7)
    vocabulary = [f"mot{k}" for k in range(300)]
    rows, i = [], 0
    for _ in range(40):
        base = rng.sample(vocabulary, rng.randint(3, 60))
        for _ in range(rng.randint(1, 6)):
            w = [x for x in base if rng.random() > 0.06] + rng.sample(vocabulary, rng.randint(0, 2))
            rng.shuffle(w)
            rows.append((i, " ".join(w), None if rng.random() < 0.2 else " ".join(w[:5]).upper()))
            i += 1
    rows += [(i + k, "copie du même texte, tel quel", "") for k in range(100)]  # a hot group of copies
    rows += [(i + 100, None, None), (i + 101, "", "…")]
    df = spark.createDataFrame(rows, "entry_id bigint, a string, words string")
    members, links = N.near_duplicates(df, "entry_id", ["a", "words"], crowd=crowd)
    got = {tuple(r) for r in N.duplicate_pairs(members, links).collect()}
    sets = {k: {w for t in (a, b) if t for w in words(t)} for k, a, b in rows}
    keys = sorted(k for k in sets if sets[k])
    want = {(a, b) for a in keys for b in keys if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    assert got == want
    counts = {r.id: (r.class_id, r.n_copies, r.n_links) for r in N.link_counts(members, links).collect()}
    assert counts[i + 5] == (i, 100, 0) and i + 100 not in counts


def test_empty_table(spark):
    df = spark.createDataFrame([], "entry_id bigint, a string")
    members, links = N.near_duplicates(df, "entry_id", ["a"])
    assert members.count() == links.count() == N.duplicate_pairs(members, links).count() == 0


def test_crowded_keys_are_joined_exactly(spark):
    """Records of one template: every band key that only the template's words make is shared by many of them."""
    rng = random.Random(11)
    rows = []
    for k in range(3000):
        own = [f"x{rng.randint(0, 10**6)}" for _ in range(12)]
        rows.append((k, " ".join([*(f"modele{j}" for j in range(40)), *own])))
        if k % 50 == 0:
            rows[-1] = (k, " ".join([*(f"modele{j}" for j in range(40)), *own[:6]]))
    rows += [(3000 + k, rows[k][1].replace(" x", " y", 3)) for k in range(1, 200, 3)]
    df = spark.createDataFrame(rows, "entry_id bigint, text string")
    members, links = N.near_duplicates(df, "entry_id", ["text"])
    sets = {k: set(t.split()) for k, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a]) + len(sets[b]) >= 0 and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    assert {(r.rep_a, r.rep_b) for r in links.collect()} == want and len(want) > 1000
    sketched = N.sketches(df, "entry_id", ["text"])
    assert sketched.selectExpr("explode(keys) as k").groupBy("k").count().agg({"count": "max"}).first()[0] > 2 * N.CROWD
    # the join's candidates don't grow with the square of the template's records
    assert N.crowded_candidates(sketched.select("id", "size", "words")).count() < 20 * len(want)


def test_keys_are_shuffled_once(spark):
    """A key of many rows, over several batches, gives its records alone; the others give all their pairs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(5, k) for k in range(40)] + [(6, k) for k in (3, 50, 51)] + [(-2, k) for k in range(60, 64)] + [(9, 70), (9, 70), (9, 71)]
        got = N._in_keys(spark.createDataFrame(rows, "key bigint, id bigint"), 4).distinct().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.rep_a for r in got if r.rep_b is None) == list(range(40))
    pairs = {(3, 50), (3, 51), (50, 51), (70, 71)} | {(a, b) for a in range(60, 64) for b in range(a + 1, 64)}
    assert {(r.rep_a, r.rep_b) for r in got if r.rep_b is not None} == pairs
