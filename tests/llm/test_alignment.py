"""Sentence alignment: gaps against brute force, repeated sentences, and recall on documents made by another rule."""

import random
from functools import cache

import numpy as np
import pytest

from lectern.llm import alignment as L


def _best(a, b, s, known, back, least):
    """Value of the best monotone alignment by plain recursion."""

    @cache
    def f(x, y):
        if not x or not y:
            return 0.0
        out = max(f(x - 1, y), f(x, y - 1))
        g = s[x - 1][y - 1] - least
        if g > 0:
            out = max(out, f(x - 1, y - 1) + g)
            if x > 1 and s[x - 2][y - 1] > least:
                v = g + s[x - 2][y - 1] - least - max(0, back[x - 1][y - 1] + back[x - 2][y - 1] - 1)
                out = max(out, f(x - 2, y - 1) + v) if v > 0 else out
            if y > 1 and s[x - 1][y - 2] > least:
                v = g + s[x - 1][y - 2] - least - max(0, known[x - 1][y - 1] + known[x - 1][y - 2] - 1)
                out = max(out, f(x - 1, y - 2) + v) if v > 0 else out
        return out

    return f(a, b)


@pytest.mark.parametrize("seed", range(40))
def test_gap_is_the_best_alignment(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, 14, 2)
    s, known, back = (np.where(rng.random((a, b)) < 0.5, rng.random((a, b)), 0.0) for _ in range(3))
    links = L._gap(a, b, s.__getitem__, known.__getitem__, back.__getitem__, 0.3)
    assert len(links) == len(set(links))
    # the value of the links, bead by bead
    value, order = 0.0, sorted(links)
    for x, y in order:
        value += s[x][y] - 0.3
        if (x - 1, y) in links:
            value -= max(0, back[x][y] + back[x - 1][y] - 1)
        if (x, y - 1) in links:
            value -= max(0, known[x][y] + known[x][y - 1] - 1)
    assert value == pytest.approx(_best(a, b, s.tolist(), known.tolist(), back.tolist(), 0.3))
    assert all(p[0] <= q[0] and p[1] <= q[1] for p, q in zip(order, order[1:]))


@pytest.mark.parametrize("n", [1, 3, 400, 2000])
def test_equal_sentences_link_in_order(n):
    assert L.align("Zora saw the lamp. " * n, "Zora vit la lampe. " * n, L.Model()) == [(i, i) for i in range(1, n + 1)]


def test_unequal_numbers_of_equal_sentences():
    links = L.align("Zora saw 7 lamps. " * 700, "Zora vit 7 lampes. " * 650, L.Model())
    assert len(links) == 650 and len({i for i, _ in links}) == len({j for _, j in links}) == 650


def _document(rng, words, n):
    """(source, target, links): sentences of invented words with a word for word rendering, some left out, added,
    joined, divided or moved."""
    names = ["Orlin", "Bezka", "Tumar", "Yselt", "Quorra"]
    src, tgt, links = [], [], []
    for k in range(n):
        ws = rng.sample(sorted(words), rng.randint(4, 9))
        s = f"{rng.choice(names)} {' '.join(ws)}."
        t = [s.split()[0], *(words[w] for w in ws)]
        src.append(s)
        x = rng.random()
        if x < 0.06:
            continue  # left out
        if x < 0.12 and len(t) > 6:  # divided
            h = len(t) // 2
            tgt += [(" ".join(t[:h]).capitalize() + ".", [k]), ("Et " + " ".join(t[h:]) + ".", [k])]
        elif x < 0.18 and tgt and k - 1 in tgt[-1][1] and len(tgt[-1][1]) == 1:  # joined with the one before
            tgt[-1] = (tgt[-1][0][:-1] + ", et " + " ".join(t) + ".", [k - 1, k])
        else:
            tgt.append((" ".join(t) + ".", [k]))
        if x > 0.95:
            tgt.append(("Ajout de " + " ".join(f"neuf{rng.randint(0, 999)}" for _ in range(5)) + ".", []))
    for _ in range(n // 30):  # moved
        a = rng.randrange(len(tgt))
        tgt.insert(rng.randrange(len(tgt)), tgt.pop(a))
    for j, (_, of) in enumerate(tgt):
        links += [(i + 1, j + 1) for i in of]
    return " ".join(src), " ".join(t for t, _ in tgt), set(links)


def test_recall_and_precision():
    rng = random.Random(12)
    words = {f"kel{k}o": f"dir{k}e" for k in range(400)}
    m = L.Model(renders={w: frozenset((t,)) for w, t in words.items()})
    found = true = right = 0
    for n in (5, 30, 30, 120, 120, 600):
        s, t, want = _document(rng, words, n)
        got = set(L.align(s, t, m))
        found, true, right = found + len(got), true + len(want), right + len(got & want)
    assert right / true > 0.97 and right / found > 0.97


def test_longest_chain():
    assert L._chain([(0, 3, 1), (1, 0, 1), (2, 1, 1), (3, 2, 1)]) == [(1, 0), (2, 1), (3, 2)]
    assert L._chain([]) == []
