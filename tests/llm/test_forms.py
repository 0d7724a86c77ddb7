"""Sentences, skeletons and pieces."""

import random
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lectern.llm import pieces as P
from lectern.llm import skeletons as S
from lectern.llm.textform import LINE, confusables, fold_table, one_form, sentences, skeleton


def test_sentence_rule():
    assert sentences("M. Li vint. « Oui ! » dit-il. 3 chats…\nfin") == ["M. Li vint.", "« Oui ! » dit-il.", "3 chats…", "fin"]
    assert sentences("Mr. X and Dr. Y. (Then) no. but") == ["Mr. X and Dr. Y.", "(Then) no. but"]
    assert sentences("« A. » « B. »") == ["« A. »", "« B. »"]
    assert sentences("") == sentences(" \n ") == []


@pytest.mark.parametrize(
    "a,b",
    [("ﬁn", "fin"), ("Ａｂ１", "Ab1"), ("été", "été"), ("a b", "a b"), ("so­ft​", "soft"), ("Nоn", "Non"), ("…", "..."), ("K", "K"), ("a　b", "a b"), ("﻿x", "x")],
)
def test_same_reading(a, b):
    assert skeleton(a) == skeleton(b)


@pytest.mark.parametrize("a,b", [("x²", "x2"), ("a", "A"), ("é", "e"), ("–", "-"), ("l", "1"), ("O", "0"), ("«", '"'), ("ß", "ss")])
def test_other_reading(a, b):
    assert skeleton(a) != skeleton(b)


def test_confusables_without_icu_fail():
    class Checker:
        SpoofChecker = property(lambda self: self)
        Builder = build = lambda self: self

        def getSkeleton(self, text):
            return "a"  # of fewer letters than were asked

    class Spark:
        class _jvm:
            com = type("", (), {"ibm": type("", (), {"icu": type("", (), {"text": Checker()})})})

    with pytest.raises(ValueError):
        confusables(Spark)
    Spark._jvm.com.ibm.icu.text = None
    with pytest.raises(AttributeError):
        confusables(Spark)


def test_all_confusables(spark):
    letters = confusables(spark)
    assert len(letters) > 250
    table = fold_table() | letters
    for c, like in {"Ꭺ": "A", "ⲟ": "o", "ꓐ": "B", "Ь": "b", "а": "a", "Ӏ": "I", "І": "I", "ο": "o", "ѕ": "s"}.items():
        assert skeleton(c, table) == like
    for c in "ɑᴏıøßłæλи가각²①١":  # Latin letters, letters without a like, other scripts' syllables, raised and other figures
        assert skeleton(c, table) == unicodedata.normalize("NFD", c)
    rows = [(1, "Coquille"), (2, "Ꮯoquille"), (3, "Cоquille"), (4, "coquille"), (5, "Cɔquille")]
    got = S.look_alike_pairs(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (1, 3), (2, 3)]


@given(st.text(max_size=40))
def test_skeleton_is_stable(t):
    assert skeleton(skeleton(t)) == skeleton(t)
    assert one_form(one_form(t)) == one_form(t)
    assert skeleton(unicodedata.normalize("NFD", t)) == skeleton(unicodedata.normalize("NFC", t))


def test_pairs_and_groups(spark):
    rows = [(1, "Oui."), (2, "Oui."), (3, "Ｏui."), (4, " Oui. "), (5, "* * *"), (6, "* * *"), (7, None), (8, ""), (9, "Non"), (10, "Nоn")]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumnRenamed("text", "skeleton")  # a clashing name
    got = sorted(tuple(r) for r in S.look_alike_pairs(df, "id", "skeleton").collect())
    assert got == [(1, 3), (2, 3), (3, 4), (9, 10)]
    groups = {r.id: (r.group_id, r.n_forms, r.n_texts) for r in S.look_alike_groups(df, "id", "skeleton").collect()}
    assert groups[4] == (1, 2, 4) and groups[10] == (9, 2, 2) and 5 not in groups and 7 not in groups
    assert {r.id: r.canonical for r in S.canonical(df, "id", "skeleton").collect()}[10] == "Non"
    assert S.look_alike_pairs(df.limit(0), "id", "skeleton").count() == 0


def _text(seed):
    rng = random.Random(seed)
    parts = []
    for _ in range(rng.randint(1, 60)):
        parts.append("".join(rng.choice("abcdefgh") for _ in range(rng.choice((3, 5, 8, 1500 if rng.random() < 0.02 else 6)))))
        parts.append(rng.choice((" ", " ", ". A", "\n", "  ", "! « ")))
    return "".join(parts) * rng.randint(1, 4)


@pytest.mark.parametrize("seed", range(30))
def test_pieces_tile_and_fit(seed):
    t = _text(seed)
    out = P.split_text(t, 200, 20)
    assert "".join(t[own:end] for _, own, end, _ in out) == t
    if len(t) > 200:
        assert all(end - start <= 200 and own - start <= 20 for start, own, end, _ in out)
        assert all(a[2] == b[1] for a, b in zip(out, out[1:]))
    else:
        assert len(out) == 1


def _by_definition(text, limit):
    if all(len(x) <= limit for x in LINE.split(text)):
        return "paragraph"
    if all(len(x) <= limit for x in sentences(text)):
        return "sentence"
    return "word" if all(len(x) <= limit for x in text.split()) else "none"


@pytest.mark.parametrize("seed", range(60))
def test_needed_boundary(seed):
    t = _text(seed)
    for limit in (3, 8, 20, 60, 200, 1600):
        assert P.needed_boundary(t, limit) == _by_definition(t, limit)


@given(st.text(alphabet="ab. \n\tA«", max_size=60), st.integers(1, 12))
def test_needed_boundary_of_any_text(t, limit):
    assert P.needed_boundary(t, limit) == _by_definition(t, limit)


def test_boundaries():
    line = "Un mot. " * 10
    assert P.needed_boundary("\n".join([line] * 20)) == "paragraph"
    assert P.needed_boundary(line * 20) == "sentence"
    assert P.needed_boundary("mot " * 400) == "word"
    assert P.needed_boundary("x" * 1001) == "none"
    with pytest.raises(ValueError):
        P.cut_points("x" * 30, 10, 10)


def test_weak_boundaries_are_merged_first():
    t = ("Aa bb cc. " * 5).strip() + "\n" + ("Dd ee ff. " * 5).strip()
    parts = [t[a:b] for _, a, b, _ in P.split_text(t, 70, 5)]
    assert parts[0].endswith("cc.\n") and parts[1].startswith("Dd")


def test_split_oversized(spark):
    df = spark.createDataFrame([(1, "mot " * 400), (2, "court"), (3, None), (4, "")], "id bigint, text string")
    rows = P.split_oversized(df, "id", "text").orderBy("piece_no").collect()
    assert {r.row_id for r in rows} == {1} and rows[0].boundary == "word"
    assert "".join(r.piece[r.own_start :] for r in rows) == "mot " * 400
    assert all(50 < r.own_start <= 100 for r in rows[1:])
