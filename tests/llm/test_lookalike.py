from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import lookalike as L


def test_pairs():
    same = [("Điều", "Ðiều"), ("abc", "аbс"), ("ＴＣ１２", "TC12"), ("a\u00a0b", "a  b"), ("cộng\u200b", "c\u00f4\u0323ng"), ("x‑y", "x-y"), ("x\u3000y\u2009z", "x y z"), ("Ηuỳnh", "Huỳnh"), ("a\u034f\u0323\u0302", "ậ"), ("", "\u200b")]
    for a, b in same:
        assert L.skeleton(a) == L.skeleton(b), (a, b)
    for a, b in [("o", "0"), ("Abc", "abc"), ("an", "ân"), ("a1", "al"), ("định", "đinh"), ("a b", "ab"), ("a—b", "a-b")]:
        assert L.skeleton(a) != L.skeleton(b), (a, b)


@settings(max_examples=200, deadline=None)
@given(st.text("aăâđĐð оοｅ\u0301\u0323\u00a0\u200b-‑１1", max_size=12))
def test_skeleton_and_canonical_settle(text):
    assert L.skeleton(L.skeleton(text)) == L.skeleton(text)
    assert L.skeleton(L.canonical(text)) == L.skeleton(text)
    assert L.canonical(L.canonical(text)) == L.canonical(text)


def test_real_words_of_other_scripts_stay():
    assert L.canonical("Москва") == "Москва" and L.canonical("Κοινωνία") == "Κοινωνία"


def test_operators(spark):
    long = "ｘ" * 20000
    rows = [(1, "a\u00a0b", "a b", "k"), (1, "a\u00a0b", "a b", "k"), (2, "ab", "ac", "k"), (3, None, "x", "k"), (4, "x", None, "k"), (5, "", "\u200b", "k"), (6, long, "x" * 20000, "k"), (None, "аb", "ab", "k"), (7, "q", "q", "k"), (8, "ab", "z", "k")]
    df = spark.createDataFrame(rows, "id long, left string, right string, a string")
    assert sorted((r.id or 0) for r in L.alike(df, "id", "left", "right").collect()) == [0, 1, 5, 6]
    canon = {r.id: (r.left, r.right) for r in L.canonical_fields(df, "id", ["left", "right"]).collect()}
    assert canon[1] == ("a b", "a b") and canon[3] == (None, "x") and canon[6][0] == "x" * 20000 and len(canon) == 9
    groups = L.groups(df, "id", "left").collect()
    assert [(g.forms, g.rows, g.first_key) for g in groups] == [(2, 3, 2)]
    for made in (L.alike(df.limit(0), "id", "left", "right"), L.canonical_fields(df.limit(0), "id", ["left"]), L.groups(df.limit(0), "id", "left")):
        assert made.count() == 0


def test_letters_of_the_public_list(spark):
    more = L.prototypes(spark)
    assert len(more) > 150 and all(b.isascii() and b.isalpha() for _, b in more)
    shape = L.shape_of(more)
    for a, b in [("ꓮꓐ", "ꓮꓐ"), ("Ꭺbc", "Abc"), ("𐐬k", "ok"), ("ꮃ", "w"), ("ⲟ", "o"), ("Ӏ", "l")]:
        assert L.skeleton(a, shape) == L.skeleton(b, shape), (a, b)
    for a, b in [("o", "0"), ("l", "1"), ("I", "l"), ("đ", "d"), ("ơ", "o"), ("ư", "u"), ("ß", "b"), ("rn", "m")]:
        assert L.skeleton(a, shape) != L.skeleton(b, shape), (a, b)
    df = spark.createDataFrame([(1, "Ꭺbc", "Abc"), (2, "Ꭺbc", "abc")], "id long, left string, right string")
    assert [r.id for r in L.alike(df, "id", "left", "right").collect()] == [1]


@pytest.mark.parametrize("said", [None, lambda text: "\n".join(text.split("\n")[:-1]), lambda text: "", lambda text: text])
def test_a_list_that_cannot_be_read_is_told(said):
    text = SimpleNamespace()
    if said:
        setattr(text, "SpoofChecker$Builder", lambda: SimpleNamespace(build=lambda: SimpleNamespace(getSkeleton=said)))
    jvm = SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=text))))
    for session in (SimpleNamespace(_jvm=jvm), SimpleNamespace(_jvm=None), SimpleNamespace()):
        with pytest.raises(RuntimeError, match="confusables"):
            L.prototypes(session)


def test_operators_raise_without_the_list(spark):
    rows = spark.createDataFrame([(1, "Ꭺbc", "Abc")], "id long, left string, right string")
    df = SimpleNamespace(select=rows.select, sparkSession=SimpleNamespace())
    for made in (lambda: L.alike(df, "id", "left", "right"), lambda: L.groups(df, "id", "left")):
        with pytest.raises(RuntimeError, match="confusables"):
            made()
