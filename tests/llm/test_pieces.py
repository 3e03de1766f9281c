import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import pieces as P

SMALL = P.Limits(most=20, overlap=4, extra=2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["từ", "x", ".", ",", "\n\n", "\n", "câu này.", "12/3", "a_b"]), max_size=120).map(" ".join))
def test_cuts(text):
    tokens = [m.span() for m in P.TOKEN.finditer(text)]
    made = P.cuts(text, SMALL)
    if len(tokens) + 2 <= 20:
        assert made == [(0, len(text), len(tokens) + 2)]
        return
    assert len(made) > 1 and all(n <= 20 for _, _, n in made)
    held = [[t for t in tokens if t[0] >= s and t[1] <= e] for s, e, _ in made]
    assert [len(h) + 2 for h in held] == [n for _, _, n in made]
    for a, b in zip(held, held[1:]):
        assert b[:4] == a[-4:] and len(b) > 4
    assert held[0] + [t for h in held[1:] for t in h[4:]] == tokens


def best_by_trial(text, at):
    """Least cost over all ways to cut."""
    import numpy as np

    spans = np.array([m.span() for m in P.TOKEN.finditer(text)])
    n, room = len(spans), at.most - at.extra
    step = room - at.overlap
    count = 1 + -(-(n - room) // step)
    fair = max(1.0, (n + (count - 1) * at.overlap) / count)
    pen = P._penalties(text, spans[:, 0], spans[:, 1], at)

    def go(i):
        if i == n:
            return 0.0
        width, extra = (room, 0) if i == 0 else (step, at.overlap)
        return min(pen[j - 1] + at.each + at.imbalance * ((j - i + extra - fair) / fair) ** 2 + go(j) for j in range(i + 1, min(n, i + width) + 1))

    return go(0), pen, fair


def test_cheapest():
    at = P.Limits(most=8, overlap=2, extra=2)
    for text in ("a b. c d e f g h i j", "a b c d\n\ne f g h i, j k l", "a b c d e f g h i j k"):
        least, pen, fair = best_by_trial(text, at)
        ends = [len(P.TOKEN.findall(text[:e])) for _, e, _ in P.cuts(text, at)]
        cost, i = 0.0, 0
        for j in ends:
            cost += pen[j - 1] + at.each + at.imbalance * ((j - i + (at.overlap if i else 0) - fair) / fair) ** 2
            i = j
        assert cost == pytest.approx(least)


def test_prefers_joints():
    text = " ".join(["từ"] * 150) + ".\n\n" + " ".join(["chữ"] * 150)
    made = P.cuts(text)
    assert len(made) == 2 and text[made[0][1] - 1] == "."


def test_operator(spark):
    rows = [(1, "x " * 300, ["a"], "p"), (1, "x " * 300, ["a"], "p"), (2, None, None, "p"), (3, "", [], "p"), (4, "y", None, "p"), (5, "z" * 100000, None, "p"), (None, "w", None, "p"), (6, "!" * 3000, None, "p")]
    df = spark.createDataFrame(rows, "chunk_key long, raw_text string, section_path array<string>, piece string")
    got = P.split(df).dropDuplicates(["chunk_key", "piece_index"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.chunk_key, []).append(r)
    assert set(by) == {1, 3, 4, 5, 6, None} and len(by[1]) == 2 and len(by[5]) == 1 and by[3][0].n_tokens == 2
    assert all(r.n_tokens <= 256 for r in got) and by[1][0].section_path == ["a"] and by[4][0].section_path is None
    assert P.split(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.Limits(most=20, overlap=18)
