import json
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators import shred as S

ATOM = st.one_of(st.integers(-5, 5), st.booleans(), st.text("ab. ", max_size=3))
NODE = st.recursive(ATOM, lambda c: st.one_of(st.lists(c, max_size=3), st.dictionaries(st.sampled_from(["a", "b.c", "d[", "e~"]), c, max_size=3)), max_leaves=12)


def flat(node, path="", at=()):
    if isinstance(node, dict):
        for k, v in node.items():
            yield from flat(v, f"{path}.{S._step(k)}" if path else S._step(k), at)
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from flat(v, path + "[]", (*at, i))
    elif node is not None:
        yield path, at, node


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("xyz"), NODE, max_size=3))
def test_round_trip(record):
    back = [(p, at, v) for p, found in S.unstripe(S.stripe(record)).items() for at, v in found]
    key = lambda r: (r[0], r[1], str(r[2]))
    assert sorted(back, key=key) == sorted(flat(record), key=key)


PAGE = {
    "num_pages": 9,
    "pages": [
        {"page_id": "page_007", "width": 100, "blocks": [
            {"label": "TITLE", "bbox": "1,2,3,4", "ocr": {"lines": [{"text": "a"}, {"text": " "}]}, "children": [
                {"type": "text", "box": [[1, 2], [3, 2], [3, 5], [1, 5]], "ocr": ["x", "y"]},
                {"type": " ", "bbox": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}, "ocr": True}]},
            {"label": "x", "bbox": [1, None, 3, 4], "ocr": "z"},
            None]},
        {"blocks": []},
        {"layout_blocks": [{"category_name": "t", "bbox_xyxy": ["1", "2", "3", "4"], "ocr": {"rec_text": "q"}}]},
    ],
}


def test_tables(spark):
    rows = [(1, json.dumps(PAGE), "u"), (1, json.dumps(PAGE), "v"), (2, None, ""), (3, "", ""), (4, "{", ""), (5, "[1]", ""), (6, "{}", ""), (7, '{"pages": NaN}', ""), (None, '{"pages": [{}]}', "")]
    df = spark.createDataFrame(rows, "rec_id long, payload string, chunks string")
    shredded = S.shred(df)
    got = {(r.page_pos, r.block_path): r for r in S.block_table(shredded).collect()}
    assert set(got) == {(0, "0"), (0, "0.0"), (0, "0.1"), (0, "1"), (0, "2"), (2, "0")}
    assert got[0, "0"].texts == ["a"] and got[0, "0"].bbox == [1, 2, 3, 4] and got[0, "0"].parent_path == ""
    assert got[0, "0.0"].texts == ["x", "y"] and got[0, "0.0"].bbox == [1, 2, 3, 5] and got[0, "0.0"].parent_path == "0"
    assert got[0, "0.1"].texts == [] and got[0, "0.1"].label is None and got[0, "1"].bbox is None
    assert got[2, "0"].texts == ["q"] and got[2, "0"].bbox == [1, 2, 3, 4]
    pages = sorted((r.rec_id or 0, r.page_pos, r.page_number, r.width) for r in S.page_table(shredded).collect())
    assert pages == [(0, 0, 1, None), (1, 0, 7, 100.0), (1, 1, 2, None), (1, 2, 3, None)]
    assert sorted((r.rec_id, r.reason) for r in S.unreadable(df).collect()) == [(2, "null"), (3, "blank"), (4, "malformed"), (5, "not an object"), (7, "malformed")]
    assert S.line_table(S.block_table(shredded)).count() == 5
    assert S.block_table(S.shred(df.limit(0))).count() == 0


def test_in_one_stage_or_two(spark):
    rows = [(1, json.dumps(PAGE)), (1, json.dumps(PAGE)), (2, None), (3, '{"pages": [{"blocks": [{"label": "x"}]}]}'), (4, "{"), (None, json.dumps(PAGE))]
    df = spark.createDataFrame(rows, "rec_id long, payload string")
    key = lambda r: str(tuple(r))
    assert sorted(map(key, S.blocks_of(df).collect())) == sorted(map(key, S.block_table(S.shred(df)).collect()))
    assert sorted(map(key, S.pages_of(df).collect())) == sorted(map(key, S.page_table(S.shred(df)).collect()))
    assert S.blocks_of(df.limit(0)).count() == 0


class Source:
    """Stands for a table: gives what a worker runs over its batches."""

    def select(self, *names):
        return self

    def mapInArrow(self, run, ddl):
        return run


def peak_mb(run, batch):
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in run(iter([batch])))
        return rows, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_does_not_grow_with_the_batch(monkeypatch):
    monkeypatch.setattr(S, "_source", lambda df, key, payload: Source())
    pages = {"pages": [{"blocks": [{"label": "x", "bbox": [1, 2, 3, 4], "ocr": {"lines": [{"text": "điều khoản" * 9}] * 60}}] * 4}] * 2}
    batch = lambda n: pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([json.dumps(pages)] * n)], names=["rec_id", "payload"])
    few, many = 60, 240
    for run, each in ((S.blocks_of(None), 8), (S.pages_of(None), 2), (S.shred(None), 1)):
        (rows, small), (more, large) = peak_mb(run, batch(few)), peak_mb(run, batch(many))
        assert (rows, more) == (each * few, each * many)
        assert large < 1.5 * small + 1, (small, large)


def test_parts_of_a_batch():
    batch = lambda sizes: pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64())], names=["rec_id"])
    for sizes in ([], [0], [0, 0, 0], [9 * S.AT_A_TIME], [1, 9 * S.AT_A_TIME, 1, 0], [S.AT_A_TIME] * 3, [S.AT_A_TIME // 2 + 1] * 7):
        parts = list(S._parts(batch(sizes), np.array(sizes, dtype=np.int64)))
        assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(sizes)))
        for part in parts:
            assert sum(sizes[i] for i in part.column(0).to_pylist()[:-1]) <= S.AT_A_TIME


def test_parts_give_what_the_whole_gives(spark, monkeypatch):
    rows = [(k, json.dumps(PAGE | {"k": "x" * 40 * k})) for k in range(30)] + [(30, None), (31, "{")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["rec_id", "payload"])
    monkeypatch.setattr(S, "_source", lambda df, key, payload: Source())

    def made():
        chunks = pa.Table.from_batches(list(S.shred(None)(iter([batch])))).combine_chunks().to_batches()
        return [pa.Table.from_batches(list(run(iter(given)))).to_pylist() for run, given in ((S.blocks_of(None), [batch]), (S.pages_of(None), [batch]), (S.unreadable(None), [batch]), (S.block_table(Source()), chunks), (S.page_table(Source()), chunks))]

    key = lambda r: str(r)
    whole = [sorted(rows, key=key) for rows in made()]
    for size in (1, 1500, 5000):
        monkeypatch.setattr(S, "AT_A_TIME", size)
        assert [sorted(rows, key=key) for rows in made()] == whole
    assert len(whole[0]) == 180 and whole[0] == whole[3] and whole[1] == whole[4]
