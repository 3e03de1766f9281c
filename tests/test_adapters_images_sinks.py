import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import tokenizers as K
from docloom.operators import chunks as C
from docloom.operators import evaluation as E
from docloom.operators import graph as H
from docloom.operators import images as I
from docloom.operators import models as M
from docloom.operators import splitters as P
from docloom.sources import documents as D
from docloom.sources import sinks
from docloom.streaming import ingest as S


def page():
    out = np.full((200, 300, 3), 255, dtype=np.uint8)
    for y in range(30, 180, 20):
        out[y : y + 5, 30:270] = 0
    return out


def test_skew_stamps_and_binarisation():
    whole = page()
    assert I.skew(whole) == 0 and I.skew(np.full((50, 50, 3), 255, dtype=np.uint8)) == 0
    for angle in (-5.0, 3.0):
        turned = I.rotated(whole, -angle)
        assert abs(abs(I.skew(turned)) - abs(angle)) <= 0.5
        assert abs(I.skew(I.deskewed(turned)[0])) <= 0.5
    stamped = whole.copy()
    stamped[60:100, 100:160] = (30, 30, 200)
    mask = I.red_mask(stamped)
    assert mask[70:90, 110:150].all() and not mask[:40].any() and not I.red_mask(whole).any()
    clean = I.filled(stamped, mask)
    assert (clean[..., 2].astype(int) - clean[..., 0])[80, 130] < 20
    assert np.array_equal(I.filled(whole, np.ones(whole.shape[:2], bool)), whole)
    black = I.binarised(whole)
    assert set(np.unique(black)) == {0, 255} and (black == 0).any() and black.mean() > 127
    assert I.binarised(255 - whole).mean() > 127


def test_crops_and_contrast():
    whole = page()
    cut = I.crop(whole, np.array([[270, 25], [30, 25], [30, 40], [270, 40]]), pad=3)
    assert cut.shape[:2] == (21, 246) and cut[8, 100].max() < 40 and cut[1, 100].min() > 200
    assert I.corners(np.array([[9, 9], [0, 0], [9, 0], [0, 9]])).tolist() == [[0, 0], [9, 0], [9, 9], [0, 9]]
    grey = np.linspace(100, 140, 64 * 64).reshape(64, 64).astype(np.uint8)
    assert I.contrast(grey).std() > grey.std() and I.contrast(np.full((5, 5), 7, dtype=np.uint8)).shape == (5, 5)


def test_pages_in_batches(spark):
    raw = page()
    df = spark.createDataFrame([("p", 1, bytearray(raw.tobytes())), ("p", 2, bytearray(b"x")), ("p", 3, None)], "path string, page_number int, image binary")
    got = {r.page_number: r for r in I.prepare_pages(df, lambda b: np.frombuffer(b, dtype=np.uint8).reshape(200, 300, 3), lambda a: a.tobytes()).collect()}
    assert got[1].error is None and got[1].skew == 0 and len(got[1].image) == 200 * 300 and got[2].error and got[3].error and got[3].image is None


def test_tokenizer_adapter(spark):
    assert K.flat_ids(np.array([[1, 2]])) == [1, 2] == K.flat_ids(((1, 2),)) == K.flat_ids([1, 2]) and K.flat_ids([]) == []
    with pytest.raises(ValueError):
        K.flat_ids(5)
    assert K.longest_input(None, 10**30, 512) == 512 and K.longest_input(None) == 256
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "k long, t string")
    counted = K.token_counts(df, "k", "t", "split", lambda: lambda t: [list(range(len(t.split())))], 2)
    assert {r.k: r.n_tokens for r in counted.collect()} == {1: 5, 2: None, 3: 2}
    assert {r.k: r.compatible for r in K.require_fit(counted, 4, "mark").collect()} == {1: False, 2: True, 3: True}
    with pytest.raises(Exception, match="more than the 4 tokens"):
        K.require_fit(counted, 4).collect()


def test_semantic_chunks_are_packed(spark):
    rows = [("d", 1, "một hai ba", [1.0, 0.0]), ("d", 2, "bốn năm", [1.0, 0.05]), ("d", 3, "khác hẳn. " * 30, [0.0, 1.0]), ("d", 4, "x", [0.0, 1.0]), ("e", 1, "đơn", [1.0, 0.0]), ("f", 1, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "k string, o int, t string, v array<double>")
    made = P.semantic(df.where("t is not null"), "k", "o", "t", "v", 0.5)
    got = P.packed(made, "k", "chunk_index", "chunk", 4, 20).orderBy("k", "chunk_index").collect()
    assert all(r.n_tokens <= 20 for r in got) and {r.k for r in got} == {"d", "e"}
    assert "".join("".join(r.chunk.split()) for r in got if r.k == "d").replace(".", "") == ("mộthaibabốnnăm" + "kháchẳn" * 30 + "x")
    assert P.packed(made.limit(0), "k", "chunk_index", "chunk", 4, 20).count() == 0


def test_names_stores_and_layouts(spark, monkeypatch, tmp_path):
    assert D.with_names(spark.createDataFrame([(1, 2)], "_c0 int, b int")).columns == ["col1", "b"]
    monkeypatch.delenv("DOCLOOM_S3_ENDPOINT", raising=False)
    assert not D.object_store(spark)
    monkeypatch.setenv("DOCLOOM_S3_ENDPOINT", "http://store:9000")
    assert D.object_store(spark) and spark.sparkContext._jsc.hadoopConfiguration().get("fs.s3a.endpoint") == "http://store:9000"
    files = spark.createDataFrame([("s/a.pdf", 1)], "path string, length long")
    rows = D.objects_of(spark.createDataFrame([("a.pdf",), ("b.pdf",)], "n string"), files, F.col("n"))
    assert tuple(D.download_report(rows).first()) == (2, 1, 1)
    images = spark.createDataFrame([("p", 1, bytearray(b"i")), ("p", 2, None)], "path string, page_number int, image binary")
    got = {r.page_key: r.payload for r in M.layouts(images, "fake", lambda: lambda pages: [None if p is None else '{"pages": []}' for p in pages]).collect()}
    assert got == {"p#1": '{"pages": []}', "p#2": None}
    prompts = spark.createDataFrame([(1, "a")], "k long, t string")
    assert {r.model for r in M.benchmark(prompts, "k", "t", {"m": lambda: lambda t: t, "n": lambda: lambda t: t}).collect()} == {"m", "n"}


def test_versions_graph_and_debug(spark, tmp_path):
    one = spark.createDataFrame([("d", "An", "reward", "khen")], "document_id string, name string, event_type string, description string")
    found = H.mentions(one)
    for _ in range(4):
        sinks.write_graph(H.semantic_nodes(found), H.semantic_edges(found), str(tmp_path / "g"))
    nodes, edges = sinks.read_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == 2 and edges.count() == 3 and sorted(p.name for p in (tmp_path / "g/nodes").iterdir() if p.name[0] == "v") == ["v3", "v4"]
    with pytest.raises(ValueError):
        sinks.read_version(spark, str(tmp_path / "none"))
    kg = spark.createDataFrame([('{"persons": [{"name": "An"}], "events": []}',), ('{"events": []}',)], "t string")
    assert H.validated(kg.where("t like '%persons%'"), "t").first().kg.persons[0].name == "An"
    with pytest.raises(Exception, match="not a knowledge graph"):
        H.validated(kg, "t").collect()
    parents = spark.createDataFrame([("d", "p", "t")], "document_id string, chunk_id string, text string")
    children = spark.createDataFrame([("d", 1, "b", 5, None), ("d", 0, "a", 7, "token_window")], "document_id string, chunk_index int, chunk_id string, token_count int, how string")
    meta = spark.createDataFrame([("D", "1/QĐ", "An", "x", "2020")], "id string, doc_no string, author string, summary string, datedocument string")
    made = C.debug_json(parents, children, meta).first()
    body = json.loads(made.value)
    assert body["statistics"] == {"parent_count": 1, "child_count": 2, "average_child_tokens": 6.0, "max_child_tokens": 7, "fallback_token_splits": 1} and [c["chunk_id"] for c in body["children"]] == ["a", "b"] and body["document"]["doc_no"] == "1/QĐ"
    sinks.write_debug(C.debug_json(parents, children, meta), str(tmp_path / "debug"))
    assert json.loads(spark.read.text(str(tmp_path / "debug")).first().value)["parents"][0]["chunk_id"] == "p"
    assert C.together(parents, children).count() == 3
    rates = spark.createDataFrame([("a", 0.1, 0.2), ("b", 0.09, 0.3), ("c", 0.1, 0.1)], "m string, cer double, wer double")
    assert [r.m for r in E.ranked_report(rates, "cer", "wer").orderBy("place").collect()] == ["b", "c", "a"]


def test_kept_table_of_a_stream(spark, tmp_path):
    schema = "id long, v int, at int"
    spark.createDataFrame([(i, i, 1) for i in range(20)], schema).write.parquet(str(tmp_path / "in"))
    for turn in range(2):  # the second checkpoint begins anew and changes nothing
        S.upsert_into(S.watch(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), str(tmp_path / "out"), ["id"], ["at"], str(tmp_path / f"c{turn}"), 3).processAllAvailable()
        for q in spark.streams.active:
            q.stop()
    spark.createDataFrame([(3, 99, 2), (4, 0, 0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    S.upsert_into(S.watch(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), str(tmp_path / "out"), ["id"], ["at"], str(tmp_path / "c1"), 3).processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    got = {r.id: r.v for r in S.read_kept(spark, str(tmp_path / "out")).collect()}
    assert got == {i: 99 if i == 3 else i for i in range(20)}
