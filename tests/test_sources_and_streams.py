import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunks as C
from docloom.operators import packing as P
from docloom.sources import documents as D
from docloom.sources import sinks as K
from docloom.streaming import ingest as S


def test_ocr_json(spark, tmp_path):
    page = {"page_id": "page_002", "width": 100, "height": 200, "layout_blocks": [{"category_name": "Title", "bbox_xyxy": [10, 20, 50, 40], "content": "Điều 1"}, {"order": 7, "type": "text", "box": [0.1, 0.2, 0.3, 0.4], "ocr": {"rec_text": "x"}}]}
    (tmp_path / "A1.json").write_text(json.dumps({"pages": [page]}), "utf-8")
    (tmp_path / "b.json").write_text("{", "utf-8")
    docs = D.read_json(spark, str(tmp_path))
    rows = D.ocr_blocks(docs).orderBy("block_index").collect()
    assert [(r.document_id, r.page_number, r.block_index, r.block_type, r.content_raw) for r in rows] == [("a1", 2, 1, "Title", "Điều 1"), ("a1", 2, 7, "text", "x")]
    assert rows[0].bbox == [0.1, 0.1, 0.5, 0.2] and rows[1].bbox == [0.1, 0.2, 0.3, 0.4]
    meta = spark.createDataFrame([("a1",), ("B",), ("c",), (None,)], "id string")
    found = {r.document_id: (r.file_path or "").rpartition("/")[2] for r in D.resolve_paths(meta, D.discover(spark, str(tmp_path))).collect()}
    assert found == {"a1": "A1.json", "B": "b.json", "c": ""}
    assert [r.stem for r in D.discover(spark, str(tmp_path), limit=1).collect()] == ["A1"]


def test_metadata_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("\ufeffID,no,Author\n1,5/QĐ,An\n", "utf-8")
    r = D.read_metadata(spark, str(tmp_path / "m.csv")).first()
    assert (r.id, r.doc_no, r.author, r.summary) == ("1", "5/QĐ", "An", None)
    (tmp_path / "o.json").write_text('{"Summary": "x"}')
    with pytest.raises(Exception, match="needs an Id"):
        D.metadata_override(spark, str(tmp_path / "o.json")).collect()


def test_collections(spark, tmp_path):
    root = str(tmp_path / "store")
    path = K.create_collection(spark, root, "v2", 2)
    with pytest.raises(ValueError):
        K.create_collection(spark, root, "documents_v1", 2)
    with pytest.raises(ValueError):
        K.create_collection(spark, root, "v2", 3)
    with pytest.raises(ValueError):
        K.create_collection(spark, root, "none", 2, create=False)
    one = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [1.0, 0.0], 1)], "id string, vector array<double>, version int")
    K.upsert_points(one, path, 2)
    K.upsert_points(spark.createDataFrame([("a", [0.0, 1.0], 2), ("c", [0.0, 1.0], 2)], one.schema), path, 2)
    assert {r.id: r.version for r in K.read_points(spark, path).collect()} == {"a": 2, "b": 1, "c": 2}
    with pytest.raises(Exception, match="dimension"):
        K.upsert_points(spark.createDataFrame([("z", [0.0], 1)], one.schema), path, 2)
    assert not K.write_csv(one.select("id").limit(0), str(tmp_path / "csv")) and K.write_csv(one.select("id"), str(tmp_path / "csv"))


def test_chunks_end_to_end(spark):
    table = "<table><thead><tr><th>Môn</th><th>Điểm</th></tr></thead><tbody><tr><td>Toán</td><td>9</td></tr></tbody></table>"
    more = "<table><thead><tr><td>PHYS 101</td><td>8</td></tr></thead></table>"
    rows = [(1, "D", 1, 1, "title", [0.1, 0.02, 0.9, 0.05], "QUYẾT ĐỊNH"), (2, "D", 1, 2, "text", [0.1, 0.1, 0.9, 0.2], "Điều 1. " + "Nội dung dài. " * 200), (3, "d", 1, 3, "table", [0.1, 0.6, 0.9, 0.95], table), (4, "d", 2, 1, "table", [0.1, 0.04, 0.9, 0.2], more), (5, "d", 2, 2, "text", [0.1, 0.5, 0.9, 0.6], "Nơi nhận:\n- Như Điều 3;"), (6, "d", 2, 3, "text", [0.1, 0.9, 0.9, 0.95], "2"), (1, "D", 1, 1, "title", [0.1, 0.02, 0.9, 0.05], "QUYẾT ĐỊNH")]
    ocr = spark.createDataFrame(rows, "block_key long, document_id string, page_number int, block_index int, block_type string, bbox array<double>, content_raw string")
    meta = spark.createDataFrame([("D", "5/QĐ", "An", "Tóm tắt", "2020")], "id string, doc_no string, author string, summary string, datedocument string")
    parents, children = C.build(ocr, meta)
    made = children.orderBy("chunk_index").collect()
    assert all(3 <= r.token_count <= 256 for r in made) and made[0].retrieval_text.startswith("Văn bản: Tóm tắt\nSố: 5/QĐ")
    cells = [r for r in made if r.unit_type == "table_row"]
    assert [(r.page_start, r.section_path) for r in cells] == [(1, ["QUYẾT ĐỊNH", "Điều 1", "Bảng"]), (2, ["QUYẾT ĐỊNH", "Điều 1", "Bảng"])] and len({r.table_parent_id for r in cells}) == 1
    assert P.violations(children, parents).count() == 0
    assert {c for r in parents.collect() for c in r.child_ids} == {r.chunk_id for r in made}
    again = C.build(ocr.repartition(5), meta)[1].orderBy("chunk_index").collect()
    assert [r.chunk_id for r in again] == [r.chunk_id for r in made]
    bad = children.withColumn("token_count", F.lit(1)).withColumn("parent_id", F.lit("x"))
    assert {r.rule for r in P.violations(bad, parents).collect()} == {"no parent", "wrong count"}
    with pytest.raises(Exception, match="wrong count"):
        P.require_valid(bad, parents).collect()


def test_streams(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:10:00", 1.0), (1, "a", "2024-01-01 00:10:00", 1.0), (2, "a", "2024-01-01 00:20:00", 2.0), (3, "b", "2024-01-01 05:00:00", 3.0)]
    df = spark.createDataFrame(rows, "id long, g string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = S.watch(spark, str(tmp_path / "in"), df.schema)
    got = S.drain(S.windowed(stream, "ts", "g", "v")).collect()
    assert sorted((r.g, r.n, r.total) for r in got) == [("a", 3, 4.0), ("b", 1, 3.0)]
    assert S.drain(S.once_each(stream, ["id"], "ts"), "append").count() == 3
    assert sorted(r.n for r in S.drain(S.sessions(stream, "ts", "g")).collect()) == [1, 3]
