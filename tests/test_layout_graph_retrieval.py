import math
import uuid

import pytest
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import ids as I
from docloom.functions import text as X
from docloom.operators import evaluation as E
from docloom.operators import graph as H
from docloom.operators import layout as L
from docloom.operators import metadata as M
from docloom.operators import models
from docloom.operators import outline as O
from docloom.operators import retrieval as R


def test_ids(spark):
    ids = ["236D88A1-27EA-1FCC-8D85-2D393D4BDF04", "không phải uuid", "236d88a127ea1fcc8d852d393d4bdf04"]
    df = spark.createDataFrame([(i, "v2:x:điều") for i in ids], "d string, n string")
    got = [r.u for r in df.select(I.stable_id("d", "n").alias("u")).collect()]
    want = [str(uuid.uuid5(uuid.UUID(i) if "-" in i or len(i) == 32 else uuid.uuid5(uuid.NAMESPACE_URL, i), "v2:x:điều")) for i in ids]
    assert got == want
    assert df.select(I.block_id(F.lit(3), F.lit(12)).alias("b")).first().b == "page_003_block_0012"
    assert df.limit(1).select(I.slug("person", F.lit(" Lê An ")).alias("s")).first().s == "person_l_an"


def test_text(spark):
    one = lambda c, **k: spark.createDataFrame([(k.get("t"),)], "t string").select(c.alias("x")).first().x
    assert one(X.tidy("t"), t=" e\u0302\u00a0 b \r\n\r\n\r\n\r\n c ") == "ê b\n\nc"
    assert one(X.compact("t", 10), t="một hai ba bốn") == "một hai..." and one(X.words("t"), t="Điều  1, KTX's!") == ["điều", "1", "ktx's"]
    assert one(X.match_key("t"), t="ĐIỀU ５") == "dieu 5" and one(X.token_count("t"), t="a_b, c!") == 6 and one(X.first_filled("t", F.lit(" z ")), t="  ") == "z"
    assert one(X.clean_answer("t"), t="assistant: Dòng [E1] một\nDÒNG MỘT\nnguồn: x\nhai -\nCâu hỏi: z") == "Dòng một\nhai"
    assert one(X.after_prompt("t", F.lit("hỏi?")), t="hỏi? đáp hỏi?: xong") == "xong" and one(X.after_prompt("t", F.lit("q")), t="system: a\nđáp") == "đáp" and one(X.json_object("t"), t='x {"a": {}} y') == '{"a": {}}'
    assert [one(X.block_type("t"), t=t) for t in ("Plain Text", "figure-caption", None, "discard", "TABLE")] == ["text", "figure_caption", "text", "abandon", "table"]
    assert one(X.content_lines("t"), t="12345\nngắn\nmột dòng đủ dài\nABC-123") == "một dòng đủ dài"


def test_geometry(spark):
    df = spark.createDataFrame([([0.0, 0.0, 10.0, 10.0], [5.0, 0.0, 15.0, 10.0])], "a array<double>, b array<double>")
    r = df.select(G.iou("a", "b").alias("i"), G.contains("a", "b", 0.5).alias("c"), G.clip(F.array(F.lit(-1.0), F.lit(2.5), F.lit(3.5), F.lit(99.0)), F.lit(10), F.lit(20)).alias("k"), G.polygon_box(F.expr("array(array(3.0, 1.0), array(0.0, 5.0))")).alias("p")).first()
    assert r.i == pytest.approx(1 / 3) and r.c and r.k == [0, 2, 4, 20] and r.p == [0, 1, 3, 5]


def test_layout(spark):
    assert L.clusters([[0, 0, 10, 10], [0, 0, 10, 9.5], [0, 0, 10, 9.1], [50, 0, 60, 10]], 0.9) == [0, 0, 0, 3] and L.clusters([]) == []
    rows = [(1, 0, "0", "Table", 1, 0.9, [0.0, 0.0, 100.0, 100.0]), (1, 0, "1", "plain text", 2, 0.8, [10.0, 10.0, 60.0, 60.0]), (1, 0, "2", "plain text", 3, 0.5, [200.0, 0.0, 300.0, 50.0]), (1, 0, "3", "Title", 4, 0.4, [200.0, 0.0, 300.0, 51.0]), (1, 0, "4", "abandon", 5, 0.9, [0.0, 500.0, 90.0, 590.0]), (1, 0, "5", "FIGURE", 0, 0.9, [400.0, 400.0, 999.0, 999.0]), (1, 0, "6", "x", 7, 0.9, [0.0, 0.0, 1.0, 1.0]), (1, 0, "7", None, 7, None, None)]
    blocks = spark.createDataFrame(rows, "rec_id long, page_pos int, block_path string, label string, block_index int, score double, bbox array<double>")
    pages = spark.createDataFrame([(1, 0, 500.0, 600.0)], "rec_id long, page_pos int, width double, height double")
    got = [(r.id, r.label, r.block_path, r.ocr, r.bbox[2]) for r in L.standardise(blocks, pages).orderBy("id").collect()]
    assert got == [(1, "FIGURE", "5", False, 500.0), (2, "TABLE", "0", True, 100.0), (3, "TITLE", "3", True, 300.0)]
    pairs = L.duplicate_pairs(blocks.where("bbox is not null"), ["rec_id", "page_pos"], "block_path", 0.9).collect()
    assert [(p.a, p.b) for p in pairs] == [("2", "3")]
    lines = L.reading_lines(spark.createDataFrame([(1, 1, [50.0, 5.0, 60.0, 9.0]), (1, 2, [0.0, 12.0, 9.0, 15.0]), (1, 3, [0.0, 40.0, 9.0, 45.0])], "page int, k long, bbox array<double>"), ["page"], "k").orderBy("line", "place").collect()
    assert [(r.k, r.line, r.place) for r in lines] == [(2, 0, 0), (1, 0, 1), (3, 1, 0)]


def test_graph(spark):
    rows = [("D1", "An", "reward", "khen An"), ("d1", "An", "reward", "khen An"), ("D2", "Bình", "decision", "a"), ("D2", "An", None, "b"), ("D3", None, "x", "y"), (None, "C", "x", "y")]
    found = H.mentions(spark.createDataFrame(rows, "document_id string, name string, event_type string, description string"))
    nodes, edges = H.semantic_nodes(found), H.semantic_edges(found)
    assert sorted(r.document_id for r in H.documents_of(edges, nodes, "An", "REWARD").collect()) == ["d1"]
    assert sorted(r.document_id for r in H.documents_of(edges, nodes, event_type="DECISION").collect()) == ["d2"]
    assert [(r.document_id, r.person_id) for r in H.single_links(found).collect()] == [("d1", "person_an")]
    with pytest.raises(ValueError):
        H.documents_of(edges, nodes)
    q = spark.createDataFrame([(1, "Lê Văn An có bị kỷ luật không?"), (2, "Lê Văn làm gì"), (3, "khen ai"), (4, "gì đó")], "k long, q string")
    names = spark.createDataFrame([("Lê Văn An",), ("Lê Văn",), ("Văn An",), (None,)], "name string")
    assert [(r.route, r.person, r.event_type) for r in H.routes(q, names, "k", "q").orderBy("k").collect()] == [("PERSON_EVENT", "Lê Văn An", "DISCIPLINARY_ACTION"), ("PERSON_ONLY", "Lê Văn", None), ("EVENT_ONLY", None, "REWARD"), ("VECTOR_ONLY", None, None)]


def test_retrieval(spark):
    rows = [("0", "p1", 0.9), ("1", "p1", 0.8), ("2", "p1", 0.7), ("3", "p1", 0.65), ("x", "p2", 0.6)]
    hits = spark.createDataFrame([(i, p, s, n + 1, "paragraph", None) for n, (i, p, s) in enumerate(rows)], "chunk_id string, parent_id string, score double, rank int, chunk_type string, table_parent_id string")
    assert [r.chunk_id for r in R.per_parent(hits, F.col("parent_id"), 2).orderBy("rank").collect()] == ["0", "1", "x"]
    parents = spark.createDataFrame([("p1",), ("t1",)], "chunk_id string")
    got = {r.chunk_id: r.context for r in R.expand(hits, parents, "adaptive").collect()}
    assert got["0"] == ["p1"] and got["x"] == []
    row = hits.where("chunk_id = '0'").withColumn("chunk_type", F.lit("table_row")).withColumn("table_parent_id", F.lit("t1"))
    assert R.expand(row, parents, "adaptive").first().context == ["t1"]
    with pytest.raises(ValueError):
        R.expand(hits, parents, "other")
    v = spark.createDataFrame([(i, float(i), [math.cos(i), math.sin(i)], "D%d" % i) for i in range(6)], "vec_id long, label double, embedding array<double>, document_id string")
    assert [r.vec_id for r in R.hybrid(v, [1.0, 0.0], 2, "vec_id", "document_id", spark.createDataFrame([("d3",), ("d4",)], "document_id string")).orderBy("rank").collect()] == [4, 3]
    assert R.hybrid(v, [1.0, 0.0], 2, "vec_id", "document_id", spark.createDataFrame([], "document_id string")).count() == 2
    kept = R.within_budget(spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbbbbbb"), (1, 3, "c"), (2, 1, "x" * 30)], "g int, o int, t string"), ["g"], ["o"], "t", 10).collect()
    assert [(r.g, r.o) for r in kept] == [(1, 1)]


def test_evaluation(spark):
    pairs = spark.createDataFrame([("a", "một hai", "một hay"), ("a", "x", "x"), ("b", None, "y")], "g string, truth string, read string")
    got = {r.g: r for r in E.recognition(pairs, ["g"]).collect()}
    assert got["a"].cer == pytest.approx(1 / 8) and got["a"].wer == pytest.approx(1 / 3, abs=1e-6) and got["a"].line_accuracy == 0.5 and got["b"].cer == 0
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1)], "query_id int, item string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "c"), (1, "q"), (3, "w")], "query_id int, item string")
    r = {x.query_id: x for x in E.ranking(hits, rel, 3).collect()}
    assert r[1].hit == 1 and r[1].recall == pytest.approx(2 / 3, abs=1e-6) and r[1].mrr == 0.5 and r[1].map == pytest.approx((1 / 2 + 2 / 3) / 3, abs=1e-6) and r[3].recall == 0
    b = E.boundaries(spark.createDataFrame([("d", 1), ("d", 2)], "d string, at int"), spark.createDataFrame([("d", 2), ("d", 3)], "d string, at int"), ["d", "at"]).first()
    assert (b.tp, b.fp, b.fn, b.f1) == (1, 1, 1, 0.5)


def test_metadata(spark):
    meta = spark.createDataFrame([("1", "f", "a.pdf", "1"), ("2", "f", "b.pdf", "2"), ("2", "f", "b.pdf", "2"), ("3", None, None, None), (" ", "q", "q.pdf", "1")], "id string, fileidminio string, filenameminio string, page string")
    assert sorted((r.alias, r.id) for r in M.alias_index(meta).collect()) == [("a", "1"), ("b", "2"), ("f", "1"), ("f", "2"), ("f_1", "1"), ("f_2", "2")]
    assert [r.alias for r in M.alias_conflicts(meta).collect()] == ["f"]
    with pytest.raises(Exception, match="one alias, two documents"):
        M.require_no_conflicts(meta).collect()
    r = spark.createDataFrame([("b/", "x.pdf"), ("b/x.pdf", "x.pdf"), (None, "x.pdf"), ("//a", None)], "p string, n string")
    assert [x.o for x in r.select(M.object_name(F.col("p"), F.col("n")).alias("o")).collect()] == ["b/x.pdf", "b/x.pdf", "x.pdf", "a"]


def test_outline(spark):
    texts = ["QUYẾT ĐỊNH", "CHƯƠNG I", "Điều 1. Một", "1. Khoản", "1.1. Nhỏ", "a) Điểm", "Điều 2 của Luật này", "Điều 2. Hai", "- gạch", "PHỤ LỤC 1"]
    spans = spark.createDataFrame([("d", i, t, "title" if i < 2 else "text", [0.3, 0.1, 0.7, 0.2], 1) for i, t in enumerate(texts)], "document_id string, at long, text string, block_type string, bbox array<double>, page int")
    rows = O.candidates(O.features(spans)).cache()
    kinds = {r.at: (r.kind, r.accepted) for r in rows.collect()}
    assert [kinds[i][0] for i in range(10)] == ["plain_paragraph", "chapter", "article", "primary_number", "decimal_number", "letter_point", "article", "article", "bullet", "annex"]
    assert not kinds[6][1] and kinds[7][1]
    up = {r.at: r.parent_at for r in O.outline(rows).collect()}
    assert up[1] is None and up[2] == 1 and up[7] == 1 and up[9] is None
    assert O.document_types(rows).first().doc_type == "DECISION"
    assert {r.zone for r in O.zones(rows).where("at >= 9").collect()} == {"ANNEX"}


def test_models(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "b a")], "k long, t string")
    got = {r.k: r.vector for r in models.embed(df, "k", "t", 16).collect()}
    assert got[1] == got[3] and sum(x * x for x in got[1]) == pytest.approx(1) and not any(got[2])
    made = models.generate(df.where("t is not null"), "k", "t", "echo", lambda: lambda texts: [t.upper() for t in texts]).collect()
    assert {r.k: r.answer for r in made} == {1: "A B", 3: "B A"}
    with pytest.raises(Exception, match="longer than the model takes"):
        models.generate(df, "k", "t", "echo", lambda: lambda texts: texts, most=1).collect()
    pages = models.page_images(spark.createDataFrame([("p", bytearray(b"ab"))], "path string, content binary"), lambda b: [bytes([x]) for x in b])
    assert models.recognise(pages, lambda b: [{"id": 1, "poly": None, "text": b.decode(), "score": 0.5}], "fake").count() == 2


def test_longest_name_of_long_texts_and_names(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(15))
    spark.createDataFrame([(1, "x " * 90 + "gửi Lê Nhã Tường, Hà Nội"), (2, f"a {long} b"), (3, "Lê, Nhã và w0 w1"), (4, None)], "block_key long, content_raw string").write.parquet(f"{tmp_path}/ocr_block.parquet")
    spark.createDataFrame([("Lê Nhã Tường",), ("Lê Nhã",), (f" {long}",), ("w0",), (" ",), (None,)], "name string").write.parquet(f"{tmp_path}/extract_entites.parquet")
    from docloom.plans import graphs

    assert {r.block_key: r.name for r in graphs.longest_match(spark, str(tmp_path)).collect()} == {1: "Lê Nhã Tường", 2: long, 3: "Lê Nhã"}
