import pytest
from pyspark.sql import functions as F

from docloom.operators import outline as O
from docloom.operators import prompts as Q
from docloom.operators import tables as T
from docloom.operators import universal as U


def spans(spark, texts):
    df = spark.createDataFrame([("d", "\n".join(texts)), ("n", None), ("e", ""), ("b", " \n ")], "id string, body string").withColumn("key", F.lit("x"))
    return O.candidates(U.lines_of(df, "id", "body"))


def test_levels_paths_and_reasons(spark):
    texts = ["a) chưa có cha", "CHƯƠNG I", "Điều 3. Thanh toán", "1. Đợt một", "3.1. Nhỏ", "3.1.2. Nhỏ hơn", "a) Điểm", "Theo Điều 2 của Luật này thì được", "1.000.000 đồng", "12.", "II. PHẦN KHÁC", "1. Bối cảnh", "1. Bối cảnh", "PHỤ LỤC 02"]
    rows = spans(spark, texts).cache()
    got = {r.at: r for r in rows.collect()}
    assert got[8].reason == "inline_reference" and got[10].reason == "page_number" and not got[9].accepted and got[8].kind == "plain_paragraph"
    levels = {r.at: r.level for r in O.leveled(rows).collect()}
    assert levels[1] is None and levels[2] == 0 and levels[3] == 2 and levels[4] == 3 and levels[5] == 3 and levels[6] == 4 and levels[7] == 4 and levels[11] == 1 and levels[12] == 2 and levels[14] == 0
    heads = {r.at: r for r in O.outline(rows).collect()}
    assert 1 not in heads and heads[4].parent_at == 3 and heads[6].parent_at == 5 and heads[12].parent_at == 11 and heads[14].parent_at is None
    assert heads[7].path == ["CHƯƠNG I", "Điều 3. Thanh toán", "3.1. Nhỏ", "a) Điểm"]
    assert O.violations(O.outline(rows)).count() == 0
    bad = spark.createDataFrame([("d", 1, 2, None, ["a"]), ("d", 2, 2, 1, ["a"]), ("d", 3, 4, None, []), ("d", 4, 3, 9, ["x"])], "document_id string, at long, level int, parent_at long, path array<string>")
    assert sorted((r.at, r.rule) for r in O.violations(bad).collect()) == [(2, "level order"), (3, "no path"), (3, "orphan"), (4, "no parent")]
    audit = {r.document_id: r for r in O.audit(rows).collect()}
    assert set(audit) == {"d"} and audit["d"].orphans == 1 and audit["d"].articles == 1 and audit["d"].annexs == 1 and audit["d"].rejected_inline_reference == 1
    assert O.outline(rows.limit(0)).count() == 0 and O.audit(rows.limit(0)).count() == 0
    again = spark.createDataFrame([(["A", "a", " ", None, "B", "A"],), (None,), ([],)], "p array<string>")
    assert [r.c for r in again.select(O.collapsed(F.col("p")).alias("c")).collect()] == [["A", "B", "A"], None, []]


def test_style_headings(spark):
    df = spark.createDataFrame([(1, "NỘI DUNG CHÍNH:", "title", [0.3, 0.2, 0.7, 0.3], True, 1.5), (2, "NỘI DUNG CHÍNH:", "text", None, False, None), (3, "một câu dài, có dấu chấm.", "title", [0.3, 0.2, 0.7, 0.3], True, 1.5)], "at long, text string, block_type string, bbox array<double>, is_bold boolean, font_ratio double").withColumn("document_id", F.lit("d"))
    got = {r.at: (r.style_score, r.style_heading) for r in O.style_headings(O.features(df)).collect()}
    assert got[1] == (1.0, True) and got[2] == (0.25, False) and not got[3][1]


def test_markers_and_profiles(spark):
    rows = U.markers(spans(spark, ["PHỤ LỤC 02", "Điều 3. a", "Khoản 1 b", "IV. C", "1.2 d", "2. e", "A. g", "đ) h", "Nơi nhận:", "GIÁM ĐỐC", "văn bản", "Phần thứ hai"]))
    got = {r.at: (r.marker_type, r.ordinal, r.canonical_level) for r in rows.collect()}
    assert got == {1: ("annex", "02", 0), 2: ("article", "3", 2), 3: ("clause", "1", 3), 4: ("roman", "iv", 1), 5: ("decimal", "1.2", 3), 6: ("number", "2", 2), 7: ("upper_alpha", "a", 1), 8: ("lower_alpha", "d", 3), 9: ("recipients", "", None), 10: ("signature", "", None), 12: ("part", "hai", 0)} | {12: got[12]}
    assert got[12][0] == "part"
    types = spark.createDataFrame([("d", "OFFICIAL_LETTER")], "document_id string, doc_type string")
    enabled = {r.marker_type: r.enabled for r in U.profiled(rows, types).collect()}
    assert enabled["number"] and not enabled["article"] and enabled["recipients"]
    assert {r.marker_type for r in U.profiled(rows, types.limit(0)).where("enabled").collect()} == {"annex", "recipients", "article", "part"}


def test_head_parties_annexes_addressees(spark):
    texts = ["CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "Số: 12/QĐ", "Căn cứ Luật Giáo dục;", "BÊN A: Công ty An", "Địa chỉ: số 1 phố X", "- Mã số thuế : 0123", "Bên B: Trường B", "Đại diện: Bà C", "Hai bên thống nhất ký", "Điện thoại: 09", "Điều 1. Chi tiết tại Phụ lục 02 kèm theo Điều 5", "Căn cứ kết quả trên, thực hiện", "PHỤ LỤC 02 - BẢNG GIÁ", "(Kèm theo Hợp đồng số 12)", "PHỤ LỤC I", "xem phụ lục III", "Kính gửi:", "- Bộ X;", "- Sở Y.", "hết", "- không phải"]
    rows = spans(spark, texts).cache()
    assert {(r.at, r.field) for r in U.header_fields(rows).collect()} == {(1, "motto"), (2, "number"), (3, "legal_basis")}
    assert {(r.at, r.party, r.field, r.value) for r in U.party_fields(rows).collect()} == {(4, "A", "party_name", "Công ty An"), (5, "A", "address", "số 1 phố X"), (6, "A", "tax_code", "0123"), (7, "B", "party_name", "Trường B"), (8, "B", "representative", "Bà C")}
    found = U.annexes(rows)
    assert {(r.at, r.ordinal, r.title, r.reference) for r in found.collect()} == {(13, "02", "BẢNG GIÁ", "(Kèm theo Hợp đồng số 12)"), (15, "I", "", None)}
    assert {(r.at, r.ordinal, r.article, r.annex_at) for r in U.annex_mentions(rows, found).collect()} == {(11, "02", "1", 13), (16, "III", None, None)}
    got = U.addressees(rows).collect()
    assert [(r.names, r.primary) for r in got] == [(["Bộ X", "Sở Y"], None)]
    for made in (U.header_fields, U.party_fields, U.annexes, U.addressees):
        assert made(rows.limit(0)).count() == 0


def test_table_types_and_header_paths(spark):
    html = "<table><thead><tr><th rowspan=2>Đợt thanh toán</th><th colspan=2>Giá trị</th></tr><tr><th>Tỷ lệ</th><th>Thời hạn</th></tr></thead><tr><td>1</td><td>40%</td><td>10 ngày</td></tr></table>"
    rows = [(1, html), (2, "<table><tr><th>STT</th><th>Tên</th></tr><tr><td>1</td><td>a</td></tr></table>"), (3, "không"), (4, None)]
    parsed = T.parse_tables(spark.createDataFrame(rows, "key long, html string"), "key", "html").cache()
    assert {r.key: r.table_type for r in U.table_types(parsed, "key").collect()} == {1: "PAYMENT_SCHEDULE", 2: "GENERIC"}
    assert {r.key: r.header_paths for r in parsed.collect()}[1] == [["Đợt thanh toán"], ["Giá trị", "Tỷ lệ"], ["Giá trị", "Thời hạn"]]
    assert [r.text for r in T.row_texts(parsed, "key").where("key = 1").collect()] == ["Đợt thanh toán: 1\nGiá trị > Tỷ lệ: 40%\nGiá trị > Thời hạn: 10 ngày"]


def test_typed_prefix_is_shortened(spark):
    df = spark.createDataFrame([("CONTRACT", "Mua sách", [f"Công ty {i}" for i in range(9)], ["Chương I", "Điều 1", "Khoản 2"]), ("PROPOSAL", None, ["A", "B"], None), (None, " ", None, [])], "k string, title string, names array<string>, path array<string>")
    made = lambda most: [r.p for r in df.select(U.typed_prefix(F.col("k"), F.col("title"), F.lit("1/HĐ"), F.lit("Sở"), F.col("names"), F.col("names"), F.lit(None).cast("string"), F.col("path"), most).alias("p")).collect()]
    assert made(500)[0].count("Công ty") == 9 and "Chương I > Điều 1 > Khoản 2" in made(500)[0]
    assert made(5)[0].count("Công ty") == 1 and "Phần: Điều 1 > Khoản 2" in made(5)[0]
    assert made(500)[1] == "Loại văn bản: Tờ trình\nSố: 1/HĐ\nKính gửi: A, B" and made(500)[2] == "Số: 1/HĐ\nCơ quan ban hành: Sở"


def test_gate_audit_search(spark):
    rows = spark.createDataFrame([("p", None, "parent", "article", "x", ["a"], ["s"]), ("c1", "p", "child", "table_row", "đủ chữ", ["a"], ["s"]), ("c2", "q", "child", None, "", None, []), ("c3", None, "child", "table_row", "từ " * 300, ["a"], ["s"])], "chunk_id string, parent_id string, record_type string, chunk_type string, raw_text string, section_path array<string>, source_block_ids array<string>")
    got = {(r.chunk_id, r.rule) for r in U.chunk_violations(rows.where("record_type = 'child'"), rows.where("record_type = 'parent'"), "raw_text").collect()}
    assert got == {("c2", "no parent"), ("c2", "no path"), ("c2", "empty"), ("c2", "no source"), ("c3", "no parent"), ("c3", "row without table"), ("c3", "too long")}
    hits = spark.createDataFrame([(1, f"h{i}", "p" if i < 4 else "q", 1 - i / 10, i + 1, i % 2) for i in range(6)], "query_id long, id string, parent string, score double, rank int, good int")
    assert [r.id for r in U.search(hits, F.col("parent"), 4, 2).orderBy("rank").collect()] == ["h0", "h1", "h4", "h5"]
    assert [r.id for r in U.search(hits, F.col("parent"), 2, 2, F.col("good").cast("double")).orderBy("rank").collect()] == ["h1", "h5"]
    near = {r.id: r.window for r in U.neighbours(hits, "parent", "id").collect()}
    assert near["h0"] == ["h1"] and near["h1"] == ["h0", "h2"]


def test_contexts_and_prompts(spark):
    rows = [("d", 1, " một  hai ", "u1"), ("d", 2, "Một hai", "u2"), ("d", 3, None, "u3"), ("e", 1, "x" * 50, None)]
    df = spark.createDataFrame([(a, b, c, a, None, "", None, b, u) for a, b, c, u in rows], "g string, o int, text string, document_id string, doc_no string, date string, summary string, chunk_index int, file_url string")
    made = lambda v, most=None: {r.g: r.context for r in Q.contexts(df, ["g"], ["o"], v, most).collect()}
    assert made("plain")["d"] == "một  hai\nMột hai\nFile_URL: u2" and made("chunks")["d"] == "[CHUNK 1]\nmột  hai\n\n[CHUNK 2]\nMột hai"
    assert made("evidence")["d"].count("[E") == 1 and "so_quyet_dinh: N/A" in made("evidence")["d"] and made("sources", 60).keys() == {"d"}
    with pytest.raises(ValueError):
        Q.contexts(df, ["g"], ["o"], "other")
    p = df.limit(1).select(Q.prompt("answer", F.lit("{question} a"), F.lit("hỏi {context}")).alias("p")).first().p
    assert "{question} a" in p and "hỏi {context}" in p
    assert df.limit(1).select(Q.embedding_text(F.lit("a"), F.lit(None), F.lit("b"), F.lit("c"), F.lit("d")).alias("t")).first().t == "Văn bản: a\nSố: \nCơ quan ban hành: b\nNgày: c\n\nNội dung:\nd"


def test_routes_of_versions_payloads_and_answers(spark):
    from docloom.operators import chunks as C
    from docloom.operators import retrieval as R

    children = spark.createDataFrame([("d1", "c1", 0, "clause", 1, 2, 9, ["A"], "chữ")], "document_id string, chunk_id string, chunk_index int, unit_type string, page_start int, page_end int, token_count int, section_path array<string>, text string")
    fallback = children.withColumn("chunk_id", F.lit("f")).unionByName(children.withColumn("document_id", F.lit("d2")).withColumn("chunk_id", F.lit("g"))).withColumn("source", F.lit("v1_fallback"))
    assert {(r.chunk_id, r.source) for r in C.by_version(children, children, fallback).collect()} == {("c1", "v2"), ("g", "v1_fallback")}
    assert [r.source for r in C.by_version(children, children, None).collect()] == ["v2"]
    meta = spark.createDataFrame([("D1", "1/QĐ", "An", "x", "2020")], "id string, doc_no string, author string, summary string, datedocument string")
    payload = C.payload(children, meta).first().payload
    assert payload["doc_no"] == "1/QĐ" and payload["chunk_index"] == "0" and payload["document_id"] == "d1"
    assert C.markdown(children).first().markdown == "## A\n\nchữ"
    hits = spark.createDataFrame([(1,)], "rank int")
    assert R.answerable(hits, F.lit("PERSON_ONLY")).first().answerable and not R.answerable(hits, F.lit("VECTOR_ONLY")).first().answerable and not R.answerable(hits.limit(0), F.lit("PERSON_ONLY")).first().answerable
