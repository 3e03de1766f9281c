import random

from docloom.llm import misread as M
from docloom.llm import pages as P


def lexicon():
    text = "Nhằm bảo đảm tiến độ phòng đào tạo tiếp tục rà soát hồ sơ của sinh viên theo quyết định của cuộc họp và gửi về bộ phận văn thư".lower().split() * 60
    pairs, counts = {}, {}
    for a, b in zip(text, text[1:]):
        pairs[a, b] = pairs.get((a, b), 0) + 1
    for a in text:
        counts[a] = counts.get(a, 0) + 1
    return M.Lexicon(len(text), counts, pairs)


def test_misread_words():
    x = lexicon()
    for raw, meant in [("sirih", "sinh"), ("v1ên", "viên"), ("h?", None), ("ti?p", "tiếp"), ("pliòng", "phòng"), ("qiiyết", "quyết"), ("đả|m", "đảm"), ("KTE113", None), ("hồ", None), ("cuộc", None)]:
        kind, found = x.verdict(raw)
        assert (found[0] if kind == "sure" else None) == meant, raw
    kind, found = x.verdict("cuôc")
    assert kind and x.fits("của", "cuôc", "họp", kind, found, False) == "cuộc"


def test_pages_and_paragraphs(spark):
    rows, key = [], 0
    for page in (1, 2, 3):
        parts = [(0.035, "Thư viện / Hộp 3" if page < 3 else "Thu viện / Hộp 3 | 3"), (0.2, "Nhằm bảo đảm tiến độ phòng đào tạo tiếp tục rà soát hồ s-\nơ của sinh viên theo quyêt định của cuộc họp."), (0.6, "2/11"), (0.975, f"- {page} -")]
        if page == 1:
            parts.insert(1, (0.055, "SỞ GIÁO DỤC\nCỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM"))
        for i, (top, text) in enumerate(parts):
            key += 1
            rows.append((key, "Doc" if i else "dOC", page, i, [0.1, top, 0.9, top + 0.02], text, "x"))
    rows += [(90, None, None, None, None, "một mình", "x"), (91, "doc", 2, 9, None, None, "x"), (92, "doc", 2, 8, [], "", "x"), rows[0]]
    df = spark.createDataFrame(rows, "block_key long, document_id string, page_number int, block_index int, bbox array<double>, content_raw string, src_table string")
    blocks = P.block_rows(df)
    got = {(r.row_key, r.line_pos, r.noise_kind) for r in P.find(blocks, lexicon()).collect()}
    text = {r[0]: r[5] for r in rows}
    wanted = {(k, 0, "running") for k, t in text.items() if t and "viện" in t} | {(k, 0, "pageno") for k, t in text.items() if t and t.startswith("- ")} | {(k, 0, "hyphen") for k, t in text.items() if t and "s-\n" in t} | {(k, 1, "glyph") for k, t in text.items() if t and "quyêt" in t}
    assert got == wanted
    made = [r.paragraph for r in P.repair(blocks, lexicon()).where("document_id = 'DOC' and page_number = 2").orderBy("para_index").collect()]
    assert made == ["Nhằm bảo đảm tiến độ phòng đào tạo tiếp tục rà soát hồ sơ của sinh viên theo quyết định của cuộc họp.", "2/11"]
    assert P.find(blocks.limit(0)).count() == 0 and P.repair(blocks.limit(0)).count() == 0


def test_line_rows(spark):
    df = spark.createDataFrame([(1, "D", 1, 0, [[1.0, 2.0], [3.0, 2.0], [3.0, 9.0], [1.0, 9.0]], "a"), (2, "d", 1, 1, None, "b"), (3, "d", None, None, None, None)], "line_key long, document_id string, page_number int, line_id int, poly array<array<double>>, text string")
    assert [(r.row_key, r.doc, r.top) for r in P.line_rows(df).orderBy("row_key").collect()] == [(1, "D", 2 / 3508), (2, "D", None)]


def test_heads_come_back_over_the_parts_of_a_document(spark):
    rows, key = [], 0
    for page in range(1, 131):
        parts = [(0.2, f"Nhằm bảo đảm tiến độ phòng đào tạo tiếp tục rà soát hồ sơ {'abcdefghij'[page % 10] * (page // 10 + 3)}."), (0.975, f"Trang {page}/130")]
        if page in (1, 64, 129):
            parts.insert(0, (0.035, "Thư viện / Hộp tài liệu" if page < 129 else "Thư viộn / Hộp tài liệu"))
        for i, (top, text) in enumerate(parts):
            key += 1
            rows.append((key, "Doc", page, i if i + 1 < len(parts) else 1500, [0.1, top, 0.9, top + 0.02], text))
    df = spark.createDataFrame(rows, "block_key long, document_id string, page_number int, block_index int, bbox array<double>, content_raw string")
    got = {(r.row_key, r.noise_kind) for r in P.find(P.block_rows(df), lexicon()).collect()}
    assert {k for k, kind in got if kind == "running"} == {r[0] for r in rows if "Hộp" in r[5]}
    assert {k for k, kind in got if kind == "pageno"} == {r[0] for r in rows if r[5].startswith("Trang")}


def test_cells_of_head_keys_change_nothing(spark):
    r = random.Random(3)
    made = [("".join(r.choice("ab1?") for _ in range(r.randint(4, 40))), page) for page in range(1, 40) for _ in range(3)]
    made += [(k[:2] + "c" + k[3:], page + 1) for k, page in made[::2]] + [(k[1:], page + 2) for k, page in made[::3]] + [(k + "b", page) for k, page in made[::5]]
    heads = spark.createDataFrame([("t", "D", 0, 0, page, k) for k, page in made], "src_table string, doc string, pages long, indexes long, page int, key string")
    rows = [{x.key for x in P.recurring(heads, together).collect()} for together in (10_000, 1)]
    assert rows[0] == rows[1] and rows[0]


def test_a_page_through_a_window_is_the_page_whole(monkeypatch):
    import pyarrow as pa

    r, known, made = random.Random(9), lexicon(), P.model()
    words = "Nhằm bảo đảm tiến độ phòng đào tạo tiếp tục rà soát hồ sơ của sinh viên".split()
    rows = []
    for page, size in ((1, 40), (2, 5000), (3, 60)):
        for i in range(size):
            text = " ".join(r.choice(words) for _ in range(6)) + r.choice([".", "", "", " s-"])
            text = "Thư viện / Hộp 3" if not i else f"- {page} -" if i == size - 1 else text.replace("viên", "v1ên") if r.random() < 0.1 else text
            rows.append(("page_vietocr_results", "D", page, i, page * 10_000 + i, text, 0.03 if not i else 0.97 if i == size - 1 else 0.1 + 0.8 * i / size, False, 0))
    told = [("page_vietocr_results", "D", 3, 0, None, "", None, True, 0), ("page_vietocr_results", "D", 0, 0, None, P.head_keys("Thư viện / Hộp 3", 1)[0], None, True, 0)]
    names = "src_table doc page idx row_key text top told pages".split()

    def run(flush):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in (told + rows)[i : i + 500]], pa.schema([("src_table", pa.string()), ("doc", pa.string()), ("page", pa.int32()), ("idx", pa.int32()), ("row_key", pa.int64()), ("text", pa.string()), ("top", pa.float64()), ("told", pa.bool_()), ("pages", pa.int64())])) for i in range(0, len(rows) + 2, 500)]
        out, texts, parts = [], [], 0
        for _, lines in P._documents(iter(batches), lambda part: P.label(part, known, made), flush):
            out += [(x.key, x.label, tuple(x.kinds), x.fixed) for x in lines]
            texts += P.paragraphs(lines)
            parts += 1
        return out, texts, parts

    whole, paged, windows = run(10**9), run(50), run(800)
    assert whole[2] == 1 and paged[2] > 3 and windows[2] > 3
    assert whole[0] == windows[0] == paged[0] and whole[1] == windows[1]
    assert {x[0] for x in whole[0] if "running" in x[2]} == {10_000, 20_000, 30_000} and {x[0] for x in whole[0] if "pageno" in x[2]} == {10_039, 24_999, 30_059}
