import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators import packing as P
from docloom.operators import splitters as X
from docloom.operators import tables as T


def test_grid_and_headers():
    html = "<p>a</p><table><thead><tr><th colspan=2>Nguồn</th><th rowspan='2'>Điểm</th></tr><tr><th>Mã</th><th>nguồn</th></tr></thead><tbody><tr><td>x</td><td rowspan=3>y<br>z</td><td></td></tr><tr><td>u</td><td>v</td></tr></tbody></table><table><tr><td>no</td></tr></table>"
    got = T.parse(html)
    assert got["headers"] == ["Nguồn > Mã", "Nguồn", "Điểm"] and got["rows"] == [["x", "y z", ""], ["u", "y z", "v"]] and got["column_count"] == 3
    assert T.parse("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>")["headers"] == ["A", "B"]
    data = T.parse("<table><thead><tr><td>INT 101</td><td>3</td><td>A+</td></tr></thead><tr><td>INT 102</td><td>2</td><td>8,5</td></tr></table>")
    assert data["data_like_header"] and data["headers"] == ["Cột 1", "Cột 2", "Cột 3"] and len(data["rows"]) == 2
    assert [T.parse(h)["error"] for h in (None, "", "text", "<table></table>", "<table><tr></tr></table>")] == ["no table", "no table", "no table", "no rows", "no cells"]
    assert T.parse("<table><tr><td colspan='x' rowspan=-2>a</table>")["rows"] == [["a"]]


def part(page, top, bottom, headers, data_like=False, parent="1", boundary=False, width=3):
    return {"document_id": "d", "key": page, "page": page, "top": top, "bottom": bottom, "parent": parent, "headers": headers, "column_count": width, "data_like_header": data_like, "boundary": boundary}


def test_continuation():
    names, none = ["A", "B", "C"], ["Cột 1", "Cột 2", "Cột 3"]
    three = [part(1, 0.5, 0.95, names), part(2, 0.04, 0.9, none, True), part(3, 0.05, 0.3, none, True)]
    assert [len(g) for g in T.join_pages(three)] == [3]
    assert len(T.join_pages([part(1, 0.5, 0.95, names), part(3, 0.04, 0.9, none, True)])) == 2
    assert len(T.join_pages([part(1, 0.5, 0.95, names), part(2, 0.04, 0.9, none, True, boundary=True)])) == 2
    assert len(T.join_pages([part(1, 0.5, 0.95, names), part(2, 0.04, 0.9, ["X", "Y", "Z"], parent="2", width=6)])) == 2
    assert T.continuation_score({**three[0], "last_page": 1}, three[1], False) == 1.25 + 1.25 + 1.5 + 1.5 + 1 + 0.75
    assert [len(g) for g in T.join_pages(three, T.V3_UNIVERSAL)] == [3]


def test_rows_as_text(spark):
    course = "<table><tr>" + "".join(f"<th>{h}</th>" for h in ("Mã môn", "Tên môn", "TC", "Điểm", "Mã môn chuyển", "Tên", "TC", "Điểm")) + "</tr><tr>" + "".join(f"<td>{c}</td>" for c in ("A1", "Toán", "3", "8", "", "", "", "")) + "</tr></table>"
    df = spark.createDataFrame([(1, "<table><tr><th>A</th><th>B</th></tr><tr><td>x</td><td></td></tr><tr><td></td><td></td></tr></table>"), (2, course), (3, None)], "k long, h string")
    parsed = T.parse_tables(df, "k", "h")
    got = {(r.k, r.row_index): r.text for r in T.row_texts(parsed, "k").collect()}
    assert got == {(1, 0): "A: x", (2, 0): "Môn học đã học:\n- Mã môn: A1\n- Tên môn: Toán\n- Số tín chỉ: 3\n- Điểm: 8"}
    assert parsed.where("error is not null").count() == 1


def unit(text, kind="paragraph", primary=1, path=("a",), table=None):
    return {"document_id": "d", "unit_id": text[:3], "unit_type": kind, "primary": primary, "path": path, "section_path": list(path), "table_key": table, "text": text, "context": "", "page_start": 1, "page_end": 1, "blocks": ["b"]}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.sampled_from([1, 2]), st.sampled_from(["paragraph", "table_row"])), max_size=25))
def test_packs_fit(spec):
    budget = P.Budget(most=40, margin=4, overlap=3)
    units = [unit(" ".join(f"w{i}x{j}" for j in range(n)), kind, primary, table=9 if kind == "table_row" else None) for i, (n, primary, kind) in enumerate(spec)]
    packs = P.pack(units, budget)
    for group in packs:
        assert P.count_tokens("\n\n".join(g["text"] for g in group)) + 2 <= 36
        assert len({(g["primary"], g["unit_type"], g["path"], g["table_key"]) for g in group}) == 1
        assert len(group) == 1 or group[0]["unit_type"] != "table_row"
    words = [w for g in packs for u in g for w in u["text"].split()]
    assert list(dict.fromkeys(words)) == [w for u in units for w in u["text"].split()]


def test_token_windows():
    made = P.pack([unit(" ".join(map(str, range(100))))], P.Budget(most=48, margin=4, overlap=3))
    assert all(g[0]["how"] == "token_window" and P.count_tokens(g[0]["text"]) + 2 <= 44 for g in made) and len(made) == 3
    assert made[1][0]["text"].split()[:3] == made[0][0]["text"].split()[-3:]
    with pytest.raises(ValueError):
        P.Budget(most=10, margin=16).room
    with pytest.raises(ValueError):
        P.windows("a b", 0, 0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["một", "hai.", "\n", "\n\n", "ba;", "bốn, "]), max_size=80).map(" ".join))
def test_recursive_keeps_words(text):
    made = X.recursively(text, 25)
    assert all(len(p) <= 25 for p in made)
    squeeze = lambda t: t.replace(" ", "").replace("\n", "").replace(".", "").replace(";", "").replace(",", "")
    assert squeeze("".join(made)) == squeeze(text)


def test_splitters(spark):
    df = spark.createDataFrame([(1, "đầu Điều 1: a Điều 2: b"), (2, "Điều 3: " + "x" * 150 + "\n\n" + "y" * 3000), (3, ""), (4, None), (5, "a b c d e f g")], "k long, t string")
    got = [(r.k, r.chunk_index, r.chunk_type, r.chunk[:6]) for r in X.articles_v1(df, "k", "t").orderBy("k", "chunk_index").collect()]
    assert got == [(1, 0, "header", "đầu"), (1, 1, "dieu", "Điều 1"), (1, 2, "dieu", "Điều 2"), (2, 0, "dieu", "yyyyyy"), (5, 0, "header", "a b c ")]
    assert [r.chunk for r in X.fixed(df.where("k = 5"), "k", "t", 4, 1).orderBy("chunk_index").collect()] == ["a b c d", "d e f g"]
    spans = X.spans(spark.createDataFrame([(1, "ab\n\ncd")], "k long, t string"), "k", "t").orderBy("span_index").collect()
    assert [(r.start_char, r.end_char, r.span) for r in spans] == [(0, 2, "ab"), (4, 6, "cd")]
    made = X.by_size("\n".join(["dòng văn bản thứ nhất của mục này"] * 80))
    assert len(made) > 2 and all(len(c) <= 1024 + 40 for c in made) and made[1].split()[:40] == made[0].split()[-40:]
    assert X.by_size("mở đầu\n\nĐiều 1. a\nMục 2: b\n") == ["mở đầu Điều 1. a Mục 2: b"]
    assert [c[:6] for c in X.by_size("Điều 1. " + "a" * 300 + "\nĐiều 2. " + "b" * 300)] == ["Điều 1", "Điều 2"]
    rows = spark.createDataFrame([(1, i, f"s{i}", [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(6)], "k long, o int, t string, v array<double>")
    assert [r.chunk for r in X.semantic(rows, "k", "o", "t", "v").orderBy("chunk_index").collect()] == ["s0 s1 s2", "s3 s4 s5"]
