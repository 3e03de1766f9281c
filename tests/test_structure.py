import random
import re

from docloom.operators import structure as S

PIECES = [
    ("text", "Điều {n}. Nội dung"), ("text", "{n}. Khoản này"), ("text", "{a}) Điểm này"), ("text", "Căn cứ Luật"), ("text", "Nơi nhận:"), ("text", "- Như Điều 3;"), ("title", "QUYẾT ĐỊNH"), ("text", "HIỆU TRƯỞNG"), ("figure_caption", "Nguyễn Văn An"),
    ("text", "đoạn văn ở điều 1 thường"), ("table", "<table><tr><td>x</td></tr></table>"), ("text", "đoạn văn hai\nĐiều {n}: nữa\nvà thêm"),
]


def by_steps(blocks):
    """The same tree built line by line."""
    nodes, state = [], dict(mode="metadata", article=None, clause=None, point=None, decision=None, pre=None, meta=None, rec=None, sign=None)

    def add(kind, title, text, parent, path, block):
        nodes.append(dict(ordinal=len(nodes) + 2, kind=kind, title=title, text=text, parent=parent, path=path, blocks=[block] if block else []))
        return nodes[-1]

    def up(node):
        return node["ordinal"] if node else 1

    for block, kind, content in blocks:
        for text in [content] if kind == "table" else [x.strip() for x in content.split("\n") if x.strip()]:
            s = state
            m = re.match(r"(?i)^\s*Điều\s+(\d+[A-Za-z]?)", text)
            caption = kind == "figure_caption" and 2 <= len(text.split()) <= 12
            if m:
                label = f"Điều {m.group(1)}"
                s["article"] = add("article", label, text, up(s["decision"]), (["QUYẾT ĐỊNH"] if s["decision"] else []) + [label], block)
                s.update(clause=None, point=None, rec=None, sign=None, mode="article")
            elif text.startswith("Nơi nhận"):
                s["rec"] = add("recipients", "Nơi nhận", text, 1, ["Nơi nhận"], block)
                s.update(article=None, clause=None, point=None, sign=None, mode="recipients")
            elif text.startswith("HIỆU TRƯỞNG") or caption or s["mode"] == "signature" and kind != "table" and not re.match("QUYẾT ĐỊNH|Căn cứ", text):
                if s["sign"] is None:
                    s["sign"] = add("signature", "Chữ ký", text, 1, ["Chữ ký"], block)
                else:
                    s["sign"]["text"] += "\n" + text
                    s["sign"]["blocks"] += [block] if block not in s["sign"]["blocks"] else []
                s.update(article=None, clause=None, point=None, mode="signature")
            elif text.startswith("QUYẾT ĐỊNH"):
                s["decision"] = add("decision_heading", "QUYẾT ĐỊNH", text, 1, ["QUYẾT ĐỊNH"], block)
                s.update(article=None, clause=None, point=None, mode="decision")
            elif text.startswith("Căn cứ") and s["article"] is None:
                s["pre"] = s["pre"] or add("preamble", "Phần căn cứ", "", 1, ["Phần căn cứ"], None)
                add("legal_basis", None, text, up(s["pre"]), ["Phần căn cứ"], block)
                s["mode"] = "preamble"
            elif kind == "table":
                parent = s["article"] or s["decision"] or s["pre"] or s["meta"]
                add("table", "Bảng", text, up(parent), (parent["path"] if parent else []) + ["Bảng"], block)
            elif s["mode"] == "recipients":
                add("recipient_item", None, text, up(s["rec"]), ["Nơi nhận"], block)
            elif s["article"]:
                c, p = re.match(r"^(\d{1,3})[.)]\s+", text), re.match(r"(?i)^([a-zđ])[.)]\s+", text)
                if c:
                    s["clause"] = add("clause", f"Khoản {c.group(1)}", text, up(s["article"]), s["article"]["path"] + [f"Khoản {c.group(1)}"], block)
                    s["point"] = None
                elif p:
                    over = s["clause"] or s["article"]
                    s["point"] = add("point", f"Điểm {p.group(1)}", text, up(over), over["path"] + [f"Điểm {p.group(1)}"], block)
                else:
                    over = s["point"] or s["clause"] or s["article"]
                    add("paragraph", None, text, up(over), over["path"], block)
            elif s["mode"] in ("preamble", "decision"):
                over = s["pre"] if s["mode"] == "preamble" else s["decision"]
                add("paragraph", None, text, up(over), over["path"], block)
            else:
                s["meta"] = s["meta"] or add("metadata", "Thông tin văn bản", "", 1, ["Thông tin văn bản"], None)
                add("paragraph", None, text, up(s["meta"]), ["Thông tin văn bản"], block)
    return nodes


def test_windows_agree_with_steps(spark):
    r = random.Random(3)
    rows, wanted = [], {}
    for doc in range(120):
        blocks = []
        for i in range(r.randint(1, 14)):
            kind, text = r.choice(PIECES)
            text = text.format(n=r.randint(1, 9), a=r.choice("abc"))
            rows.append((doc * 100 + i, f"D{doc}", 1 + i // 6, i, kind, [0.1, 0.01 * i, 0.9, 0.01 * i + 0.01], text))
            blocks.append((f"page_{1 + i // 6:03d}_block_{i:04d}", kind, text))
        wanted[f"d{doc}"] = by_steps(blocks)
    df = spark.createDataFrame(rows, "block_key long, document_id string, page_number int, block_index int, block_type string, bbox array<double>, content_raw string")
    got = {}
    for x in S.tree(S.blocks_of(df)).collect():
        got.setdefault(x.document_id, {})[x.ordinal] = (x.node_type, x.title, x.text, x.parent_ordinal, list(x.section_path), list(x.blocks))
    for doc, nodes in wanted.items():
        assert got[doc] == {n["ordinal"]: (n["kind"], n["title"], n["text"], n["parent"], n["path"], n["blocks"]) for n in nodes}, doc
    tree = S.tree(S.blocks_of(df))
    assert S.tree(S.blocks_of(df.limit(0))).count() == 0
    ids = [x.node_id for x in tree.select("node_id").collect()]
    assert len(ids) == len(set(ids))


def test_indexable(spark):
    rows = [("abandon", "BỘ GIÁO DỤC"), ("abandon", "rác"), ("text", "trang 3"), ("text", "--"), ("figure", "x y"), ("table_footnote", "Nguyễn An (ĐT)"), ("text", "ký bởi A"), ("text", "nội dung"), ("text", "")]
    df = spark.createDataFrame(rows, "block_type string, norm string")
    assert sorted(x.norm for x in S.indexable(df).collect()) == ["BỘ GIÁO DỤC", "nội dung"]
