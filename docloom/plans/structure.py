"""Structure queries over OCR blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import structure as S
from docloom.session import cut, table as t


def indexable_blocks(s: SparkSession, d: str) -> DataFrame:
    return S.indexable(S.blocks_of(t(s, d, "ocr_block"))).groupBy("block_type").agg(F.count(F.lit(1)).alias("n"))


def reading_order(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = S.blocks_of(t(s, d, "ocr_block"))
    return rows.select("key", F.row_number().over(Window.partitionBy("document_id").orderBy(*S.reading_order())).alias("at"))


def document_tree(s: SparkSession, d: str) -> DataFrame:
    return S.tree(S.indexable(S.blocks_of(t(s, d, "ocr_block")))).select("document_id", "ordinal", "node_id", "node_type", "title", "parent_ordinal", F.array_join("section_path", " > ").alias("section_path"), F.md5("text").alias("text_md5"), "page_start", "page_end")


def forward_fill(s: SparkSession, d: str) -> DataFrame:
    """The article each line stands in."""
    nodes = S.tree(S.indexable(S.blocks_of(t(s, d, "ocr_block"))))
    return nodes.where("node_type in ('clause', 'point', 'paragraph')").groupBy("document_id", F.array_join("section_path", " > ").alias("path")).agg(F.count(F.lit(1)).alias("n"))


def rolled_up(s: SparkSession, d: str) -> DataFrame:
    nodes = cut(S.tree(S.indexable(S.blocks_of(t(s, d, "ocr_block")))))
    return S.rolled_up(nodes).select("document_id", "ordinal", "first_page", "last_page", F.size("source_block_ids").alias("sources"))


def text_units(s: SparkSession, d: str) -> DataFrame:
    nodes = cut(S.tree(S.indexable(S.blocks_of(t(s, d, "ocr_block")))))
    return S.units(nodes).select("document_id", "ordinal", "unit_type", "primary", "parent_type", F.array_join("section_path", " > ").alias("section_path"))


def source_nodes(s: SparkSession, d: str) -> DataFrame:
    return S.deepest_node(S.tree(S.indexable(S.blocks_of(t(s, d, "ocr_block")))))


QUERIES = {"q_indexable_blocks": indexable_blocks, "q_reading_order": reading_order, "q_document_tree": document_tree, "q_forward_fill_tree": forward_fill, "q_rolled_up_pages": rolled_up, "q_text_units": text_units, "q_source_nodes": source_nodes}
_DISTINCT = "SELECT DISTINCT ON (block_key) * FROM ocr_block WHERE document_id IS NOT NULL"
_NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(content_raw, ''), chr(160), ' '), '\r\n|\r', chr(10), 'g'), '[ \t\f\x0B]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_KIND = "CASE WHEN {0} IN ('plain_text', 'plaintext', '') THEN 'text' WHEN {0} = 'heading' THEN 'title' WHEN {0} = 'discard' THEN 'abandon' WHEN {0} = 'tablefootnote' THEN 'table_footnote' WHEN {0} = 'figurecaption' THEN 'figure_caption' ELSE {0} END".format("regexp_replace(lower(trim(coalesce(block_type, ''))), '[- ]', '_', 'g')")
_E = r"(?:[^\\p{L}\\p{N}_]|$)".replace("\\\\", "\\")
_GOOD = rf"""CASE WHEN trim(t) = '' THEN false WHEN regexp_matches(t, '(?i)^\s*(?:trang\s*)?\d{{1,4}}\s*$') THEN false WHEN k = 'table_footnote' AND regexp_matches(t, '^\s*[A-ZÀ-Ỹ][\p{{L}}\p{{N}}_ .''-]{{0,28}}\s*\((?:ĐT|DT|đt|dt)\)\s*$') THEN false
    WHEN regexp_matches(t, '(?i)^(?:ký bởi|signed by|signature valid|digitally signed){_E}') THEN false WHEN k = 'figure' THEN false WHEN k = 'abandon' THEN regexp_matches(t, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:BỘ|TRƯỜNG|ỦY BAN|CỘNG HÒA|Số\s*:|QUYẾT ĐỊNH|Căn cứ|Điều\s+\d+){_E}') WHEN length(t) <= 2 AND NOT regexp_matches(t, '[\p{{L}}\p{{N}}_]') THEN false ELSE true END"""
_UPTO = "OVER (PARTITION BY d ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_ARTICLE = r"(?i)^\s*Điều\s+(\d+[A-Za-z]?)\s*[:.\-]?\s*"
_TREE = rf"""
WITH RECURSIVE b AS (SELECT lower(document_id) d, coalesce(page_number, 1) page, coalesce(block_index, 0) idx, {_KIND} k, bbox, {_NORM} t, block_key key FROM ({_DISTINCT})),
f AS (SELECT *, format('page_{{:03d}}_block_{{:04d}}', page, idx) bid, row_number() OVER (PARTITION BY d ORDER BY page, round(bbox[2], 4) NULLS LAST, bbox[1] NULLS LAST, idx, key) AS pos FROM b WHERE {_GOOD}),
g AS (SELECT *, CASE WHEN k = 'table' THEN [t] ELSE list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda x: x <> '') END segs FROM f),
l AS (SELECT d, page, k, bid, pos, unnest(segs) x, generate_subscripts(segs, 1) seg FROM g),
s0 AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY pos, seg) AS seq FROM l),
s1 AS (SELECT *, CASE WHEN regexp_matches(x, '{_ARTICLE}') THEN 'article' WHEN regexp_matches(x, '(?i)^\s*Nơi\s+nhận\s*[:.]?') THEN 'recipients'
    WHEN regexp_matches(x, '(?i)^\s*(?:KT\.?\s+|TL\.?\s+|TUQ\.?\s+)?(?:HIỆU TRƯỞNG|GIÁM ĐỐC|PHÓ\s+(?:HIỆU TRƯỞNG|GIÁM ĐỐC)|CHỦ TỊCH|THỦ TRƯỞNG|BỘ TRƯỞNG|NGƯỜI KÝ|ĐÃ KÝ){_E}') OR (k = 'figure_caption' AND len(regexp_split_to_array(trim(x), '\s+')) BETWEEN 2 AND 12 AND regexp_matches(x, '\p{{L}}')) THEN 'signature'
    WHEN regexp_matches(x, '(?i)^\s*QUY[ẾE]T\s+ĐỊNH{_E}') THEN 'decision_heading' END strong FROM s0),
s2 AS (SELECT *, coalesce(strong, CASE WHEN regexp_matches(x, '(?i)^\s*[-–—]?\s*(?:Căn\s+c[ứửưúủu](?:\s+vào)?|Theo\s+đề\s+nghị){_E}') AND coalesce(last_value(strong IGNORE NULLS) OVER (PARTITION BY d ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') <> 'article' THEN 'legal_basis' END) kd FROM s1),
s3 AS (SELECT *, coalesce(last_value(kd IGNORE NULLS) {_UPTO}, 'metadata') m FROM s2),
s4 AS (SELECT *, CASE WHEN kd IS NOT NULL THEN kd WHEN k = 'table' THEN 'table' WHEN m = 'recipients' THEN 'recipient_item' WHEN m = 'signature' THEN 'signature' WHEN m = 'article' AND regexp_matches(x, '^\s*(\d{{1,3}})[.)]\s+') THEN 'clause' WHEN m = 'article' AND regexp_matches(x, '(?i)^\s*([a-zđ])[.)]\s+') THEN 'point' ELSE 'paragraph' END n,
    sum(CASE WHEN kd IN ('article', 'recipients') THEN 1 ELSE 0 END) {_UPTO} region FROM s3),
s5 AS (SELECT *, n = 'signature' AND coalesce(sum((n = 'signature')::INT) OVER (PARTITION BY d, region ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 go, min(CASE WHEN kd = 'legal_basis' THEN seq END) OVER (PARTITION BY d) pre, min(CASE WHEN n = 'paragraph' AND m = 'metadata' THEN seq END) OVER (PARTITION BY d) met FROM s4),
s6 AS (SELECT *, 1 + sum((NOT go)::INT) {_UPTO} + coalesce((pre <= seq)::INT, 0) + coalesce((met <= seq)::INT, 0) o0 FROM s5),
s7 AS (SELECT *, CASE WHEN go THEN last_value(CASE WHEN n = 'signature' AND NOT go THEN o0 END IGNORE NULLS) {_UPTO} ELSE o0 END o FROM s6),
s8 AS (SELECT *, last_value(CASE WHEN n = 'decision_heading' THEN o END IGNORE NULLS) {_UPTO} dec, last_value(CASE WHEN n = 'recipients' THEN o END IGNORE NULLS) {_UPTO} rec, CASE WHEN m = 'article' THEN last_value(CASE WHEN n = 'article' THEN o END IGNORE NULLS) {_UPTO} END art,
    CASE WHEN m = 'article' THEN nullif(last_value(CASE WHEN n = 'clause' THEN o WHEN kd IN ('article', 'recipients', 'signature', 'decision_heading') THEN 0 END IGNORE NULLS) {_UPTO}, 0) END cla, CASE WHEN m = 'article' THEN nullif(last_value(CASE WHEN n = 'point' THEN o WHEN kd IN ('article', 'recipients', 'signature', 'decision_heading') OR n = 'clause' THEN 0 END IGNORE NULLS) {_UPTO}, 0) END poi,
    CASE n WHEN 'article' THEN 'Điều ' || regexp_extract(x, '{_ARTICLE}', 1) WHEN 'clause' THEN 'Khoản ' || regexp_extract(x, '^\s*(\d{{1,3}})[.)]\s+', 1) WHEN 'point' THEN 'Điểm ' || regexp_extract(x, '(?i)^\s*([a-zđ])[.)]\s+', 1) END lab,
    max(CASE WHEN seq = pre THEN o - 1 END) OVER (PARTITION BY d) pat, max(CASE WHEN seq = met THEN o - 1 END) OVER (PARTITION BY d) mat FROM s7),
s9 AS (SELECT *, last_value(CASE WHEN n = 'article' THEN lab END IGNORE NULLS) {_UPTO} al, last_value(CASE WHEN n = 'clause' THEN lab END IGNORE NULLS) {_UPTO} cl, last_value(CASE WHEN n = 'point' THEN lab END IGNORE NULLS) {_UPTO} pl, last_value(CASE WHEN n = 'article' THEN coalesce(dec, 0) END IGNORE NULLS) {_UPTO} ov FROM s8),
s10 AS (SELECT *, CASE WHEN n = 'article' THEN coalesce(dec, 1) WHEN n IN ('recipients', 'signature', 'decision_heading') THEN 1 WHEN n = 'legal_basis' THEN pat WHEN n = 'table' THEN coalesce(art, dec, CASE WHEN pre <= seq THEN pat END, CASE WHEN met <= seq THEN mat END, 1) WHEN n = 'recipient_item' THEN rec WHEN n = 'clause' THEN art WHEN n = 'point' THEN coalesce(cla, art)
    WHEN m = 'article' THEN coalesce(poi, cla, art) WHEN m = 'legal_basis' THEN pat WHEN m = 'decision_heading' THEN dec ELSE mat END par FROM s9),
s11 AS (SELECT *, concat_ws(' > ', CASE WHEN n = 'decision_heading' OR n = 'article' AND dec IS NOT NULL OR m = 'article' AND ov > 0 AND n <> 'article' OR par = dec AND n IN ('paragraph', 'table') THEN 'QUYẾT ĐỊNH' END, CASE WHEN n = 'legal_basis' OR par = pat THEN 'Phần căn cứ' END, CASE WHEN par = mat THEN 'Thông tin văn bản' END,
    CASE WHEN m = 'article' THEN al END, CASE WHEN n = 'clause' OR m = 'article' AND cla IS NOT NULL AND n IN ('point', 'paragraph') THEN cl END, CASE WHEN n = 'point' OR m = 'article' AND poi IS NOT NULL AND n = 'paragraph' THEN pl END, CASE WHEN n IN ('recipients', 'recipient_item') THEN 'Nơi nhận' END, CASE WHEN n = 'signature' THEN 'Chữ ký' END, CASE WHEN n = 'table' THEN 'Bảng' END) path FROM s10),
nodes AS (SELECT d, o, arg_min(n, seq) n, arg_min(coalesce(lab, CASE n WHEN 'decision_heading' THEN 'QUYẾT ĐỊNH' WHEN 'recipients' THEN 'Nơi nhận' WHEN 'signature' THEN 'Chữ ký' WHEN 'table' THEN 'Bảng' END), seq) title, string_agg(x, chr(10) ORDER BY seq) x, min(page) p0, max(page) p1, arg_min(bid, seq) bid, arg_min(par, seq) par, arg_min(path, seq) path FROM s11 GROUP BY d, o
    UNION ALL SELECT d, pat, 'preamble', 'Phần căn cứ', '', page, page, NULL, 1, 'Phần căn cứ' FROM s11 WHERE seq = pre UNION ALL SELECT d, mat, 'metadata', 'Thông tin văn bản', '', page, page, NULL, 1, 'Thông tin văn bản' FROM s11 WHERE seq = met),
h AS (SELECT *, sha1(from_hex(replace(d, '-', '')) || encode('v2:node:' || n || ':' || coalesce(bid, 'virtual-' || o::BIGINT) || ':' || o::BIGINT)) u FROM nodes)
"""
_TREE_ROWS = """SELECT d AS document_id, o::BIGINT AS ordinal, substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' || translate(substr(u, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(u, 18, 3) || '-' || substr(u, 21, 12) AS node_id, n AS node_type, title, par::BIGINT AS parent_ordinal, path AS section_path, md5(x) AS text_md5, p0 AS page_start, p1 AS page_end FROM h
"""
_UP = ", up AS (SELECT d, o, o AS a, 0 AS lv FROM h UNION ALL SELECT up.d, up.o, t.par, up.lv + 1 FROM up JOIN h t ON t.d = up.d AND t.o = up.a)"
SQL = {
    "q_document_tree": _TREE + _TREE_ROWS,
    "q_forward_fill_tree": _TREE + "SELECT d AS document_id, path, count(*) AS n FROM h WHERE n IN ('clause', 'point', 'paragraph') GROUP BY 1, 2",
    "q_rolled_up_pages": _TREE + _UP + ", w AS (SELECT DISTINCT d, o, bid FROM s11) SELECT up.d AS document_id, a::BIGINT AS ordinal, min(p0) AS first_page, max(p1) AS last_page, count(DISTINCT w.bid)::INT AS sources FROM up JOIN h ON h.d = up.d AND h.o = up.o LEFT JOIN w ON w.d = up.d AND w.o = up.o GROUP BY 1, 2",
    "q_text_units": _TREE + _UP + """, c AS (SELECT up.d, up.o, arg_min(a, lv) pr, arg_min(CASE WHEN a = 1 THEN 'document' ELSE t.n END, lv) pt FROM up LEFT JOIN h t ON t.d = up.d AND t.o = up.a WHERE a = 1 OR t.n IN ('article', 'preamble', 'recipients', 'signature', 'metadata', 'decision_heading') GROUP BY 1, 2)
        SELECT h.d AS document_id, h.o::BIGINT AS ordinal, CASE h.n WHEN 'article' THEN 'article_intro' WHEN 'recipients' THEN 'recipient_item' ELSE h.n END AS unit_type, pr::BIGINT AS primary, pt AS parent_type, path AS section_path FROM h JOIN c ON c.d = h.d AND c.o = h.o WHERE h.n NOT IN ('table', 'preamble', 'metadata') AND trim(x) <> ''""",
    "q_source_nodes": _TREE + ", an AS (SELECT d, o, [1, o::INT] AS li FROM h WHERE par = 1 UNION ALL SELECT k.d, k.o, list_append(an.li, k.o::INT) FROM h k JOIN an ON an.d = k.d AND an.o = k.par), w AS (SELECT DISTINCT d, o, bid FROM s11) SELECT document_id, block_id, ordinal FROM (SELECT w.d AS document_id, w.bid AS block_id, w.o::BIGINT AS ordinal, row_number() OVER (PARTITION BY w.d, w.bid ORDER BY li DESC) r FROM w JOIN an ON an.d = w.d AND an.o = w.o) WHERE r = 1",
    "q_indexable_blocks": rf"""SELECT k AS block_type, count(*) AS n FROM (SELECT {_KIND} k, {_NORM} t FROM ({_DISTINCT})) WHERE CASE WHEN trim(t) = '' THEN false WHEN regexp_matches(t, '(?i)^\s*(?:trang\s*)?\d{{1,4}}\s*$') THEN false
        WHEN k = 'table_footnote' AND regexp_matches(t, '^\s*[A-ZÀ-Ỹ][\p{{L}}\p{{N}}_ .''-]{{0,28}}\s*\((?:ĐT|DT|đt|dt)\)\s*$') THEN false WHEN regexp_matches(t, '(?i)^(?:ký bởi|signed by|signature valid|digitally signed)(?:[^\p{{L}}\p{{N}}_]|$)') THEN false WHEN k = 'figure' THEN false
        WHEN k = 'abandon' THEN regexp_matches(t, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:BỘ|TRƯỜNG|ỦY BAN|CỘNG HÒA|Số\s*:|QUYẾT ĐỊNH|Căn cứ|Điều\s+\d+)(?:[^\p{{L}}\p{{N}}_]|$)') WHEN length(t) <= 2 AND NOT regexp_matches(t, '[\p{{L}}\p{{N}}_]') THEN false ELSE true END GROUP BY 1""",
    "q_reading_order": f"SELECT block_key AS key, row_number() OVER (PARTITION BY lower(document_id) ORDER BY coalesce(page_number, 1), round(bbox[2], 4) NULLS LAST, bbox[1] NULLS LAST, coalesce(block_index, 0), block_key)::INT AS at FROM ({_DISTINCT})",
}
