"""Table, packing and chunk queries over OCR blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunks as C
from docloom.operators import packing as P
from docloom.operators import structure as S
from docloom.operators import tables as T
from docloom.plans.structure import _E, _TREE, _UP
from docloom.session import cut, table as t


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return S.indexable(S.blocks_of(t(s, d, "ocr_block")))


def _tables(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "ocr_block", "block_key", "content_raw").distinct().where("content_raw like '%<table%'")
    return T.parse_tables(rows, "block_key", "content_raw")


def html_tables(s: SparkSession, d: str) -> DataFrame:
    return _tables(s, d).select("block_key", "error", "column_count", F.size("rows").alias("n_rows"), F.array_join("headers", " | ").alias("headers"), "schema_type")


def table_cells(s: SparkSession, d: str) -> DataFrame:
    """Every cell of every table, checked against a text split of these simple tables."""
    rows = _tables(s, d).select("block_key", F.posexplode("rows").alias("row_index", "cells"))
    return rows.select("block_key", "row_index", F.array_join("cells", "|").alias("cells"))


def table_row_texts(s: SparkSession, d: str) -> DataFrame:
    return T.row_texts(_tables(s, d), "block_key").select("block_key", "row_index", "text")


def unreadable_tables(s: SparkSession, d: str) -> DataFrame:
    blocks = S.blocks_of(t(s, d, "ocr_block")).where("block_type = 'table'")
    return T.parse_tables(blocks, "key", "raw").where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def logical_tables(s: SparkSession, d: str) -> DataFrame:
    blocks = _blocks(s, d)
    parsed = cut(T.parse_tables(blocks.where("block_type = 'table'"), "key", "raw"))
    return T.logical_tables(T.continuation_inputs(blocks, parsed))


def _logical(s: SparkSession, d: str, weights: T.Weights) -> DataFrame:
    blocks = _blocks(s, d)
    parsed = cut(T.parse_tables(blocks.where("block_type = 'table'"), "key", "raw"))
    return T.logical_tables(T.continuation_inputs(blocks, parsed), weights)


def logical_tables_v3(s: SparkSession, d: str) -> DataFrame:
    return _logical(s, d, T.V3_UNIVERSAL)


def logical_tables_blocking(s: SparkSession, d: str) -> DataFrame:
    return _logical(s, d, T.V3_BLOCKING)


def child_chunks(s: SparkSession, d: str) -> DataFrame:
    _, children = C.build(t(s, d, "ocr_block"), t(s, d, "doc_meta"))
    return children.select("document_id", "chunk_index", "chunk_id", "parent_id", "unit_type", "token_count", "page_start", "page_end", F.array_join("section_path", " > ").alias("section_path"))


def parent_chunks(s: SparkSession, d: str) -> DataFrame:
    parents, _ = C.build(t(s, d, "ocr_block"), t(s, d, "doc_meta"))
    return parents.select("document_id", "chunk_id", "chunk_type", "page_start", "page_end", F.size("child_ids").alias("children"))


def chunk_violations(s: SparkSession, d: str) -> DataFrame:
    parents, children = C.build(t(s, d, "ocr_block"), t(s, d, "doc_meta"))
    children = cut(children)
    return P.violations(children, parents).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def document_runs(s: SparkSession, d: str) -> DataFrame:
    parents, children = C.build(t(s, d, "ocr_block"), t(s, d, "doc_meta"))
    children = cut(children)
    return C.run_summary(children, parents, P.violations(children, parents))


def fallback_chunks(s: SparkSession, d: str) -> DataFrame:
    made = C.fallback_chunks(t(s, d, "documents", "doc_id", "text"), t(s, d, "doc_meta"), "doc_id", "text")
    return made.select("document_id", "chunk_index", "chunk_id", "unit_type", F.length("text").alias("n"))


def context_prefixes(s: SparkSession, d: str) -> DataFrame:
    m = t(s, d, "doc_meta", "id", "summary", "doc_no", "author", "datedocument").distinct()
    return m.select("id", P.context_lines(F.col("summary"), F.col("doc_no"), F.col("author"), F.col("datedocument"), F.array(F.lit("Điều 1"), F.lit(" "))).alias("context"))


def stored_violations(s: SparkSession, d: str) -> DataFrame:
    """The rules that rows of the chunk table break, by the same gate."""
    rows = t(s, d, "chunk").dropDuplicates(["chunk_key"]).select("chunk_id", "parent_id", F.col("chunk_type").alias("unit_type"), "section_path", F.lit(1).alias("table_key"), "raw_text", "token_count", "record_type")
    return P.violations(rows.where("record_type = 'child'"), rows.where("record_type = 'parent'"), "raw_text").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "q_html_tables": html_tables, "q_table_cells": table_cells, "q_table_row_texts": table_row_texts, "q_unreadable_tables": unreadable_tables, "q_logical_tables": logical_tables, "q_logical_tables_v3": logical_tables_v3, "q_logical_tables_blocking": logical_tables_blocking, "q_child_chunks": child_chunks, "q_parent_chunks": parent_chunks, "q_chunk_violations": chunk_violations,
    "q_document_runs": document_runs, "q_fallback_chunks": fallback_chunks, "q_context_prefixes": context_prefixes, "q_stored_violations": stored_violations,
}
_B = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}"
_TABLES = "SELECT DISTINCT block_key, content_raw FROM ocr_block WHERE content_raw LIKE '%<table%'"
_CELL = rf"regexp_replace(regexp_replace(c, '[{_B}]+', ' ', 'g'), '^ | $', '', 'g')"
_COUNT = rf"len(regexp_extract_all(@, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_B}]'))"
_OF = lambda text: _COUNT.replace("@", text)
_STARTS = rf"(regexp_matches(t, '(?i)^\s*(?:Điều\s+\d+|Nơi\s+nhận)') OR k = 'title' AND regexp_matches(t, '(?i)^\s*(?:QUY[ẾE]T\s+ĐỊNH|CHƯƠNG|PHẦN|MỤC|DANH\s+SÁCH){_E}'))"


def _fold(w: T.Weights, parent: str = "''") -> str:
    """The fold over a document's tables as a recursion; it needs f (indexable blocks) and gives fold (d, key, table_key, part, page)."""
    shared, every = "len(list_intersect(r.ws, t.ws))", "len(list_distinct(list_concat(r.ws, t.ws)))"
    like = f"CASE WHEN len(r.ws) > 0 AND len(t.ws) > 0 THEN {shared} / {every} ELSE 0 END"
    score = f"""CASE WHEN t.page <> r.page + 1 THEN {w.not_adjacent} ELSE CASE WHEN r.bottom > 0.80 THEN {w.bottom} ELSE 0 END + CASE WHEN t.top < 0.20 THEN {w.top} ELSE 0 END + CASE abs(r.cc - t.cc) WHEN 0 THEN {w.same_width} WHEN 1 THEN {w.near_width} ELSE {w.other_width} END
        + CASE WHEN r.parent IS NOT DISTINCT FROM t.parent THEN {w.same_parent} ELSE {w.other_parent} END + CASE WHEN t.bound THEN {w.boundary} ELSE {w.no_boundary} END + CASE WHEN {like} >= 0.6 THEN {w.like_header} WHEN {like} < 0.2 THEN {w.other_header} ELSE 0 END END >= {w.threshold}"""
    return rf""", tb0 AS (SELECT f.*, {parent} parent, list_transform(regexp_extract_all(content_raw, '<th>(.*?)</th>', 1, 's'), lambda c: {_CELL}) heads FROM f JOIN (SELECT DISTINCT ON (block_key) block_key, content_raw FROM ocr_block) o ON o.block_key = f.key WHERE k = 'table' AND content_raw LIKE '%<table%' AND content_raw LIKE '%<tr%'),
    fb AS (SELECT d, page, min(idx) fi FROM f WHERE {_STARTS} GROUP BY 1, 2), tb AS (SELECT tb0.d, tb0.page, key, len(heads) cc, bbox[2] top, bbox[4] bottom, parent, coalesce(fi < idx, false) bound, list_distinct(regexp_extract_all(lower(array_to_string(heads, ' ')), '[\p{{L}}\p{{N}}_]+')) ws, row_number() OVER (PARTITION BY tb0.d ORDER BY tb0.page, idx, key) n FROM tb0 LEFT JOIN fb ON fb.d = tb0.d AND fb.page = tb0.page),
    fold AS (SELECT d, n, key, key AS table_key, 0 AS part, page, bottom, cc, ws, parent FROM tb WHERE n = 1 UNION ALL SELECT t.d, t.n, t.key, CASE WHEN {score} THEN r.table_key ELSE t.key END, CASE WHEN {score} THEN r.part + 1 ELSE 0 END, t.page, CASE WHEN {score} THEN r.bottom ELSE t.bottom END, CASE WHEN {score} THEN r.cc ELSE t.cc END, CASE WHEN {score} THEN r.ws ELSE t.ws END, CASE WHEN {score} THEN r.parent ELSE t.parent END FROM fold r JOIN tb t ON t.d = r.d AND t.n = r.n + 1)"""


_INDEXABLE = _TREE[: _TREE.index("\ng AS")].rstrip().rstrip(",")
_TABLES_OF = " SELECT d AS document_id, key, table_key, part::INT AS part, page::INT AS page FROM fold"
_UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-5' || substr({0}, 14, 3) || '-' || translate(substr({0}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({0}, 18, 3) || '-' || substr({0}, 21, 12)"
_ID = lambda d, name: _UUID.format(f"sha1(from_hex(replace({d}, '-', '')) || encode({name}))")
_LINE = lambda label, c: f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN '{label}: ' || trim({c}) END"
# DuckDB: the units of all documents, packed one after the other; a unit that is longer than its room would give null counts, and none is here
_PACKS = _TREE + _fold(T.Weights(), "(SELECT min(par)::VARCHAR FROM h WHERE h.n = 'table' AND h.d = f.d AND h.bid = f.bid)") + _UP + rf""", sq AS (SELECT d, o, min(seq) seq, list_distinct(list(bid ORDER BY seq)) bs0, list(bid ORDER BY seq) ba FROM s11 GROUP BY 1, 2), sb AS (SELECT d, o, seq, list_filter(ba, lambda x, i: list_position(ba, x) = i) bs FROM sq),
pc AS (SELECT up.d, up.o, arg_min(a, lv) pr FROM up LEFT JOIN h t ON t.d = up.d AND t.o = up.a WHERE a = 1 OR t.n IN ('article', 'preamble', 'recipients', 'signature', 'metadata', 'decision_heading') GROUP BY 1, 2),
u0 AS (SELECT h.d, sb.seq::DOUBLE a, 0 b, 'unit:' || h.d || ':' || h.o::BIGINT uid, CASE h.n WHEN 'article' THEN 'article_intro' WHEN 'recipients' THEN 'recipient_item' ELSE h.n END ut, pr::BIGINT pr, h.path path, NULL::BIGINT tk, h.x x, p0, p1, bs FROM h JOIN sb ON sb.d = h.d AND sb.o = h.o JOIN pc ON pc.d = h.d AND pc.o = h.o WHERE h.n NOT IN ('table', 'preamble', 'metadata') AND trim(h.x) <> ''),
rw AS (SELECT block_key, list_transform(regexp_extract_all(content_raw, '<th>(.*?)</th>', 1, 's'), lambda c: {_CELL}) heads, list_filter(regexp_extract_all(content_raw, '<tr>(.*?)</tr>', 1, 's'), lambda x: NOT contains(x, '<th')) rws FROM (SELECT DISTINCT ON (block_key) block_key, content_raw FROM ocr_block) WHERE content_raw LIKE '%<table%'),
rc AS (SELECT block_key, heads, (generate_subscripts(rws, 1) - 1) ri, list_transform(regexp_extract_all(unnest(rws), '<td>(.*?)</td>', 1, 's'), lambda c: {_CELL}) cells FROM rw),
rt AS (SELECT block_key, ri, array_to_string(list_filter(list_transform(range(1, len(cells) + 1), lambda j: CASE WHEN cells[j] <> '' THEN heads[j] || ': ' || cells[j] END), lambda x: x IS NOT NULL), chr(10)) x FROM rc),
tn AS (SELECT h.d, h.bid, h.par::BIGINT pr, h.path, sb.seq FROM h JOIN sb ON sb.d = h.d AND sb.o = h.o WHERE h.n = 'table'), tr AS (SELECT f.d, f.bid, f.page, fold.table_key, fold.part, tn.pr, tn.path, tn.seq, rt.* FROM rt JOIN f ON f.key = rt.block_key JOIN fold ON fold.key = f.key JOIN tn ON tn.d = f.d AND tn.bid = f.bid WHERE rt.x <> ''),
t1 AS (SELECT DISTINCT table_key, pr, path FROM tr WHERE part = 0), u1 AS (SELECT tr.d, tr.seq::DOUBLE a, ri + 1 b, 'row:' || block_key || ':' || ri uid, 'table_row' ut, coalesce(t1.pr, tr.pr) pr, coalesce(t1.path, tr.path) path, tr.table_key tk, x, page p0, page p1, [bid] bs FROM tr LEFT JOIN t1 ON t1.table_key = tr.table_key),
ab AS (SELECT lower(id) id, min(doc_no) doc_no, min(author) author, min(summary) summary, min(datedocument) dd FROM doc_meta WHERE id IS NOT NULL GROUP BY 1),
un AS (SELECT u.*, concat_ws(chr(10), {_LINE('Văn bản', 'summary')}, {_LINE('Số', 'doc_no')}, {_LINE('Cơ quan ban hành', 'author')}, {_LINE('Ngày', 'dd')}, {_LINE('Phần', 'path')}) ctx FROM (SELECT * FROM u0 UNION ALL SELECT * FROM u1) u LEFT JOIN ab ON ab.id = u.d),
uq AS (SELECT *, 240 - 2 - {_OF('ctx')} - 3 free, {_OF('x')} size, row_number() OVER (PARTITION BY d ORDER BY a, b, uid) n FROM un),
pk AS (SELECT d, n, 0 AS pack, size AS held, free AS room, ut, pr, path, tk, ut = 'table_row' AS alone FROM uq WHERE n = 1 UNION ALL SELECT u.d, u.n, CASE WHEN fresh THEN pack + 1 ELSE pack END, CASE WHEN fresh THEN u.size ELSE held + u.size END, CASE WHEN fresh THEN u.free ELSE room END, u.ut, u.pr, u.path, u.tk, u.ut = 'table_row'
    FROM (SELECT r.d rd, r.pack, r.held, r.room, u.*, u.ut = 'table_row' OR r.alone OR u.ut <> r.ut OR u.pr <> r.pr OR u.path <> r.path OR u.tk IS DISTINCT FROM r.tk OR r.held + u.size > r.room AS fresh FROM pk r JOIN uq u ON u.d = r.d AND u.n = r.n + 1) u),
cx AS (SELECT d, path, min(ctx) ctx FROM un GROUP BY 1, 2),
pg AS (SELECT q.d, pack, arg_min(q.ut, q.n) ut, arg_min(q.pr, q.n) pr, arg_min(q.path, q.n) path, arg_min(q.tk, q.n) tk, string_agg(q.x, chr(10) || chr(10) ORDER BY q.n) x, min(p0) p0, max(p1) p1, flatten(list(bs ORDER BY q.n)) ba, list(uid ORDER BY q.n) uids, bool_or(size > free) too FROM uq q JOIN pk ON pk.d = q.d AND pk.n = q.n GROUP BY 1, 2),
ch AS (SELECT pg.*, cx.ctx, array_to_string(list_filter(ba, lambda v, i: list_position(ba, v) = i), ',') bl, {_OF("cx.ctx")} + 3 + {_OF("pg.x")} + 2 tc FROM pg JOIN cx ON cx.d = pg.d AND cx.path = pg.path),
cd AS (SELECT d AS document_id, pack::INT AS chunk_index, {_ID("d", "'v2:child:' || ut || ':' || path || ':' || bl || ':' || array_to_string(uids, ',')")} AS chunk_id, {_ID("d", "'v2:parent:' || pr")} AS parent_id, CASE WHEN tk IS NOT NULL THEN {_ID("d", "'v2:parent:table:' || tk")} END AS table_parent_id, ut AS unit_type, CASE WHEN too THEN NULL ELSE tc END::INT AS token_count, p0::INT AS page_start, p1::INT AS page_end, path AS section_path FROM ch),
pa AS (SELECT d, {_ID("d", "'v2:parent:' || pr")} AS chunk_id, 'section' AS chunk_type, min(p0) p0, max(p1) p1 FROM un GROUP BY d, pr UNION ALL SELECT d, {_ID("d", "'v2:parent:table:' || tk")}, 'table', min(p0), max(p1) FROM un WHERE tk IS NOT NULL GROUP BY d, tk)"""
SQL = {
    "q_logical_tables": _INDEXABLE + _fold(T.Weights()) + _TABLES_OF,
    "q_logical_tables_v3": _INDEXABLE + _fold(T.V3_UNIVERSAL) + _TABLES_OF,
    "q_logical_tables_blocking": _INDEXABLE + _fold(T.V3_BLOCKING) + _TABLES_OF,
    "q_child_chunks": _PACKS + " SELECT document_id, chunk_index, chunk_id, parent_id, unit_type, token_count, page_start, page_end, section_path FROM cd",
    "q_parent_chunks": _PACKS + " SELECT pa.d AS document_id, pa.chunk_id, chunk_type, pa.p0::INT AS page_start, pa.p1::INT AS page_end, count(cd.chunk_id)::INT AS children FROM pa LEFT JOIN cd ON cd.parent_id = pa.chunk_id OR cd.table_parent_id = pa.chunk_id GROUP BY ALL",
    "q_document_runs": _PACKS + ", pn AS (SELECT d, count(*) n FROM pa GROUP BY 1) SELECT document_id, count(*) AS children, count(*) FILTER (unit_type = 'table_row') AS table_rows, round(avg(token_count), 4) AS mean_tokens, max(token_count) AS max_tokens, 0::BIGINT AS fallback_splits, max(pn.n) AS parents, 0::BIGINT AS broken, 'PASS' AS status FROM cd JOIN pn ON pn.d = document_id GROUP BY 1",
    "q_chunk_violations": _PACKS + ", v AS (SELECT unnest([CASE WHEN count(*) OVER (PARTITION BY chunk_id) > 1 THEN 'repeated id' END, CASE WHEN parent_id NOT IN (SELECT chunk_id FROM pa) THEN 'no parent' END, CASE WHEN token_count > 256 THEN 'too long' END, CASE WHEN token_count < 3 THEN 'too short' END, CASE WHEN unit_type = 'table_row' AND table_parent_id IS NULL THEN 'no table' END, CASE WHEN unit_type = 'table_row' AND section_path = '' THEN 'no path' END]) AS rule FROM cd) SELECT rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY 1",
    "q_table_cells": rf"""WITH r AS (SELECT block_key, list_filter(regexp_extract_all(content_raw, '<tr>(.*?)</tr>', 1, 's'), lambda x: NOT contains(x, '<th')) rows FROM ({_TABLES})), u AS (SELECT block_key, unnest(rows) row, generate_subscripts(rows, 1) i FROM r)
        SELECT block_key, (row_number() OVER (PARTITION BY block_key ORDER BY i) - 1)::INT AS row_index, array_to_string(list_transform(regexp_extract_all(row, '<td>(.*?)</td>', 1, 's'), lambda c: {_CELL}), '|') AS cells FROM u""",
    "q_table_row_texts": rf"""WITH r AS (SELECT block_key, list_transform(regexp_extract_all(content_raw, '<th>(.*?)</th>', 1, 's'), lambda c: {_CELL}) heads, list_filter(regexp_extract_all(content_raw, '<tr>(.*?)</tr>', 1, 's'), lambda x: NOT contains(x, '<th')) rows FROM ({_TABLES})),
        u AS (SELECT block_key, heads, unnest(rows) row, generate_subscripts(rows, 1) i FROM r), c AS (SELECT block_key, i, heads, list_transform(regexp_extract_all(row, '<td>(.*?)</td>', 1, 's'), lambda c: {_CELL}) cells FROM u)
        SELECT block_key, (row_number() OVER (PARTITION BY block_key ORDER BY i) - 1)::INT AS row_index, array_to_string(list_filter(list_transform(range(1, len(cells) + 1), lambda j: CASE WHEN cells[j] <> '' THEN heads[j] || ': ' || cells[j] END), lambda x: x IS NOT NULL), chr(10)) AS text FROM c""",
    "q_unreadable_tables": rf"""SELECT error, count(*) AS n FROM (SELECT CASE WHEN NOT contains(coalesce(content_raw, ''), '<table') THEN 'no table' WHEN NOT contains(content_raw, '<tr') THEN 'no rows' END AS error FROM (SELECT DISTINCT ON (block_key) * FROM ocr_block WHERE document_id IS NOT NULL) WHERE lower(trim(block_type)) = 'table') WHERE error IS NOT NULL GROUP BY 1""",
    "q_html_tables": rf"""SELECT block_key, NULL::VARCHAR AS error, len(regexp_extract_all(content_raw, '<th>', 0))::INT AS column_count, len(list_filter(regexp_extract_all(content_raw, '<tr>(.*?)</tr>', 1, 's'), lambda x: NOT contains(x, '<th')))::INT AS n_rows, array_to_string(list_transform(regexp_extract_all(content_raw, '<th>(.*?)</th>', 1, 's'), lambda c: {_CELL}), ' | ') AS headers, 'generic' AS schema_type FROM ({_TABLES})""",
    "q_stored_violations": rf"""WITH c AS (SELECT DISTINCT ON (chunk_key) chunk_id, parent_id, chunk_type, section_path, raw_text, token_count, record_type FROM chunk), k AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) n, parent_id IN (SELECT chunk_id FROM c WHERE record_type = 'parent') AS has, trim(coalesce(raw_text, '')) = '' AS blank, len(regexp_extract_all(coalesce(raw_text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_B}]')) + 2 AS t FROM c WHERE record_type = 'child'),
        v AS (SELECT unnest([CASE WHEN n > 1 THEN 'repeated id' END, CASE WHEN NOT coalesce(has, false) THEN 'no parent' END, CASE WHEN blank THEN 'no text' END, CASE WHEN NOT blank AND coalesce(token_count, -1) <> t THEN 'wrong count' END, CASE WHEN NOT blank AND t > 256 THEN 'too long' END, CASE WHEN NOT blank AND t < 3 THEN 'too short' END, CASE WHEN chunk_type = 'table_row' AND coalesce(len(section_path), 0) = 0 THEN 'no path' END]) AS rule FROM k) SELECT rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY 1""",
    "q_context_prefixes": "SELECT id, concat_ws(chr(10), CASE WHEN trim(coalesce(summary, '')) <> '' THEN 'Văn bản: ' || trim(summary) END, CASE WHEN trim(coalesce(doc_no, '')) <> '' THEN 'Số: ' || trim(doc_no) END, CASE WHEN trim(coalesce(author, '')) <> '' THEN 'Cơ quan ban hành: ' || trim(author) END, CASE WHEN trim(coalesce(datedocument, '')) <> '' THEN 'Ngày: ' || trim(datedocument) END, 'Phần: Điều 1') AS context FROM (SELECT DISTINCT id, summary, doc_no, author, datedocument FROM doc_meta)",
}
