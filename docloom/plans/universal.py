"""Queries of the universal outline, its gates and audits, typed prefixes, prompts and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import outline as O
from docloom.operators import prompts as Q
from docloom.operators import retrieval as R
from docloom.operators import tables as T
from docloom.operators import universal as U
from docloom.plans.retrieval import _nearest
from docloom.plans.texts import _NARROW, _WIDE
from docloom.session import cut, table as t

# The types of the documents table that have a profile of their own.
TYPES = {"quyet_dinh": "DECISION", "hop_dong": "CONTRACT", "to_trinh": "PROPOSAL", "cong_van": "OFFICIAL_LETTER"}


def _lines(s: SparkSession, d: str) -> DataFrame:
    return U.lines_of(t(s, d, "documents", "doc_id", "text"), "doc_id", "text")


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return O.candidates(_lines(s, d))


def candidates(s: SparkSession, d: str) -> DataFrame:
    return _candidates(s, d).where("kind <> 'plain_paragraph' or reason is not null").select("document_id", "at", "kind", F.round("score", 4).alias("score"), "accepted", "reason")


def headings(s: SparkSession, d: str) -> DataFrame:
    return O.outline(_candidates(s, d)).select("document_id", "at", "level", "parent_at", F.md5(F.array_join("path", " > ")).alias("path_md5"))


def heading_audit(s: SparkSession, d: str) -> DataFrame:
    made = O.audit(cut(_candidates(s, d)))
    return made.select("document_id", "spans", "accepted", "rejected", "rejected_low_score", "rejected_sentence_continuation", "articles", "orphans", *(f"level_{i}" for i in range(6)))


def marker_lines(s: SparkSession, d: str) -> DataFrame:
    return U.markers(_lines(s, d)).select("document_id", "at", "marker_type", "ordinal", "canonical_level", "inferred_depth")


def profile_markers(s: SparkSession, d: str) -> DataFrame:
    kind = F.lit("UNKNOWN")
    for name, of in TYPES.items():
        kind = F.when(F.col("doc_type") == name, of).otherwise(kind)
    types = t(s, d, "documents", "doc_id", "doc_type").select(F.col("doc_id").cast("string").alias("document_id"), kind.alias("doc_type"))
    return U.profiled(U.markers(_lines(s, d)), types).groupBy("doc_type", "marker_type", "enabled").agg(F.count(F.lit(1)).alias("n"))


def header_fields(s: SparkSession, d: str) -> DataFrame:
    return U.header_fields(_candidates(s, d)).select("document_id", "at", "field")


def party_fields(s: SparkSession, d: str) -> DataFrame:
    rows = U.lines_of(t(s, d, "ocr_block", "block_key", "content_raw").distinct(), "block_key", "content_raw")
    return U.party_fields(O.candidates(rows))


def annex_mentions(s: SparkSession, d: str) -> DataFrame:
    rows = cut(_candidates(s, d))
    said = U.annex_mentions(rows, U.annexes(rows))
    return said.groupBy("document_id").agg(F.count(F.lit(1)).alias("mentions"))


def addressees(s: SparkSession, d: str) -> DataFrame:
    rows = U.lines_of(t(s, d, "chunk", "chunk_key", "raw_text").distinct(), "chunk_key", "raw_text")
    return U.addressees(rows).select("document_id", F.array_join("names", "|").alias("names"), F.col("primary").isNotNull().alias("single"))


def _tables(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "ocr_block", "block_key", "content_raw").distinct().where("content_raw like '%<table%'")
    return T.parse_tables(rows, "block_key", "content_raw")


def table_types(s: SparkSession, d: str) -> DataFrame:
    return U.table_types(_tables(s, d), "block_key")


def header_paths(s: SparkSession, d: str) -> DataFrame:
    rows = _tables(s, d).where("error is null").select("block_key", F.posexplode("header_paths").alias("column", "path"))
    return rows.select("block_key", "column", F.array_join("path", " > ").alias("path"))


def collapsed_paths(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "chunk", "chunk_key", "section_path").distinct().select("chunk_key", F.array_join(O.collapsed(F.col("section_path")), " > ").alias("path"))


def typed_prefixes(s: SparkSession, d: str) -> DataFrame:
    m = t(s, d, "doc_meta", "id", "summary", "doc_no", "author", "recordtypename").distinct()
    kind = F.lit("UNKNOWN")
    for name, of in (("quyết định", "DECISION"), ("hợp đồng", "CONTRACT"), ("tờ trình", "PROPOSAL"), ("công văn", "OFFICIAL_LETTER")):
        kind = F.when(F.col("recordtypename") == f"Loại {name}", of).otherwise(kind)
    names, path = F.array("author", F.lit("Phòng Đào tạo"), F.lit("Thư viện"), F.lit("Ban Giám hiệu")), F.array(F.lit("Chương I"), F.lit("Điều 1"), F.lit("Khoản 2"))
    return m.select("id", F.md5(U.typed_prefix(kind, F.col("summary"), F.col("doc_no"), F.col("author"), F.array_compact(names), F.array_compact(names), F.lit(None).cast("string"), path, 40)).alias("prefix_md5"))


def stored_violations(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "chunk").dropDuplicates(["chunk_key"])
    return U.chunk_violations(rows.where("record_type = 'child'"), rows.where("record_type = 'parent'"), "raw_text").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def chunk_audit(s: SparkSession, d: str) -> DataFrame:
    return U.chunk_audit(t(s, d, "chunk").dropDuplicates(["chunk_key"]).withColumn("document_id", F.lower("document_id")))


def reranked(s: SparkSession, d: str) -> DataFrame:
    """The nearest 40 of each query, three of a label at most, ordered again by score and likeness of label, each with its neighbours of the label."""
    asked = t(s, d, "embeddings", "vec_id", "label").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"))
    hits = _nearest(s, d, 40).join(asked, "query_id")
    kept = U.search(hits, F.col("label"), 10, 3, F.col("score") - 0.01 * F.abs(F.col("label") - F.col("asked")))
    near = U.neighbours(t(s, d, "embeddings", "vec_id", "label"), "label", "vec_id").select("vec_id", F.array_join(F.transform("window", lambda x: x.cast("string")), ",").alias("context"))
    return kept.join(near, "vec_id").select("query_id", "vec_id", "rank", "context")


def embedding_texts(s: SparkSession, d: str) -> DataFrame:
    m = t(s, d, "doc_meta", "id", "summary", "doc_no", "author", "datedocument").distinct()
    return m.select("id", F.md5(Q.embedding_text(F.col("summary"), F.col("doc_no"), F.col("author"), F.col("datedocument"), F.col("summary"))).alias("h"))


def _hits(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "chunk", "chunk_key", "document_id", "chunk_index", "record_type", "raw_text").distinct().where("record_type = 'child'")
    return rows.select(F.lower("document_id").alias("document_id"), F.col("raw_text").alias("text"), "chunk_index", "chunk_key", F.lit("12/QĐ").alias("doc_no"), F.lit("").alias("date"), F.lit(None).cast("string").alias("summary"), F.concat(F.lit("kho/"), F.lower("document_id")).alias("file_url"))


def contexts(s: SparkSession, d: str) -> DataFrame:
    made = None
    for variant in Q.VARIANTS:
        most = {"sources": 3500, "evidence": 3500}.get(variant)
        part = Q.contexts(_hits(s, d), ["document_id"], ["chunk_index", "chunk_key"], variant, most).select("document_id", F.lit(variant).alias("variant"), F.md5("context").alias("h"))
        made = part if made is None else made.unionByName(part)
    return made


def prompts(s: SparkSession, d: str) -> DataFrame:
    m = t(s, d, "doc_meta", "id", "summary", "doc_no").distinct()
    return m.select("id", F.md5(Q.prompt("answer", F.col("summary"), F.concat(F.lit("Số {context} "), F.coalesce("doc_no", F.lit(""))))).alias("h"))


def answers(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "chunk", "chunk_key", "raw_text").distinct().where("raw_text is not null")
    said = F.concat(F.lit("Câu trả lời cuối cùng: "), F.col("raw_text"), F.lit(" [E1] \nNguồn: kho/1\nassistant: "), F.col("raw_text"), F.lit("\nCONTEXT:\n"), F.col("raw_text"))
    return rows.select("chunk_key", F.md5(X.clean_answer(said)).alias("h"))


QUERIES = {
    "q_heading_candidates": candidates, "q_headings": headings, "q_heading_audit": heading_audit, "q_markers": marker_lines, "q_profile_markers": profile_markers, "q_header_fields": header_fields, "q_party_fields": party_fields, "q_annex_mentions": annex_mentions, "q_addressees": addressees,
    "q_table_types": table_types, "q_header_paths": header_paths, "q_collapsed_paths": collapsed_paths, "q_typed_prefixes": typed_prefixes, "q_stored_violations_v3": stored_violations, "q_chunk_audit": chunk_audit, "q_reranked": reranked, "q_embedding_texts": embedding_texts, "q_contexts": contexts,
    "q_prompts": prompts, "q_answer_clean": answers,
}

_BLANKS = "\u00a0\u2007\u202f\u2009\u3000\u2002\u2003"


def _key(column: str) -> str:
    """The match key of Vietnamese and Latin text."""
    return f"lower(translate(strip_accents(translate({column}, '{_WIDE}{_BLANKS}', '{_NARROW}{' ' * len(_BLANKS)}')), 'đĐ', 'dD'))"


def _spans(source: str, key: str, text: str) -> str:
    """The lines of plain texts with their key, as common table expressions up to ``sp``."""
    return f"""WITH RECURSIVE s0 AS (SELECT {key}::VARCHAR d, unnest(string_split({text}, chr(10))) x, generate_subscripts(string_split({text}, chr(10)), 1) AS ln FROM ({source}) WHERE {text} IS NOT NULL),
    sp AS (SELECT d, ln, x, {_key('x')} k, len(regexp_extract_all(x, '\\p{{Lu}}')) / nullif(len(regexp_extract_all(x, '\\p{{L}}')), 0) up, len(regexp_split_to_array(x, '\\s+')) wc, false ti, false ce, 'text' bt FROM (SELECT d, ln, regexp_replace(x, '^ +| +$', '', 'g') x FROM s0) WHERE x <> '')"""


def _case(pairs: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in pairs) + f" ELSE {other} END"


_G = dict(O.GUARDS)
_REG = O.REGISTRY
_STYLE = "round(CASE WHEN ti THEN 0.25 ELSE 0 END + CASE WHEN ce THEN 0.15 ELSE 0 END + CASE WHEN up >= 0.75 THEN 0.10 ELSE 0 END + CASE WHEN wc <= 14 THEN 0.10 ELSE 0 END + CASE WHEN regexp_matches(x, ':\\s*$') THEN 0.05 ELSE 0 END - CASE WHEN wc > 30 THEN 0.25 ELSE 0 END - CASE WHEN regexp_matches(x, '[.;,!?]\\s*$') THEN 0.30 ELSE 0 END - CASE WHEN length(x) > 220 THEN 0.30 ELSE 0 END, 6) >= 0.75"
_HIT = [_STYLE if r[0] == "style_heading" else f"regexp_matches(k, '{r[4]}')" for r in _REG]
_CAND = f""", c0 AS (SELECT *, {_case([(h, f"'{r[0]}'") for h, r in zip(_HIT, _REG)], "'plain_paragraph'")} kind, {_case([(h, str(r[1])) for h, r in zip(_HIT, _REG)], "NULL")} nl, {_case([(h, str(r[2])) for h, r in zip(_HIT, _REG)], "0.0")}::DOUBLE base, {_case([(h, str(r[3])) for h, r in zip(_HIT, _REG)], "2.0")}::DOUBLE bar,
    lag(x) OVER (PARTITION BY d ORDER BY ln) px FROM sp), c1 AS (SELECT *, coalesce(regexp_matches(px, '[,\\p{{Ll}}]\\s*$') AND NOT regexp_matches(px, '[.:;!?]\\s*$'), false) AND regexp_matches(x, '^\\s*\\p{{Ll}}') AND NOT regexp_matches(x, '^\\s*\\p{{Ll}}\\s*[.)]\\s') mid, try_cast(nullif(regexp_extract(k, '^\\s*(\\d{{1,3}})\\s*[.)]', 1), '') AS INT) num,
    last_value(CASE WHEN kind = 'article' THEN regexp_extract(k, '^\\s*dieu\\s+(\\d+)', 1) END IGNORE NULLS) OVER (PARTITION BY d ORDER BY ln) art FROM c0),
    c2 AS (SELECT *, greatest(0.0, least(1.0, base + 0.15 + CASE WHEN ti THEN 0.15 ELSE 0 END + CASE WHEN ce THEN 0.08 ELSE 0 END + CASE WHEN up >= 0.75 THEN 0.05 ELSE 0 END + CASE WHEN wc <= 14 THEN 0.05 ELSE 0 END - CASE WHEN mid THEN 0.60 ELSE 0 END - CASE WHEN regexp_matches(k, '{_G["legal_reference"]}') THEN 0.55 ELSE 0 END - CASE WHEN wc > 45 THEN 0.15 ELSE 0 END - CASE WHEN regexp_matches(x, '^\\s*[,;]') THEN 0.20 ELSE 0 END)) sc,
    CASE WHEN kind = 'primary_number' AND (num = 1 OR lag(num) OVER (PARTITION BY d, kind ORDER BY ln) + 1 = num) THEN 0.05 WHEN kind = 'decimal_number' AND regexp_extract(k, '^\\s*(\\d+)\\.\\d', 1) = art THEN 0.05 ELSE 0 END bonus FROM c1),
    c3 AS (SELECT *, CASE WHEN kind = 'plain_paragraph' THEN 0 ELSE round(least(1.0, sc + bonus), 6) END score FROM c2),
    c4 AS (SELECT *, CASE WHEN regexp_matches(k, '{_G["inline_reference"]}') THEN 'inline_reference' WHEN kind IN ('decimal_number', 'primary_number', 'roman') AND regexp_matches(k, '{_G["numeric_value"]}') THEN 'numeric_value' WHEN regexp_matches(k, '{_G["page_number"]}') THEN 'page_number'
    WHEN kind <> 'plain_paragraph' AND score < bar THEN CASE WHEN mid THEN 'sentence_continuation' WHEN regexp_matches(k, '{_G["legal_reference"]}') THEN 'legal_reference' ELSE 'low_score' END END reason FROM c3), ca AS (SELECT *, reason IS NULL AND score >= bar ok FROM c4)"""
_ABOVE = ", ".join(f"'{k}'" for k in O.ABOVE_CLAUSES)
_BEFORE = "OVER (PARTITION BY d ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LEVEL = f""", l0 AS (SELECT *, last_value(CASE WHEN kind IN ({_ABOVE}) THEN kind END IGNORE NULLS) {_BEFORE} ab, len(string_split(regexp_extract(k, '^\\s*(\\d+(?:\\.\\d+)+)', 1), '.')) dep FROM ca WHERE ok),
    l1 AS (SELECT *, CASE WHEN kind = 'primary_number' AND ab = 'article' THEN 3 WHEN kind = 'decimal_number' THEN CASE WHEN dep <= 2 THEN 3 WHEN dep = 3 THEN 4 ELSE 5 END ELSE nl END lv FROM l0), l2 AS (SELECT *, CASE WHEN lv >= 4 AND max(CASE WHEN lv <= 3 THEN 1 END) {_BEFORE} IS NULL THEN NULL ELSE lv END level FROM l1)"""
_LABEL = "regexp_replace(x, '[\\s.:;,]+$', '')"
_DOCS = "SELECT doc_id, text FROM documents"
_LINES = _spans(_DOCS, "doc_id", "text")
_MARK = dict((n, f"regexp_matches(k, '{r}')") for n, _, r in U.MARKERS) | dict((n, f"regexp_matches(x, '{r}')") for n, _, r in U.CASED)
_LV = dict((n, "NULL" if lv is None else str(lv)) for n, lv, _ in (*U.MARKERS, *U.CASED))
_MARKED = _LINES + f""", m0 AS (SELECT *, {_case([(_MARK[n], f"'{n}'") for n in U.ORDER], "NULL")} mt, {_case([(_MARK[n], _LV[n]) for n in U.ORDER], "NULL")}::INT lv FROM sp), mk AS (SELECT * FROM m0 WHERE mt IS NOT NULL)"""
_B = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}"
_CELL = rf"regexp_replace(regexp_replace(c, '[{_B}]+', ' ', 'g'), '^ | $', '', 'g')"
_HEADS = rf"SELECT block_key, list_transform(regexp_extract_all(content_raw, '<th>(.*?)</th>', 1, 's'), lambda c: {_CELL}) heads FROM (SELECT DISTINCT block_key, content_raw FROM ocr_block WHERE content_raw LIKE '%<table%')"
_SCORES = ", ".join("(" + " + ".join(f"(len(list_filter(hk, lambda h: regexp_matches(h, '\\b{n}\\b'))) > 0)::INT" for n in names) + ")" for names in U.TABLE_TYPES.values())
_KINDS = ", ".join(f"'{k}'" for k in U.TABLE_TYPES)
_CHUNKS = "SELECT DISTINCT ON (chunk_key) * FROM chunk"
_TOKEN = rf"'[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_B}]'"
_PROFILE = ", ".join(f"('{k}', '{m}')" for k, names in U.PROFILES.items() for m in names)
_DTYPE = "CASE doc_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items()) + " ELSE 'UNKNOWN' END"
_SOME = "coalesce(nullif(trim(summary), ''), '')"


def _prefix(names: str, parties: str, path: str) -> str:
    return f"""concat_ws(chr(10), CASE dt WHEN 'DECISION' THEN 'Loại văn bản: Quyết định' WHEN 'CONTRACT' THEN 'Loại văn bản: Hợp đồng' WHEN 'PROPOSAL' THEN 'Loại văn bản: Tờ trình' WHEN 'OFFICIAL_LETTER' THEN 'Loại văn bản: Công văn' END,
        CASE WHEN trim(coalesce(summary, '')) <> '' THEN CASE dt WHEN 'CONTRACT' THEN 'Hợp đồng' WHEN 'OFFICIAL_LETTER' THEN 'Trích yếu' ELSE 'Văn bản' END || ': ' || trim(summary) END, CASE WHEN trim(coalesce(doc_no, '')) <> '' THEN 'Số: ' || trim(doc_no) END,
        CASE WHEN trim(coalesce(author, '')) <> '' AND dt NOT IN ('CONTRACT', 'PROPOSAL') THEN CASE dt WHEN 'OFFICIAL_LETTER' THEN 'Cơ quan gửi' ELSE 'Cơ quan ban hành' END || ': ' || trim(author) END, CASE WHEN dt = 'CONTRACT' THEN 'Các bên: ' || trim({parties}) END, CASE WHEN dt IN ('PROPOSAL', 'OFFICIAL_LETTER') THEN 'Kính gửi: ' || trim({names}) END, 'Phần: {path}')"""


_ALL, _THREE, _ONE = (f"array_to_string(ns{cut_}, ', ')" for cut_ in ("", "[1:3]", "[1:1]"))
_STEPS = [_prefix(_ALL, _ALL, "Chương I > Điều 1 > Khoản 2"), _prefix(_THREE, _ALL, "Chương I > Điều 1 > Khoản 2"), _prefix(_THREE, _ONE, "Chương I > Điều 1 > Khoản 2"), _prefix(_THREE, _ONE, "Điều 1 > Khoản 2")]
_HITS = "WITH h AS (SELECT DISTINCT chunk_key, lower(document_id) document_id, chunk_index, raw_text, regexp_replace(coalesce(raw_text, ''), '^ +| +$', '', 'g') t FROM chunk WHERE record_type = 'child')"
_ORDER = "PARTITION BY document_id ORDER BY chunk_index NULLS FIRST, chunk_key"
_FLAT = rf"trim(regexp_replace(coalesce(raw_text, ''), '[{_B}]+', ' ', 'g'))"
_COMPACT = f"CASE WHEN length({_FLAT}) > 900 THEN rtrim(CASE WHEN regexp_extract(left({_FLAT}, 900), '^(.*) ', 1) = '' THEN left({_FLAT}, 900) ELSE regexp_extract(left({_FLAT}, 900), '^(.*) ', 1) END) || '...' ELSE {_FLAT} END"


def _joined(source: str, block: str, gap: str, most: int | None = None, end: str = "''") -> str:
    used = "" if most is None else f"WHERE used <= {most}"
    return f"SELECT document_id, md5(string_agg(b, {gap} ORDER BY n) || {end}) h FROM (SELECT *, sum(length(b)) OVER (PARTITION BY document_id ORDER BY n) used FROM (SELECT *, {block} b FROM {source})) {used} GROUP BY document_id"


_NL, _RULE = "chr(10)", "chr(10) || '---' || chr(10)"
_NUM = f"(SELECT *, row_number() OVER ({_ORDER}) n FROM h WHERE t <> '')"
_EVID = f"(SELECT *, row_number() OVER ({_ORDER}) n FROM (SELECT *, row_number() OVER (PARTITION BY document_id, lower(c) ORDER BY chunk_index NULLS FIRST, chunk_key) again FROM (SELECT *, {_COMPACT} c FROM h) WHERE c <> '') WHERE again = 1)"
_ANSWER_TEXT = "'Câu trả lời cuối cùng: ' || raw_text || ' [E1] ' || chr(10) || 'Nguồn: kho/1' || chr(10) || 'assistant: ' || raw_text || chr(10) || 'CONTEXT:' || chr(10) || raw_text"
SQL = {
    "q_heading_candidates": _LINES + _CAND + " SELECT d AS document_id, ln AS at, kind, round(score, 4) AS score, ok AS accepted, reason FROM ca WHERE kind <> 'plain_paragraph' OR reason IS NOT NULL",
    "q_headings": _LINES + _CAND + _LEVEL + f""", hd AS (SELECT d, ln, level, trim(k) k, CASE WHEN length({_LABEL}) > 80 THEN rtrim(left({_LABEL}, 79)) || '…' ELSE {_LABEL} END lab FROM l2 WHERE level IS NOT NULL), pr AS (SELECT a.d, a.ln, max(b.ln) pa FROM hd a LEFT JOIN hd b ON a.d = b.d AND b.ln < a.ln AND b.level < a.level GROUP BY 1, 2),
        nd AS (SELECT hd.*, pa FROM hd JOIN pr ON hd.d = pr.d AND hd.ln = pr.ln), w AS (SELECT d, ln, CASE WHEN lab = '' THEN []::VARCHAR[] ELSE [lab] END p, CASE WHEN lab = '' THEN '' ELSE k END lk FROM nd WHERE pa IS NULL UNION ALL SELECT nd.d, nd.ln, CASE WHEN lab = '' OR w.lk = nd.k THEN w.p ELSE list_append(w.p, lab) END, CASE WHEN lab = '' THEN w.lk ELSE nd.k END FROM nd JOIN w ON w.d = nd.d AND w.ln = nd.pa)
        SELECT nd.d AS document_id, nd.ln AS at, level, pa AS parent_at, md5(array_to_string(w.p, ' > ')) AS path_md5 FROM nd JOIN w ON w.d = nd.d AND w.ln = nd.ln""",
    "q_heading_audit": _LINES + _CAND + _LEVEL + """, a AS (SELECT d, count(*) AS spans, count(*) FILTER (kind <> 'plain_paragraph' AND ok) AS accepted, count(*) FILTER (kind <> 'plain_paragraph' AND NOT ok) AS rejected, count(*) FILTER (reason = 'low_score') AS rejected_low_score, count(*) FILTER (reason = 'sentence_continuation') AS rejected_sentence_continuation, count(*) FILTER (ok AND kind = 'article') AS articles FROM ca GROUP BY 1),
        b AS (SELECT d, count(*) FILTER (level IS NULL) AS orphans, """ + ", ".join(f"count(*) FILTER (level = {i}) AS level_{i}" for i in range(6)) + " FROM l2 GROUP BY 1) SELECT a.d AS document_id, spans, accepted, rejected, rejected_low_score, rejected_sentence_continuation, articles, coalesce(orphans, 0) AS orphans, " + ", ".join(f"coalesce(level_{i}, 0) AS level_{i}" for i in range(6)) + " FROM a LEFT JOIN b ON a.d = b.d",
    "q_markers": _MARKED + r""" SELECT d AS document_id, ln AS at, mt AS marker_type, CASE WHEN mt IN ('recipients', 'signature', 'semantic') THEN '' ELSE regexp_extract(k, '^\s*(?:[a-z]{3,}(?:\s+luc|\s+thu)?\s+)?(?:so\s+)?([0-9]+(?:\.[0-9]+)*[a-z]?|[ivxlcdm]+|[a-z])\s*(?:[.:)\-]|\s|$)', 1) END AS ordinal, lv AS canonical_level,
        CASE WHEN mt = 'decimal' THEN len(string_split(regexp_extract(k, '^\s*(\d+(?:\.\d+)+)', 1), '.')) ELSE 1 END::INT AS inferred_depth FROM mk""",
    "q_profile_markers": _MARKED + f", p AS (SELECT * FROM (VALUES {_PROFILE}) v(dt, m)), y AS (SELECT mk.mt, {_DTYPE} dt FROM mk JOIN documents ON d = doc_id::VARCHAR) SELECT y.dt AS doc_type, y.mt AS marker_type, p.m IS NOT NULL AS enabled, count(*) AS n FROM y LEFT JOIN p ON p.dt = y.dt AND p.m = y.mt GROUP BY 1, 2, 3",
    "q_header_fields": _LINES + _CAND + f""", o AS (SELECT *, max(CASE WHEN ok AND kind NOT IN ('bullet', 'semantic_heading') THEN 1 END) OVER (PARTITION BY d ORDER BY ln) op FROM ca), f AS (SELECT d, ln, CASE {" ".join(f"WHEN regexp_matches(k, '{r}') THEN '{n}'" for n, r in U.HEADER)} WHEN op IS NULL AND regexp_matches(k, '{U.LEGAL_BASIS}') THEN 'legal_basis'
        WHEN op IS NULL AND regexp_matches(k, '^\\s*(?:bo|truong|uy ban|so|phong|vien|trung tam)\\s') AND up >= 0.75 THEN 'issuer' END f FROM o) SELECT d AS document_id, ln AS at, f AS field FROM f WHERE f IS NOT NULL""",
    "q_party_fields": _spans("SELECT DISTINCT block_key, content_raw FROM ocr_block", "block_key", "content_raw") + _CAND + f""", z AS (SELECT *, nullif(regexp_extract(k, '{U.PARTY}', 1), '') l FROM ca), q AS (SELECT *, last_value(CASE WHEN l IS NOT NULL THEN l WHEN regexp_matches(k, '^\\s*(?:hai|cac) ben\\s+(?:thong nhat|thoa thuan|cung)') OR ok AND kind IN ('article', 'chapter', 'part') THEN '' END IGNORE NULLS) OVER (PARTITION BY d ORDER BY ln) p FROM z),
        g AS (SELECT d, ln, p, CASE WHEN l IS NOT NULL THEN 'party_name' {" ".join("WHEN regexp_matches(k, '^\\s*[-+]?\\s*(?:" + "|".join(w) + f")\\s*:') THEN '{n}'" for n, w in U.PARTY_FIELDS.items())} END f, CASE WHEN contains(x, ':') THEN trim(regexp_replace(x, '^[^:]*:', '')) ELSE trim(x) END v FROM q WHERE p <> '') SELECT d AS document_id, ln AS at, upper(p) AS party, f AS field, v AS value FROM g WHERE f IS NOT NULL AND v <> ''""",
    "q_annex_mentions": _LINES + _CAND + r" SELECT d AS document_id, sum(len(regexp_extract_all(k, '\bphu\s*luc\s+(?:so\s+)?([0-9]+|[ivxlcdm]+)\b')))::BIGINT AS mentions FROM ca WHERE NOT (kind = 'annex' AND ok) AND regexp_matches(k, '\bphu\s*luc\s+(?:so\s+)?([0-9]+|[ivxlcdm]+)\b') GROUP BY 1",
    "q_addressees": _spans("SELECT DISTINCT chunk_key, raw_text FROM chunk", "chunk_key", "raw_text") + r""", z AS (SELECT *, regexp_matches(k, '^\s*kinh gui\b') hd, regexp_matches(x, '^\s*[-–+•]\s+') it FROM sp), q AS (SELECT *, last_value(CASE WHEN hd THEN true WHEN NOT it THEN false END IGNORE NULLS) OVER (PARTITION BY d ORDER BY ln) op FROM z),
        n AS (SELECT d, ln, regexp_replace(trim(CASE WHEN hd THEN regexp_replace(x, '(?i)^\s*kính\s+gửi\s*:?\s*', '') ELSE regexp_replace(x, '^\s*[-–+•]\s+', '') END), '[\s;.,]+$', '') v FROM q WHERE op) SELECT d AS document_id, string_agg(v, '|' ORDER BY ln) AS names, count(*) = 1 AS single FROM n WHERE v <> '' GROUP BY 1""",
    "q_table_types": f"WITH h AS ({_HEADS}), k AS (SELECT block_key, list_transform(heads, lambda c: {_key('c')}) hk FROM h), s AS (SELECT block_key, [{_SCORES}] sc FROM k) SELECT block_key, CASE WHEN list_max(sc) >= 2 THEN [{_KINDS}][list_position(sc, list_max(sc))] ELSE 'GENERIC' END AS table_type FROM s",
    "q_header_paths": f"SELECT block_key, (i - 1)::INT AS \"column\", path FROM (SELECT block_key, unnest(heads) path, generate_subscripts(heads, 1) i FROM ({_HEADS}))",
    "q_collapsed_paths": "WITH p AS (SELECT DISTINCT chunk_key, section_path FROM chunk), k AS (SELECT chunk_key, list_filter(list_transform(section_path, lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda x: coalesce(x, '') <> '') l FROM p) SELECT chunk_key, array_to_string(list_filter(l, lambda x, i: i = 1 OR lower(x) <> lower(l[i - 1])), ' > ') AS path FROM k",
    "q_typed_prefixes": f"""WITH m AS (SELECT DISTINCT id, summary, doc_no, author, recordtypename FROM doc_meta), y AS (SELECT *, CASE recordtypename WHEN 'Loại quyết định' THEN 'DECISION' WHEN 'Loại hợp đồng' THEN 'CONTRACT' WHEN 'Loại tờ trình' THEN 'PROPOSAL' WHEN 'Loại công văn' THEN 'OFFICIAL_LETTER' ELSE 'UNKNOWN' END dt, list_filter([author, 'Phòng Đào tạo', 'Thư viện', 'Ban Giám hiệu'], lambda x: x IS NOT NULL) ns FROM m),
        s AS (SELECT id, [{", ".join(_STEPS)}] st FROM y) SELECT id, md5(coalesce(list_filter(st, lambda x: len(regexp_extract_all(x, {_TOKEN})) <= 40)[1], st[4])) AS prefix_md5 FROM s""",
    "q_stored_violations_v3": f"""WITH c AS ({_CHUNKS}), p AS (SELECT DISTINCT chunk_id FROM c WHERE record_type = 'parent'), v AS (SELECT unnest([CASE WHEN len(regexp_extract_all(coalesce(raw_text, ''), {_TOKEN})) + 2 > 256 THEN 'too long' END, CASE WHEN p.chunk_id IS NULL THEN 'no parent' END, CASE WHEN coalesce(len(section_path), 0) = 0 THEN 'no path' END, CASE WHEN chunk_type = 'table_row' AND parent_id IS NULL THEN 'row without table' END,
        CASE WHEN length(trim(coalesce(raw_text, ''))) < 2 THEN 'empty' END, CASE WHEN coalesce(len(source_block_ids), 0) = 0 THEN 'no source' END]) AS rule FROM c LEFT JOIN p ON c.parent_id = p.chunk_id WHERE record_type = 'child') SELECT rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY 1""",
    "q_chunk_audit": f"""SELECT lower(document_id) AS document_id, count(*) FILTER (record_type = 'parent') AS parents, count(*) FILTER (record_type = 'child') AS children, round(avg(token_count) FILTER (record_type = 'child'), 4) AS mean_tokens, round(quantile_cont(token_count, 0.95) FILTER (record_type = 'child'), 4) AS p95_tokens, max(token_count) FILTER (record_type = 'child') AS max_tokens,
        count(*) FILTER (record_type = 'child' AND metadata['method'] = 'token_window') AS window_splits, count(*) FILTER (record_type = 'child' AND chunk_type = 'table_row') AS table_rows, count(*) FILTER (page_end > page_start) AS over_pages FROM ({_CHUNKS}) GROUP BY 1""",
    "q_reranked": """WITH s AS (SELECT q.vec_id AS query_id, q.label AS asked, v.vec_id, v.label, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r0 FROM s QUALIFY r0 <= 40),
        u AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY r0) AS n FROM t QUALIFY n <= 3), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score - 0.01 * abs(label - asked), 9) DESC, r0)::INT AS rank FROM u QUALIFY rank <= 10), x AS (SELECT vec_id, concat_ws(',', lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id), lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id)) AS context FROM embeddings)
        SELECT query_id, w.vec_id, rank, context FROM w JOIN x ON w.vec_id = x.vec_id""",
    "q_embedding_texts": "SELECT id, md5(regexp_replace('Văn bản: ' || coalesce(summary, '') || chr(10) || 'Số: ' || coalesce(doc_no, '') || chr(10) || 'Cơ quan ban hành: ' || coalesce(author, '') || chr(10) || 'Ngày: ' || coalesce(datedocument, '') || chr(10) || chr(10) || 'Nội dung:' || chr(10) || coalesce(summary, ''), '^ +| +$', '', 'g')) AS h FROM (SELECT DISTINCT id, summary, doc_no, author, datedocument FROM doc_meta)",
    "q_contexts": _HITS + " SELECT document_id, variant, h FROM (" + " UNION ALL ".join(f"SELECT *, '{v}' AS variant FROM ({q})" for v, q in (
        ("plain", _joined(_NUM, "t", _NL, None, "chr(10) || 'File_URL: kho/' || document_id")), ("chunks", _joined(_NUM, f"'[CHUNK ' || n || ']' || {_NL} || t", "chr(10) || chr(10)")),
        ("sources", _joined(_NUM, f"'[DOC_ID: ' || document_id || ']' || {_NL} || t || {_NL} || 'NGUỒN: kho/' || document_id || {_NL}", _RULE, 3500)),
        ("evidence", _joined(_EVID, f"'[E' || n || ']' || {_NL} || 'so_quyet_dinh: 12/QĐ' || {_NL} || 'ngay_ban_hanh: N/A' || {_NL} || 'tom_tat_tai_lieu: N/A' || {_NL} || 'doan_van_ban_ocr:' || {_NL} || c || {_NL}", _RULE, 3500)),
        ("fields", _joined(_NUM, f"'[E' || n || '] doc_no: 12/QĐ' || {_NL} || 'date: N/A' || {_NL} || 'summary: N/A' || {_NL} || 'chunk_index: ' || coalesce(chunk_index::VARCHAR, 'N/A') || {_NL} || 'file_url: kho/' || document_id || {_NL} || 'text:' || {_NL} || t || {_NL}", _RULE)),
    )) + ")",
    "q_prompts": "SELECT id, md5(replace(replace('" + Q.PROMPTS["answer"].replace("{context}", "\x02").replace("{question}", "\x03").replace("'", "''") + "', chr(2), coalesce(summary, '')), chr(3), 'Số {context} ' || coalesce(doc_no, ''))) AS h FROM (SELECT DISTINCT id, summary, doc_no FROM doc_meta)",
    "q_answer_clean": rf"""WITH a AS (SELECT DISTINCT chunk_key, raw_text FROM chunk WHERE raw_text IS NOT NULL), b AS (SELECT chunk_key, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_ANSWER_TEXT}, '(?is)\n(?:CONTEXT|QUESTION|CÂU HỎI|YÊU CẦU TRẢ LỜI):.*', ''), '(?im)^\s*(?:assistant|user|system)\s*:\s*', '', 'g'), '(?im)^\s*câu trả lời(?: cuối cùng)?\s*:\s*', '', 'g'), '\s*\[E\d+\]\s*', ' ', 'g'), '(?im)^\s*(?:doc_id|doc_no|chunk_index|file_url|nguồn)\s*:.*$', '', 'g') x FROM a),
        l AS (SELECT chunk_key, list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(regexp_replace(y, '[{_B}]+', ' ', 'g'))), lambda y: y <> '') ls FROM b) SELECT chunk_key, md5(regexp_replace(coalesce(array_to_string(list_filter(ls, lambda y, i: list_position(list_transform(ls, lambda z: lower(z)), lower(y)) = i), chr(10)), ''), '^[ :\-\n\t]+|[ :\-\n\t]+$', '', 'g')) AS h FROM l""",
}
