"""Text function, splitter, id and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import ids as I
from docloom.functions import text as X
from docloom.operators import evaluation as E
from docloom.operators import splitters as P
from docloom.session import table as t


def _docs(s: SparkSession, d: str, *more: str) -> DataFrame:
    return t(s, d, "documents", "doc_id", "text", *more)


def norm_ws(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "chunk", "chunk_key", "raw_text").distinct().select("chunk_key", F.md5(X.tidy_plain("raw_text")).alias("h"))


def nfc(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.md5(X.nfc("text")).alias("h"))


def clean_v1(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.md5(X.clean_v1("text")).alias("h"))


def quality(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.round(X.quality("text"), 6).alias("quality"))


def line_filter(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "ocr_block", "block_key", "content_raw").distinct().where("content_raw is not null").select("block_key", F.md5(X.content_lines("content_raw", noise="^(trang|Trang|Page) ")).alias("h"))


def compact_text(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "customer", "c_custkey", "c_name", "c_mktsegment").select("c_custkey", X.compact(F.concat_ws(" ", "c_name", "c_mktsegment", "c_name"), 30).alias("short"))


def slugs(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "extract_entites", "name").where("name is not null").distinct().select("name", I.slug("person", "name").alias("node_id"))


def word_tokens(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.size(X.words("text")).alias("words"), X.token_count("text").alias("tokens"))


def uuid5(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents", "doc_id", "doc_type").select("doc_id", I.uuid5(F.lit(I.URL_NAMESPACE), F.concat_ws(":", F.col("doc_id").cast("string"), "doc_type")).alias("id"))


def fingerprints(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents", "doc_id", "source", "lang").select("doc_id", I.fingerprint("source", "lang").alias("fingerprint"))


def legacy_split(s: SparkSession, d: str) -> DataFrame:
    return P.articles_v1(_docs(s, d), "doc_id", "text").select("doc_id", "chunk_index", "chunk_type", F.md5("chunk").alias("h"))


def legacy_points(s: SparkSession, d: str) -> DataFrame:
    """The ids of the first index's points: one a chunk, within the namespace of its document."""
    from docloom.operators.chunks import legacy_point_id

    return P.articles_v1(_docs(s, d), "doc_id", "text").select("doc_id", "chunk_index", legacy_point_id(F.col("doc_id").cast("string"), F.col("chunk_index")).alias("point_id"))


def experiment_ids(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents", "doc_id", "source", "doc_type", "n_chars").select("doc_id", I.experiment_id(F.coalesce("source", F.lit("none")), F.coalesce("doc_type", F.lit("none")), F.col("n_chars")).alias("experiment_id"))


def error_report(s: SparkSession, d: str) -> DataFrame:
    """The error rates by block type, the least first."""
    return E.ranked_report(recognition(s, d), "cer", "wer", "block_type").select("place", "block_type", "cer", "wer")


def chunk_union(s: SparkSession, d: str) -> DataFrame:
    from docloom.operators.chunks import together

    rows = t(s, d, "chunk", "chunk_key", "chunk_id", "parent_id", "record_type").distinct()
    return together(rows.where("record_type = 'parent'").drop("parent_id"), rows.where("record_type = 'child'")).select("chunk_key", "chunk_id", "parent_id", "record_type")


def fixed_chunks(s: SparkSession, d: str) -> DataFrame:
    return P.fixed(_docs(s, d), "doc_id", "text", 64, 16).select("doc_id", "chunk_index", F.md5("chunk").alias("h"))


def sized_chunks(s: SparkSession, d: str) -> DataFrame:
    return P.sized(_docs(s, d), "doc_id", "text").select("doc_id", "chunk_index", F.length("chunk").alias("n"))


def recursive_chunks(s: SparkSession, d: str) -> DataFrame:
    return P.recursive(_docs(s, d), "doc_id", "text", 800).select("doc_id", "chunk_index", F.length("chunk").alias("n"))


def logical_spans(s: SparkSession, d: str) -> DataFrame:
    return P.spans(_docs(s, d), "doc_id", "text")


def chunk_types(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "ocr_block", "block_key", "block_type").distinct().groupBy(X.block_type("block_type").alias("block_type")).agg(F.count(F.lit(1)).alias("n"))


def props_json(s: SparkSession, d: str) -> DataFrame:
    v = F.from_json(X.json_object(F.concat(F.lit("Answer: "), F.col("props"), F.lit(" (end)"))), "map<string,string>")
    return t(s, d, "events", "event_id", "props").select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(v)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("props"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "ocr_block", "block_key", "content_raw", "content_normalized", "block_type").distinct().where("content_raw is not null and content_normalized is not null")
    return rows.select(X.block_type("block_type").alias("block_type"), X.compare_form("content_raw").alias("truth"), X.compare_form("content_normalized").alias("read"))


def recognition(s: SparkSession, d: str) -> DataFrame:
    return E.recognition(_pairs(s, d), ["block_type"])


def cer(s: SparkSession, d: str) -> DataFrame:
    return recognition(s, d).select("block_type", "lines", "cer", "line_accuracy")


def jaccard(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "ocr_block", "block_key", "content_raw", "content_normalized").distinct().where("content_raw is not null and content_normalized is not null")
    flat = lambda c: F.array_distinct(X.words(X.compare_form(c)))
    return rows.select("block_key", F.round(E.jaccard(flat("content_raw"), flat("content_normalized")), 6).alias("jaccard"))


QUERIES = {
    "q_norm_ws": norm_ws, "q_nfc": nfc, "q_v1_clean": clean_v1, "q_quality_score": quality, "q_line_filter": line_filter, "q_compact_text": compact_text, "q_slug": slugs, "q_word_tokens": word_tokens, "q_uuid5": uuid5, "q_fingerprints": fingerprints,
    "q_legacy_split": legacy_split, "q_fixed_chunks": fixed_chunks, "q_sized_chunks": sized_chunks, "q_recursive_chunks": recursive_chunks, "q_logical_spans": logical_spans, "q_block_types": chunk_types, "q_props_json": props_json, "q_cer": cer, "q_wer": recognition,
    "q_jaccard": jaccard, "q_legacy_points": legacy_points, "q_experiment_ids": experiment_ids, "q_error_report": error_report, "q_chunk_union": chunk_union,
}

_B = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}"
# DuckDB has no compatibility form: the full-width letters are those of ASCII moved by a fixed distance, the rest are blanks and a hyphen
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "‑“”‘’"
_NARROW = ("".join(map(chr, range(0x21, 0x7F))) + "‐\"\"''").replace("'", "''")
_FORM = "trim(regexp_replace(translate(nfc_normalize(@), '" + _WIDE + "', '" + _NARROW + "'), '[" + _B + "]+', ' ', 'g'))"
_PAIR = "SELECT block_key, block_type, " + _FORM.replace("@", "content_raw", 1) + " a, " + _FORM.replace("@", "content_normalized", 1) + " b FROM (SELECT DISTINCT block_key, content_raw, content_normalized, block_type FROM ocr_block WHERE content_raw IS NOT NULL AND content_normalized IS NOT NULL)"
_WORDS = r"list_filter(string_split(trim(regexp_replace(lower(@), '[^\p{L}\p{N}_'']+', ' ', 'g')), ' '), lambda w: w <> '')"
# DuckDB's levenshtein counts bytes: each different item of a pair becomes one ASCII character; a pair of more than 126 gives null, which no query gives
_CODED = "array_to_string(list_transform(@, lambda c: chr(list_position(u, c)::INT)), '')"
_DISTANCE = "CASE WHEN x = y THEN 0 WHEN len(u) > 126 THEN NULL WHEN len(x) = 0 OR len(y) = 0 THEN greatest(len(x), len(y)) ELSE levenshtein(" + _CODED.replace("@", "x") + ", " + _CODED.replace("@", "y") + ") END"


def _items(of: str) -> str:
    return "SELECT *, list_distinct(list_concat(x, y)) u FROM (SELECT *, " + of.replace("@", "a") + " x, " + of.replace("@", "b") + " y FROM (" + _PAIR + "))"


_CHARS = f"SELECT block_key, block_type, a, b, {_DISTANCE} d FROM ({_items('regexp_extract_all(@, $$(?s).$$)')})"
_SPELT = f"SELECT block_type, len(x) wn, {_DISTANCE} wd FROM ({_items(_WORDS)})"
_TYPE = "CASE WHEN {0} IN ('plain_text', 'plaintext', '') THEN 'text' WHEN {0} = 'heading' THEN 'title' WHEN {0} = 'discard' THEN 'abandon' WHEN {0} = 'tablefootnote' THEN 'table_footnote' WHEN {0} = 'figurecaption' THEN 'figure_caption' ELSE {0} END".format("regexp_replace(lower(trim(coalesce(block_type, ''))), '[- ]', '_', 'g')")
SQL = {
    "q_norm_ws": r"""SELECT chunk_key, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(raw_text, ''), chr(160), ' '), '\r\n|\r', chr(10), 'g'), '[ \t\f\x0B]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM (SELECT DISTINCT chunk_key, raw_text FROM chunk)""",
    "q_nfc": "SELECT doc_id, md5(nfc_normalize(text)) AS h FROM documents",
    "q_v1_clean": r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[?]+', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents",
    "q_quality_score": r"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[A-Za-zÀ-ỹĐđ0-9]')) / length(text) ELSE 0 END, 6) AS quality FROM documents",
    "q_line_filter": r"""WITH b AS (SELECT DISTINCT block_key, content_raw FROM ocr_block WHERE content_raw IS NOT NULL) SELECT block_key, md5(array_to_string(list_filter(list_transform(string_split(content_raw, chr(10)), lambda x: regexp_replace(x, '^ +| +$', '', 'g')),
        lambda x: length(x) >= 5 AND NOT regexp_matches(x, '^(trang|Trang|Page) ') AND NOT regexp_matches(x, '^[A-Z0-9\s-]{1,12}$')), chr(10))) AS h FROM b""",
    "q_compact_text": r"""SELECT c_custkey, CASE WHEN length(f) > 30 THEN rtrim(CASE WHEN regexp_extract(left(f, 30), '^(.*) ', 1) = '' THEN left(f, 30) ELSE regexp_extract(left(f, 30), '^(.*) ', 1) END) || '...' ELSE f END AS short FROM (SELECT c_custkey, trim(regexp_replace(concat_ws(' ', c_name, c_mktsegment, c_name), '\s+', ' ', 'g')) f FROM customer)""",
    "q_slug": "SELECT name, 'person_' || regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g') AS node_id FROM (SELECT DISTINCT name FROM extract_entites WHERE name IS NOT NULL)",
    "q_word_tokens": rf"""SELECT doc_id, CASE WHEN w = '' THEN 0 ELSE len(string_split(w, ' ')) END::INT AS words, (len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_B}]')) + 2)::INT AS tokens FROM (SELECT doc_id, text, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_'']+', ' ', 'g')) w FROM documents)""",
    "q_uuid5": f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
        FROM (SELECT doc_id, sha1(from_hex('{I.URL_NAMESPACE}') || encode(concat_ws(':', doc_id::VARCHAR, doc_type))) h FROM documents)""",
    "q_fingerprints": "SELECT doc_id, sha256(coalesce(source, chr(0)) || chr(31) || coalesce(lang, chr(0))) AS fingerprint FROM documents",
    "q_legacy_split": r"""WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '(Điều\s+\d+\s*:)', chr(1) || '\1', 'g'), chr(1))) part, generate_subscripts(string_split(regexp_replace(text, '(Điều\s+\d+\s*:)', chr(1) || '\1', 'g'), chr(1)), 1) i FROM documents),
        s AS (SELECT doc_id, i, regexp_replace(part, '^\s+|\s+$', '', 'g') part FROM p), q AS (SELECT doc_id, i, 1 j, part, part chunk FROM s WHERE part <> '' AND length(part) <= 3000 UNION ALL SELECT doc_id, i, j, part, regexp_replace(x, '^\s+|\s+$', '', 'g') FROM (SELECT doc_id, i, part, unnest(string_split(regexp_replace(part, '\n{2,}', chr(1), 'g'), chr(1))) x, generate_subscripts(string_split(regexp_replace(part, '\n{2,}', chr(1), 'g'), chr(1)), 1) j FROM s WHERE length(part) > 3000) WHERE length(regexp_replace(x, '^\s+|\s+$', '', 'g')) > 200)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS chunk_index, CASE WHEN starts_with(part, 'Điều') THEN 'dieu' ELSE 'header' END AS chunk_type, md5(chunk) AS h FROM q""",
    "q_fixed_chunks": rf"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^{_B}]+') w FROM documents), n AS (SELECT doc_id, w, len(w) n FROM w WHERE len(w) > 0), i AS (SELECT doc_id, w, unnest(range(0, CASE WHEN n <= 64 THEN 1 ELSE ceil((n - 64) / 48.0)::INT + 1 END)) i FROM n)
        SELECT doc_id, i::INT AS chunk_index, md5(array_to_string(w[i * 48 + 1 : i * 48 + 64], ' ')) AS h FROM i""",
    "q_logical_spans": r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) part, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents) SELECT doc_id, (i - 1)::INT AS span_index, (sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(part) - 1)::INT AS start_char, (sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS end_char, part AS span FROM p QUALIFY trim(part) <> ''""",
    "q_block_types": f"SELECT {_TYPE} AS block_type, count(*) AS n FROM (SELECT DISTINCT block_key, block_type FROM ocr_block) GROUP BY 1",
    "q_props_json": "SELECT event_id, (SELECT string_agg(k || '=' || json_extract_string(props, '$.' || k), ';' ORDER BY k) FROM (SELECT unnest(json_keys(props)) k)) AS props FROM events",
    "q_cer": f"SELECT {_TYPE} AS block_type, count(*) AS lines, round(CASE WHEN sum(length(a)) > 0 THEN sum(d) / sum(length(a)) ELSE 0 END, 6) AS cer, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS line_accuracy FROM ({_CHARS}) GROUP BY 1",
    "q_wer": f"""WITH c AS (SELECT {_TYPE} AS block_type, count(*) AS lines, round(CASE WHEN sum(length(a)) > 0 THEN sum(d) / sum(length(a)) ELSE 0 END, 6) AS cer, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS line_accuracy FROM ({_CHARS}) GROUP BY 1),
        w AS (SELECT {_TYPE} AS block_type, round(CASE WHEN sum(wn) > 0 THEN sum(wd) / sum(wn) ELSE 0 END, 6) AS wer FROM ({_SPELT}) GROUP BY 1) SELECT c.block_type, lines, cer, wer, line_accuracy FROM c JOIN w ON c.block_type = w.block_type""",
    "q_jaccard": f"SELECT block_key, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END, 6) AS jaccard FROM (SELECT block_key, list_distinct({_WORDS.replace('@', 'a')}) x, list_distinct({_WORDS.replace('@', 'b')}) y FROM ({_PAIR}))",
}
_U5 = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-5' || substr({0}, 14, 3) || '-' || translate(substr({0}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({0}, 18, 3) || '-' || substr({0}, 21, 12)"
_SPACE = f"replace({_U5.format('n')}, '-', '')"
SQL |= {
    "q_legacy_points": f"""WITH c AS ({SQL["q_legacy_split"]}), k AS (SELECT doc_id, chunk_index, sha1(from_hex('{I.URL_NAMESPACE}') || encode(doc_id::VARCHAR)) n FROM c), g AS (SELECT doc_id, chunk_index, sha1(from_hex({_SPACE}) || encode('chunk-' || chunk_index)) h FROM k) SELECT doc_id, chunk_index, {_U5.format("h")} AS point_id FROM g""",
    "q_experiment_ids": "SELECT doc_id, concat_ws('__', coalesce(source, 'none'), coalesce(doc_type, 'none'), n_chars::VARCHAR) AS experiment_id FROM documents",
    "q_error_report": f"SELECT (row_number() OVER (ORDER BY cer, wer, block_type))::INT AS place, block_type, cer, wer FROM ({SQL['q_wer']})",
    "q_chunk_union": "SELECT DISTINCT chunk_key, chunk_id, CASE WHEN record_type = 'child' THEN parent_id END AS parent_id, record_type FROM chunk WHERE record_type IN ('parent', 'child')",
}
