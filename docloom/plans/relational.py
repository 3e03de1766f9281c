"""Joins, filters, sorts, sets and aggregates of the metadata extract, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import metadata as M
from docloom.session import table as t


def left_join_chain(s: SparkSession, d: str) -> DataFrame:
    return (
        t(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .join(t(s, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(t(s, d, "customer", "c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t(s, d, "nation", "n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(t(s, d, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .join(t(s, d, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(t(s, d, "supplier", "s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name", "n_name", "r_name", "p_brand", "s_name")
    )


def outer_to_inner(s: SparkSession, d: str) -> DataFrame:
    joined = t(s, d, "customer", "c_custkey", "c_name").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where(F.col("o_orderdate") >= "1997-01-01").select("c_custkey", "c_name", "o_orderkey")


def in_list(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "orders").where(F.col("o_orderkey").isin(1, 2, 3, 5, 7, 32, 33, 64, 65, 97, 99, 128, 160, 193, 224)).select("o_orderkey", "o_custkey", "o_orderstatus")


def topn_ordered(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "doc_meta", "id", "doc_no", "author").distinct().orderBy("id").limit(15)


def concat_nulls(s: SparkSession, d: str) -> DataFrame:
    return M.file_labels(t(s, d, "doc_meta"))


def alias_index(s: SparkSession, d: str) -> DataFrame:
    return M.alias_index(t(s, d, "doc_meta"))


def alias_conflicts(s: SparkSession, d: str) -> DataFrame:
    return M.alias_conflicts(t(s, d, "doc_meta"))


def resolve_metadata(s: SparkSession, d: str) -> DataFrame:
    stems = t(s, d, "page_vietocr_results", "document_id").where("document_id is not null").select(F.lower("document_id").alias("stem")).distinct()
    return M.resolve(stems, "stem", M.by_id(t(s, d, "doc_meta"))).select("stem", "doc_no", "author")


def unresolved_metadata(s: SparkSession, d: str) -> DataFrame:
    stems = t(s, d, "ocr_block", "document_id").where("document_id is not null").select(F.lower("document_id").alias("stem")).distinct()
    return M.unresolved(stems, "stem", M.by_id(t(s, d, "doc_meta")))


def semi_filter(s: SparkSession, d: str) -> DataFrame:
    allowed = t(s, d, "doc_meta", "id", "recordtypecode").where("recordtypecode is not null").select(F.lower("id").alias("k"))
    return t(s, d, "chunk", "chunk_key", "document_id").withColumn("k", F.lower("document_id")).join(allowed, "k", "left_semi").select("chunk_key").distinct()


def anti_filter(s: SparkSession, d: str) -> DataFrame:
    have = t(s, d, "ocr_block", "document_id").select(F.lower("document_id").alias("k"))
    return t(s, d, "doc_meta", "id").withColumn("k", F.lower("id")).join(have, "k", "left_anti").select("id").distinct()


def intersect_ids(s: SparkSession, d: str) -> DataFrame:
    a = t(s, d, "ocr_block", "document_id").select(F.lower("document_id").alias("document_id"))
    return a.intersect(t(s, d, "page_vietocr_results", "document_id").select(F.lower("document_id").alias("document_id"))).where("document_id is not null")


def run_summary(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events", "event_type", "value", "user_id")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("users"))


def chunk_summary(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "chunk", "chunk_key", "document_id", "record_type", "chunk_type", "token_count").distinct()
    return c.groupBy(F.lower("document_id").alias("document_id")).agg(
        F.count_if(F.col("record_type") == "child").alias("children"), F.count_if(F.col("record_type") == "parent").alias("parents"), F.count_if(F.col("chunk_type") == "table_row").alias("table_rows"),
        F.round(F.coalesce(F.avg("token_count"), F.lit(0.0)), 6).alias("mean_tokens"), F.coalesce(F.max("token_count"), F.lit(0)).alias("max_tokens"),
    )


def length_stats(s: SparkSession, d: str) -> DataFrame:
    q = F.percentile("n_chars", F.array(*(F.lit(x) for x in (0.5, 0.75, 0.9, 0.95, 0.99))))
    r = t(s, d, "documents", "n_chars").agg(F.count("n_chars").alias("n"), F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("sd"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), q.alias("q"))
    return r.select("n", F.round("m", 4).alias("mean"), F.round("sd", 4).alias("std"), "lo", "hi", *(F.round(F.col("q")[i], 4).alias(f"p{p}") for i, p in enumerate((50, 75, 90, 95, 99))))


def grouped_results(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "documents", "source", "doc_type", "n_chars")
    return c.rollup("source", "doc_type").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("g"))


def pareto(s: SparkSession, d: str) -> DataFrame:
    """Parts that no other part of their brand beats in both size (larger) and price (lower): one pass of a running best per brand."""
    return M.pareto(t(s, d, "part", "p_partkey", "p_brand", "p_size", "p_retailprice"), "p_brand", "p_size", "p_retailprice").select("p_partkey", "p_brand", "p_size", "p_retailprice")


def duplicate_ids(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "chunk", "chunk_key").groupBy("chunk_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def upsert_latest(s: SparkSession, d: str) -> DataFrame:
    return M.upsert(t(s, d, "embbeding"), ["point_id"], ["ingested_at", "name_key"]).select("point_id", "name_key", "chunk_index")


def type_dates(s: SparkSession, d: str) -> DataFrame:
    return M.dates(t(s, d, "doc_meta", "id", "datedocument").distinct(), "datedocument").select("id", "datedocument", F.date_format("date", "yyyy-MM-dd").alias("date"))


def document_objects(s: SparkSession, d: str) -> DataFrame:
    return M.document_objects(t(s, d, "doc_meta"))


QUERIES = {
    "q_left_join_chain": left_join_chain, "q_outer_to_inner": outer_to_inner, "q_in_list": in_list, "q_topn_ordered": topn_ordered, "q_concat_nulls": concat_nulls, "q_alias_index": alias_index, "q_alias_conflicts": alias_conflicts,
    "q_resolve_metadata": resolve_metadata, "q_unresolved_metadata": unresolved_metadata, "q_semi_filter": semi_filter, "q_anti_filter": anti_filter, "q_intersect_ids": intersect_ids, "q_run_summary": run_summary,
    "q_chunk_summary": chunk_summary, "q_length_stats": length_stats, "q_grouped_results": grouped_results, "q_pareto": pareto, "q_duplicate_ids": duplicate_ids, "q_upsert_latest": upsert_latest, "q_type_dates": type_dates, "q_document_objects": document_objects,
}

_ALIASES = """
WITH m AS (SELECT DISTINCT id, lower(regexp_replace(filenameminio, '\\.[^.]*$', '')) a1, lower(fileidminio) a2, lower(fileidminio || '_' || page) a3 FROM doc_meta WHERE trim(coalesce(id, '')) <> ''),
     x AS (SELECT id, unnest([a1, a2, a3]) alias FROM m)
"""
SQL = {
    "q_left_join_chain": """SELECT l_orderkey, l_linenumber, o_orderstatus, c_name, n_name, r_name, p_brand, s_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""",
    "q_outer_to_inner": "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01'",
    "q_in_list": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 7, 32, 33, 64, 65, 97, 99, 128, 160, 193, 224)",
    "q_topn_ordered": "SELECT DISTINCT id, doc_no, author FROM doc_meta ORDER BY id LIMIT 15",
    "q_concat_nulls": "SELECT DISTINCT id, CASE WHEN fileidminio IS NULL AND filenameminio IS NULL THEN '_' ELSE coalesce(fileidminio, '') || '_' || coalesce(filenameminio, '') END AS file_label, 'minio://' || filepathminio AS url FROM doc_meta",
    "q_alias_index": _ALIASES + "SELECT DISTINCT alias, id FROM x WHERE trim(coalesce(alias, '')) NOT IN ('', '_')",
    "q_alias_conflicts": _ALIASES + "SELECT alias, count(DISTINCT id) AS ids FROM x WHERE trim(coalesce(alias, '')) NOT IN ('', '_') GROUP BY alias HAVING count(DISTINCT id) > 1",
    "q_resolve_metadata": "SELECT DISTINCT lower(v.document_id) AS stem, doc_no, author FROM page_vietocr_results v JOIN (SELECT lower(id) k, min(doc_no) doc_no, min(author) author FROM doc_meta GROUP BY 1) ON lower(v.document_id) = k",
    "q_unresolved_metadata": "SELECT DISTINCT lower(document_id) AS stem FROM ocr_block WHERE document_id IS NOT NULL AND lower(document_id) NOT IN (SELECT lower(id) FROM doc_meta WHERE id IS NOT NULL)",
    "q_semi_filter": "SELECT DISTINCT chunk_key FROM chunk WHERE lower(document_id) IN (SELECT lower(id) FROM doc_meta WHERE recordtypecode IS NOT NULL)",
    "q_anti_filter": "SELECT DISTINCT id FROM doc_meta m WHERE NOT EXISTS (SELECT 1 FROM ocr_block o WHERE lower(o.document_id) = lower(m.id))",
    "q_intersect_ids": "SELECT lower(document_id) AS document_id FROM ocr_block WHERE document_id IS NOT NULL INTERSECT SELECT lower(document_id) FROM page_vietocr_results",
    "q_run_summary": "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_high, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "q_chunk_summary": """SELECT lower(document_id) AS document_id, count(*) FILTER (record_type = 'child') AS children, count(*) FILTER (record_type = 'parent') AS parents, count(*) FILTER (chunk_type = 'table_row') AS table_rows,
        round(coalesce(avg(token_count), 0), 6) AS mean_tokens, coalesce(max(token_count), 0) AS max_tokens FROM (SELECT DISTINCT chunk_key, document_id, record_type, chunk_type, token_count FROM chunk) GROUP BY 1""",
    "q_length_stats": """SELECT count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(stddev_pop(n_chars), 4) AS std, min(n_chars) AS lo, max(n_chars) AS hi, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.75), 4) AS p75,
        round(quantile_cont(n_chars, 0.9), 4) AS p90, round(quantile_cont(n_chars, 0.95), 4) AS p95, round(quantile_cont(n_chars, 0.99), 4) AS p99 FROM documents""",
    "q_grouped_results": "SELECT source, doc_type, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping(source, doc_type) AS g FROM documents GROUP BY ROLLUP (source, doc_type)",
    "q_pareto": """SELECT p_partkey, p_brand, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))""",
    "q_duplicate_ids": "SELECT chunk_key, count(*) AS n FROM chunk GROUP BY 1 HAVING count(*) > 1",
    "q_upsert_latest": "SELECT point_id, name_key, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ingested_at DESC NULLS LAST, name_key DESC NULLS LAST) r FROM embbeding) WHERE r = 1",
    "q_type_dates": r"""SELECT id, datedocument, strftime(coalesce(try_strptime(datedocument, '%Y-%m-%d'), try_strptime(datedocument, '%d/%m/%Y'), try_strptime(datedocument, '%d-%m-%Y'), try_strptime(datedocument, '%d.%m.%Y'), try_strptime(left(datedocument, 10), '%Y-%m-%d'),
        try_strptime(regexp_replace(datedocument, '^ngày (\d+) tháng (\d+) năm (\d+)$', '\1/\2/\3'), '%d/%m/%Y'), try_strptime(datedocument, '%Y%m%d')), '%Y-%m-%d') AS date FROM (SELECT DISTINCT id, datedocument FROM doc_meta)""",
    "q_document_objects": """SELECT id AS document_id, max(doc_no) AS doc_no, coalesce(nullif(trim(max(organizationid)), ''), max(author)) AS organization_id, max(recordid) AS record_id, max(boxcode) AS box_code, max(fileidminio) AS file_id FROM doc_meta WHERE trim(coalesce(id, '')) <> '' GROUP BY id""",
}
