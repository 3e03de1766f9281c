"""Retrieval queries over vectors and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import retrieval as R
from docloom.session import table as t


def _queries(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50, against all vectors."""
    return t(s, d, "embeddings", "vec_id", "embedding").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _nearest(s: SparkSession, d: str, k: int, where: Column | None = None) -> DataFrame:
    rows = t(s, d, "embeddings")
    found = R.search_each(rows if where is None else rows.where(where), _queries(s, d), k, "vec_id")
    return found.join(rows.select("vec_id", "label"), "vec_id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", "vec_id", "label", F.round("score", 5).alias("score"))


def vector_topk(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_nearest(s, d, 10))


def vector_topk_filtered(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_nearest(s, d, 10, F.col("label").isin(1, 3, 5)))


def dedup_per_parent(s: SparkSession, d: str) -> DataFrame:
    kept = R.per_parent(_nearest(s, d, 30), F.col("label"), 3, "query_id")
    best = Window.partitionBy("query_id").orderBy("rank")
    return _rounded(kept.withColumn("n", F.row_number().over(best)).where("n <= 10"))


def score_threshold(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_nearest(s, d, 5).where("score >= 0.2"))


def rank_metrics(s: SparkSession, d: str) -> DataFrame:
    """Hit rate, recall, reciprocal rank, nDCG and average precision at 10 of each query, the other vectors of its label being relevant."""
    from docloom.operators import evaluation as E

    rows = t(s, d, "embeddings", "vec_id", "label")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("l"))
    near = _nearest(s, d, 11).where("query_id <> vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    hits = near.where("rank <= 10").join(asked, "query_id").select("query_id", F.col("vec_id").alias("item"), "rank", (F.col("label") == F.col("l")).cast("int").alias("rel"))
    sizes = rows.groupBy(F.col("label").alias("l")).agg((F.count(F.lit(1)) - 1).alias("total"))
    return E.judged(hits, asked.join(sizes, "l").select("query_id", "total"), 10)


def _hits(s: SparkSession, d: str) -> DataFrame:
    """All children as hits, ranked within each document."""
    rows = t(s, d, "chunk", "chunk_key", "document_id", "chunk_id", "parent_id", "chunk_type", "record_type").where("record_type = 'child'").withColumn("document_id", F.lower("document_id")).distinct()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_key", "chunk_id"))).drop("record_type")


def _flat(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", "parent_id", "rank", F.array_join("context", ",").alias("context"))


def expand_parent(s: SparkSession, d: str) -> DataFrame:
    return _flat(R.expand(_hits(s, d), R.parent_store(t(s, d, "chunk")), "parent"))


def expand_siblings(s: SparkSession, d: str) -> DataFrame:
    chunks = t(s, d, "chunk", "chunk_key", "chunk_id", "parent_id", "chunk_index", "record_type").distinct()
    return _flat(R.expand(_hits(s, d), R.parent_store(chunks), "siblings", R.sibling_store(chunks)))


def expand_adaptive(s: SparkSession, d: str) -> DataFrame:
    hits = _hits(s, d).withColumn("table_parent_id", F.when(F.col("chunk_type") == "table_row", F.col("parent_id")))
    return _flat(R.expand(hits, R.parent_store(t(s, d, "chunk")), "adaptive"))


def sibling_store(s: SparkSession, d: str) -> DataFrame:
    chunks = t(s, d, "chunk", "chunk_key", "chunk_id", "parent_id", "chunk_index", "record_type").distinct()
    return R.sibling_store(chunks).select("parent_id", F.array_join("sibling_ids", ",").alias("siblings"))


def context_budget(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "chunk", "chunk_key", "parent_id", "record_type", "raw_text").distinct().where("record_type = 'child' and parent_id is not null and raw_text is not null")
    return R.within_budget(rows, ["parent_id"], ["chunk_key"], "raw_text", 1200).select("parent_id", "chunk_key", "used")


def context_blocks(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "chunk", "chunk_key", "parent_id", "record_type", "raw_text").distinct().where("record_type = 'child' and parent_id is not null and raw_text is not null")
    return R.context_block(R.within_budget(rows, ["parent_id"], ["chunk_key"], "raw_text", 1200), ["parent_id"], ["chunk_key"], "raw_text").select("parent_id", F.md5("context").alias("context_md5"))


def points_per_document(s: SparkSession, d: str) -> DataFrame:
    return R.points_per_document(t(s, d, "embbeding"))


def child_filter(s: SparkSession, d: str) -> DataFrame:
    return R.embedding_children(t(s, d, "chunk", "chunk_key", "record_type", "chunk_type")).distinct().groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "q_vector_topk": vector_topk, "q_vector_topk_filtered": vector_topk_filtered, "q_dedup_per_parent": dedup_per_parent, "q_score_threshold": score_threshold, "q_rank_metrics": rank_metrics, "q_expand_parent": expand_parent,
    "q_expand_siblings": expand_siblings, "q_expand_adaptive": expand_adaptive, "q_sibling_store": sibling_store, "q_context_budget": context_budget, "q_context_blocks": context_blocks, "q_points_per_document": points_per_document, "q_child_filter": child_filter,
}

_SCORED = "WITH s AS (SELECT q.vec_id AS query_id, q.label AS asked, v.vec_id, v.label, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 {}), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) "
_HITS = "WITH h AS (SELECT chunk_key, chunk_id, parent_id, chunk_type, row_number() OVER (PARTITION BY document_id ORDER BY chunk_key, chunk_id)::INT AS rank FROM (SELECT DISTINCT chunk_key, lower(document_id) AS document_id, chunk_id, parent_id, chunk_type FROM chunk WHERE record_type = 'child')), p AS (SELECT DISTINCT chunk_id AS pid FROM chunk WHERE record_type = 'parent') "
_CHILDREN = "SELECT DISTINCT chunk_key, chunk_id, parent_id, chunk_index FROM chunk WHERE record_type = 'child' AND parent_id IS NOT NULL"
_BUDGET = "SELECT parent_id, chunk_key, raw_text, sum(length(raw_text) + 2) OVER (PARTITION BY parent_id ORDER BY chunk_key) - 2 AS used FROM (SELECT DISTINCT chunk_key, parent_id, raw_text FROM chunk WHERE record_type = 'child' AND parent_id IS NOT NULL AND raw_text IS NOT NULL)"
SQL = {
    "q_vector_topk": _SCORED.format("") + "SELECT query_id, vec_id, label, round(score, 5) AS score FROM t WHERE rank <= 10",
    "q_vector_topk_filtered": _SCORED.format("AND v.label IN (1, 3, 5)") + "SELECT query_id, vec_id, label, round(score, 5) AS score FROM t WHERE rank <= 10",
    "q_dedup_per_parent": _SCORED.format("") + "SELECT query_id, vec_id, label, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS m FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM t WHERE rank <= 30) WHERE n <= 3) WHERE m <= 10",
    "q_score_threshold": _SCORED.format("") + "SELECT query_id, vec_id, label, round(score, 5) AS score FROM t WHERE rank <= 5 AND t.score >= 0.2",
    "q_rank_metrics": _SCORED.format("AND q.vec_id <> v.vec_id") + """, r AS (SELECT query_id, rank, CASE WHEN label = asked THEN 1 ELSE 0 END AS rel FROM t WHERE rank <= 10),
        n AS (SELECT q.vec_id AS query_id, (SELECT count(*) FROM embeddings v WHERE v.label = q.label) - 1 AS total FROM embeddings q WHERE q.vec_id % 50 = 0), c AS (SELECT query_id, rank, rel, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS found FROM r)
        SELECT query_id, max(rel)::INT AS hit, round(coalesce(sum(rel) / nullif(max(total), 0), 0), 6) AS recall, round(coalesce(max(CASE WHEN rel = 1 THEN 1.0 / rank END), 0), 6) AS mrr,
        round(coalesce(sum(rel / log2(rank + 1)) / nullif(max((SELECT sum(1 / log2(i + 1)) FROM range(1, 11) x(i) WHERE i <= total)), 0), 0), 6) AS ndcg, round(coalesce(sum(CASE WHEN rel = 1 THEN found * 1.0 / rank ELSE 0 END) / nullif(max(least(total, 10)), 0), 0), 6) AS map FROM c JOIN n USING (query_id) GROUP BY query_id""",
    "q_expand_parent": _HITS + "SELECT chunk_id, parent_id, rank, coalesce(pid, '') AS context FROM h LEFT JOIN p ON parent_id = pid",
    "q_expand_siblings": _HITS + f", k AS (SELECT parent_id AS pk, list(chunk_id ORDER BY chunk_index, chunk_id) AS ids FROM ({_CHILDREN}) GROUP BY 1) SELECT chunk_id, parent_id, rank, coalesce(array_to_string(list_filter(ids, lambda x: x <> chunk_id), ','), '') AS context FROM h LEFT JOIN k ON parent_id = pk",
    "q_expand_adaptive": _HITS + "SELECT chunk_id, parent_id, rank, coalesce(pid, '') AS context FROM h LEFT JOIN p ON parent_id = pid",  # a row's table is its parent here
    "q_sibling_store": f"SELECT parent_id, string_agg(chunk_id, ',' ORDER BY chunk_index, chunk_id) AS siblings FROM ({_CHILDREN}) GROUP BY 1",
    "q_context_budget": f"SELECT parent_id, chunk_key, used::BIGINT AS used FROM ({_BUDGET}) WHERE used <= 1200",
    "q_context_blocks": f"SELECT parent_id, md5(string_agg('[E' || n || ']' || chr(10) || raw_text, chr(10) || chr(10) ORDER BY n)) AS context_md5 FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY chunk_key) n FROM ({_BUDGET}) WHERE used <= 1200) GROUP BY 1",
    "q_points_per_document": "SELECT lower(document_id) AS document_id, count(DISTINCT point_id) AS points FROM embbeding GROUP BY 1",
    "q_child_filter": "SELECT chunk_type, count(*) AS n FROM (SELECT DISTINCT chunk_key, chunk_type FROM chunk WHERE record_type = 'child') GROUP BY 1",
}
