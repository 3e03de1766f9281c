"""Vector search, filters, per-parent limits, context expansion and context budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, 0 if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(F.lit(0.0))


def scored(vectors: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """``vectors`` with its similarity to one query vector, given as literals so that nothing is joined."""
    return vectors.withColumn("score", cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query))))


def top_k(rows: DataFrame, k: int, tie: str) -> DataFrame:
    """The k best rows, ties by the key; ``rank`` from 1. Spark takes the top of each partition before it merges."""
    best = rows.orderBy(F.col("score").desc(), tie).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), tie)))


def per_parent(hits: DataFrame, parent: Column, most: int, *query: str) -> DataFrame:
    """At most ``most`` hits of each parent (of each ``query``), the better ranked ones; 0 or less sets no limit. The ranking is kept."""
    if most <= 0:
        return hits
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*query, parent).orderBy("rank"))).where(F.col("_n") <= most).drop("_n")


#: queries of a block, whose vectors are sent to all tasks at once
BLOCK = 4096


def search_each(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k rows of ``vectors`` most alike to each query: query_id, the key, score, rank; ties by the key.

    ``queries`` has query_id (long) and the vector. Queries are taken in blocks
    of about ``block``, each sent to all tasks; a task keeps k rows a query, so
    nothing but these is shuffled and no pair is written out. Cosines are exact
    up to nine digits. Vectors that are null, of another length than the
    query's or without length score 0, as do such queries.
    """
    kind = vectors.select(F.col(key)).dtypes[0][1]
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(vector).alias("v"))
    blocks = -(-asked.count() // block)
    empty = vectors.select(F.lit(0).cast("long").alias("query_id"), F.col(key), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    source = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    found = None
    for at in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at).collect()  # about ``block`` rows
        ids, size = np.array([r.query_id for r in rows], dtype=np.int64), max((len(r.v) for r in rows if r.v is not None), default=0)
        held = vectors.sparkSession.sparkContext.broadcast((ids, _unit([r.v for r in rows], size)))
        part = source.mapInArrow(lambda batches, held=held: _best(batches, held.value, k), f"query_id long, key {kind}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return empty
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key"))).where(F.col("rank") <= k)
    return best.withColumnRenamed("key", key)


def _unit(rows: list, size: int) -> np.ndarray:
    """Rows of length one; zero where there is no vector of that length."""
    out = np.zeros((len(rows), size))
    for i, row in enumerate(rows):
        if row is not None and len(row) == size and None not in row:
            out[i] = row
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _best(batches: Iterator[pa.RecordBatch], held: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of a partition for each query of a block."""
    ids, asked = held
    scores, keys = np.zeros((len(ids), 0)), None
    for batch in batches:
        given = _unit(batch.column(1).to_pylist(), asked.shape[1])
        fresh = pa.chunked_array([batch.column(0)])
        for low in range(0, batch.num_rows, 2048):
            more = np.round(asked @ given[low : low + 2048].T, 9)
            names = fresh.slice(low, 2048).combine_chunks()
            order = names.to_numpy(zero_copy_only=False)
            both = np.concatenate([scores, more], axis=1)
            tags = np.concatenate([keys, np.broadcast_to(order, more.shape)], axis=1) if keys is not None else np.broadcast_to(order, more.shape)
            taken = np.lexsort((tags, -both), axis=1)[:, :k]
            scores, keys = np.take_along_axis(both, taken, 1), np.take_along_axis(tags, taken, 1)
    if keys is not None and len(ids):
        width = scores.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, width)), pa.array(keys.ravel()), pa.array(scores.ravel())], names=["query_id", "key", "score"])


def search(vectors: DataFrame, query: list[float], k: int, key: str, parent: str | None = None, most: int = 3, over: int = 3, where: Column | None = None) -> DataFrame:
    """Filter, score, over-fetch, limit per parent, cut to k."""
    rows = vectors if where is None else vectors.where(where)
    if parent is None:
        return top_k(scored(rows, query), k, key)
    kept = per_parent(top_k(scored(rows, query), k * max(over, 1), key), F.coalesce(F.col(parent).cast("string"), F.col(key).cast("string")), most)
    return kept.orderBy("rank").limit(k)


def evidence(hits: DataFrame, least: float = 0.3, most: int = 5) -> DataFrame:
    """The first ``most`` hits in rank order whose score is at least ``least``."""
    return hits.where(F.col("score") >= least).orderBy("rank").limit(most)


def answerable(hits: DataFrame, route: Column) -> DataFrame:
    """One row: whether there are hits and they were found by more than vectors."""
    return hits.agg((F.count(F.lit(1)) > 0).alias("any")).select((F.col("any") & (route != "VECTOR_ONLY")).alias("answerable"))


def sibling_store(chunks: DataFrame) -> DataFrame:
    """Each parent's children in order, as one array."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x["chunk_id"])
    return chunks.where("parent_id is not null and record_type = 'child'").groupBy("parent_id").agg(ordered.alias("sibling_ids"))


def parent_store(chunks: DataFrame) -> DataFrame:
    return chunks.where("record_type = 'parent'")


def embedding_children(chunks: DataFrame, flag: str | None = None) -> DataFrame:
    """The children that get a vector: all but those flagged not to."""
    rows = chunks.where("record_type = 'child'")
    return rows if flag is None else rows.where(F.coalesce(F.col(flag), F.lit(True)))


STRATEGIES = ("none", "parent", "siblings", "adaptive")


def expand(hits: DataFrame, parents: DataFrame, strategy: str = "adaptive", siblings: DataFrame | None = None) -> DataFrame:
    """hits (chunk_id, parent_id, chunk_type, rank, and table_parent_id if there are table rows) with context ids in ``context``.

    none: nothing; parent: the parent; siblings: the parent's other children;
    adaptive: the parent, but for a table row its table, and where that is
    missing the parent only if more than one hit (of the query, if hits have a
    query_id) shares it. Missing parents give an empty context. Another strategy
    is an error.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    nothing = F.array().cast("array<string>")
    if strategy == "none":
        return hits.withColumn("context", nothing)
    known = parents.select(F.col("chunk_id").alias("_p")).distinct()
    if strategy == "parent":
        return hits.join(known, F.col("parent_id") == F.col("_p"), "left").withColumn("context", F.when(F.col("_p").isNotNull(), F.array("_p")).otherwise(nothing)).drop("_p")
    if strategy == "siblings":
        if siblings is None:
            raise ValueError("siblings need a sibling store")
        store = siblings.select(F.col("parent_id").alias("_p"), "sibling_ids")
        rows = hits.join(store, F.col("parent_id") == F.col("_p"), "left")
        return rows.withColumn("context", F.coalesce(F.array_remove("sibling_ids", F.col("chunk_id")), nothing)).drop("_p", "sibling_ids")
    table = F.col("table_parent_id") if "table_parent_id" in hits.columns else F.lit(None).cast("string")
    query = ["query_id"] if "query_id" in hits.columns else []
    shared = F.count("parent_id").over(Window.partitionBy(*query, "parent_id"))
    tables = known.withColumnRenamed("_p", "_t")
    rows = hits.withColumn("_table", F.when(F.col("chunk_type") == "table_row", table)).withColumn("_shared", F.when(F.col("parent_id").isNotNull(), shared).otherwise(F.lit(0)))
    rows = rows.join(tables, F.col("_table") == F.col("_t"), "left").join(known, F.col("parent_id") == F.col("_p"), "left")
    wanted = (F.coalesce(F.col("chunk_type"), F.lit("")) != "table_row") | (F.col("_shared") > 1)
    context = F.when(F.col("_t").isNotNull(), F.array("_t")).when(wanted & F.col("_p").isNotNull(), F.array("_p")).otherwise(nothing)
    return rows.withColumn("context", context).drop("_table", "_shared", "_t", "_p")


def within_budget(rows: DataFrame, group: list[str], order: list[str], text: str, most: int, gap: int = 2) -> DataFrame:
    """The leading rows of each group whose texts, with ``gap`` characters between, stay within ``most``; it stops at the first that doesn't fit."""
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("used", F.sum(F.length(text) + gap).over(upto) - gap)
    return run.where(F.col("used") <= most)


def context_block(rows: DataFrame, group: list[str], order: list[str], text: str, mark: str = "E") -> DataFrame:
    """One text a group: its rows in order, each under its number."""
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    parts = F.array_sort(F.collect_list(F.struct("_at", F.concat(F.lit(f"[{mark}"), F.col("_at").cast("string"), F.lit("]\n"), F.col(text)).alias("part"))))
    return numbered.groupBy(*group).agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("context"))


def first_urls(hits: DataFrame, url: str = "url") -> DataFrame:
    """Each url once, in the order of its best rank."""
    return hits.where(F.col(url).isNotNull()).groupBy(url).agg(F.min("rank").alias("rank")).orderBy("rank")


def hybrid(vectors: DataFrame, query: list[float], k: int, key: str, document: str, allowed: DataFrame | None) -> DataFrame:
    """Vector search among the documents a graph query allows; among all if it allows none. Ids are compared in lower case."""
    rows = scored(vectors, query)
    if allowed is None:
        return top_k(rows, k, key)
    ids = allowed.select(F.lower("document_id").alias("_d")).distinct()
    some = ids.agg((F.count(F.lit(1)) > 0).alias("_some"))
    marked = rows.join(ids.withColumn("_in", F.lit(True)), F.lower(F.col(document)) == F.col("_d"), "left").join(F.broadcast(some))  # one row
    return top_k(marked.where(F.coalesce("_in", F.lit(False)) | ~F.col("_some")).drop("_d", "_in", "_some"), k, key)


def require_dimension(vectors: DataFrame, size: int, vector: str = "embedding") -> DataFrame:
    """``vectors``, raising at a vector of another dimension."""
    checked = F.when(F.size(vector) == size, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"a vector isn't of dimension {size} but "), F.size(vector).cast("string"))))
    return vectors.withColumn(vector, checked)


def points_per_document(points: DataFrame) -> DataFrame:
    return points.groupBy(F.lower("document_id").alias("document_id")).agg(F.countDistinct("point_id").alias("points"))
