"""From OCR blocks to validated parent and child chunks, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import ids as I
from docloom.functions import text as X
from docloom.operators import metadata as M
from docloom.operators import packing as P
from docloom.operators import splitters
from docloom.operators import structure as S
from docloom.operators import tables as T
from docloom.session import cut


def units_of(blocks: DataFrame, meta: DataFrame, weights: T.Weights = T.Weights()) -> tuple[DataFrame, DataFrame]:
    """The units of all documents (lines of text and table rows) with their context, and the tables that can't be read."""
    nodes = cut(S.tree(blocks))
    parsed = cut(T.parse_tables(blocks.where("block_type = 'table'").select("key", "raw"), "key", "raw"))
    logical = T.logical_tables(T.continuation_inputs(blocks, parsed, nodes), weights)
    prose = S.units(nodes)
    prose = prose.select("document_id", F.struct(F.col("seq").cast("double").alias("a"), F.lit(0).alias("b")).alias("at"), F.concat_ws(":", F.lit("unit"), "document_id", F.col("ordinal").cast("string")).alias("unit_id"), "unit_type", "primary", "section_path", F.lit(None).cast("long").alias("table_key"), "text", "page_start", "page_end", "blocks")
    places = blocks.where("block_type = 'table'").select("document_id", "key", "block_id", "page")
    above = nodes.where("node_type = 'table'").select("document_id", "block_id", F.col("parent_ordinal").alias("primary"), "section_path", "seq")
    rows = T.row_texts(parsed, "key").join(places, "key").join(logical.select("key", "table_key", "part"), "key").join(above, ["document_id", "block_id"])
    # rows of a later part stand with the first part's section
    first = rows.where("part = 0").select(F.col("table_key").alias("_k"), F.col("primary").alias("_primary"), F.col("section_path").alias("_path")).distinct()
    rows = rows.join(first, F.col("table_key") == F.col("_k"), "left")
    rows = rows.select("document_id", F.struct(F.col("seq").cast("double").alias("a"), (F.col("row_index") + 1).alias("b")).alias("at"), F.concat_ws(":", F.lit("row"), F.col("key").cast("string"), F.col("row_index").cast("string")).alias("unit_id"), F.lit("table_row").alias("unit_type"), F.coalesce("_primary", "primary").alias("primary"), F.coalesce("_path", "section_path").alias("section_path"), "table_key", "text", F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.array("block_id").alias("blocks"))
    about = M.by_id(meta)
    units = prose.unionByName(rows).join(about, F.col("document_id") == F.col("key"), "left").withColumn("context", P.context_lines(F.col("summary"), F.col("doc_no"), F.col("author"), F.col("datedocument"), F.col("section_path")))
    return units.select("document_id", "at", "unit_id", "unit_type", "primary", "section_path", "table_key", "text", "context", "page_start", "page_end", "blocks"), parsed.where("error is not null").select("key", "error")


def build(ocr: DataFrame, meta: DataFrame, budget: P.Budget = P.Budget(), weights: T.Weights = T.Weights()) -> tuple[DataFrame, DataFrame]:
    """parents and children of all documents.

    Children have the retrieval text (context and body) and its token count,
    at most ``budget.most``; parents list their children. Documents without
    metadata have less context. Blocks sent again count once. Cut ``children``
    where they're used more than once.
    """
    blocks = cut(S.indexable(S.blocks_of(ocr)))
    units, _ = units_of(blocks, meta, weights)
    units = cut(units)
    contexts = units.groupBy("document_id", F.array_join("section_path", "\x1f").alias("_path")).agg(F.min("context").alias("context"))
    packs = P.child_chunks(P.pack_units(units, budget)).withColumn("_path", F.array_join("section_path", "\x1f")).join(contexts, ["document_id", "_path"], "left").drop("_path")
    children = packs.withColumn("retrieval_text", P.retrieval_text(F.coalesce("context", F.lit("")), F.col("text"))).withColumn("token_count", X.token_count("retrieval_text"))
    return P.linked(P.parent_chunks(units), children), children


def fallback_chunks(texts: DataFrame, meta: DataFrame, key: str, text: str, budget: P.Budget = P.Budget()) -> DataFrame:
    """Children from plain texts by the first chunker's articles, for documents without blocks; tagged ``v1_fallback``."""
    parts = splitters.articles_v1(texts.withColumn(text, X.clean_v1(text)), key, text)
    rows = parts.join(M.by_id(meta).withColumnRenamed("key", "_k"), F.lower(F.col(key).cast("string")) == F.col("_k"), "left")
    units = rows.select(
        F.col(key).cast("string").alias("document_id"), F.struct(F.col("chunk_index").cast("double").alias("a"), F.lit(0).alias("b")).alias("at"), F.concat_ws(":", F.lit("v1"), F.col(key).cast("string"), F.col("chunk_index").cast("string")).alias("unit_id"), F.col("chunk_type").alias("unit_type"), F.col("chunk_index").alias("primary"), F.array(F.col("chunk_type")).alias("section_path"),
        F.lit(None).cast("long").alias("table_key"), F.col("chunk").alias("text"), P.context_lines(F.col("summary"), F.col("doc_no"), F.col("author"), F.col("datedocument"), F.array("chunk_type")).alias("context"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.array(F.concat(F.lit("txt_"), F.col(key).cast("string"))).alias("blocks"),
    )
    return P.child_chunks(P.pack_units(units, budget)).withColumn("source", F.lit("v1_fallback"))


def by_version(with_blocks: DataFrame, children: DataFrame, fallback: DataFrame | None) -> DataFrame:
    """v2 children where a document has blocks; the fallback's for the others, if it is asked for."""
    if fallback is None:
        return children.withColumn("source", F.lit("v2"))
    have = with_blocks.select(F.lower("document_id").alias("_d")).distinct()
    rest = fallback.join(have, F.lower("document_id") == F.col("_d"), "left_anti")
    return children.withColumn("source", F.lit("v2")).unionByName(rest, allowMissingColumns=True)


def payload(children: DataFrame, meta: DataFrame) -> DataFrame:
    """Flat fields of a point, metadata first, the chunk's own fields over them, as a map of strings."""
    about = M.by_id(meta).withColumnRenamed("key", "_k")
    rows = children.join(about, F.lower("document_id") == F.col("_k"), "left")
    fields = F.map_from_entries(F.array(*(F.struct(F.lit(n), F.col(c).cast("string")) for n, c in (("doc_no", "doc_no"), ("author", "author"), ("summary", "summary"), ("document_id", "document_id"), ("chunk_id", "chunk_id"), ("chunk_index", "chunk_index"), ("chunk_type", "unit_type"), ("page_start", "page_start"), ("page_end", "page_end"), ("token_count", "token_count")))))
    return rows.select("chunk_id", fields.alias("payload"))


def run_summary(children: DataFrame, parents: DataFrame, problems: DataFrame) -> DataFrame:
    """One row a document: counts of chunks, token statistics and PASS or FAIL with the number of broken rules."""
    c = children.groupBy("document_id").agg(F.count(F.lit(1)).alias("children"), F.count_if(F.col("unit_type") == "table_row").alias("table_rows"), F.round(F.avg("token_count"), 4).alias("mean_tokens"), F.max("token_count").alias("max_tokens"), F.count_if(F.col("how").isNotNull()).alias("fallback_splits"))
    p = parents.groupBy("document_id").agg(F.count(F.lit(1)).alias("parents"))
    b = problems.join(children.select("chunk_id", "document_id").distinct(), "chunk_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("broken"))
    rows = c.join(p, "document_id", "full").join(b, "document_id", "left").fillna(0)
    return rows.withColumn("status", F.when(F.col("broken") > 0, "FAIL").otherwise("PASS"))


def markdown(chunks: DataFrame) -> DataFrame:
    """A readable text a document: each chunk under its path."""
    part = F.concat(F.lit("## "), F.array_join("section_path", " > "), F.lit("\n\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", part.alias("part"))))
    return chunks.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("markdown"))


def together(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents and children as one table; columns that one side lacks are null there."""
    return parents.unionByName(children, allowMissingColumns=True)


def debug_json(parents: DataFrame, children: DataFrame, meta: DataFrame) -> DataFrame:
    """document_id and one JSON text for inspection: the document's metadata, statistics, parents and children in order."""
    stats = children.groupBy("document_id").agg(F.count(F.lit(1)).alias("child_count"), F.round(F.avg("token_count"), 4).alias("average_child_tokens"), F.max("token_count").alias("max_child_tokens"), F.count_if(F.coalesce(F.col("how"), F.lit("")) == "token_window").alias("fallback_token_splits"), F.array_sort(F.collect_list(F.struct("chunk_index", *(c for c in children.columns if c not in ("document_id", "chunk_index"))))).alias("children"))
    above = parents.groupBy("document_id").agg(F.count(F.lit(1)).alias("parent_count"), F.array_sort(F.collect_list(F.struct("chunk_id", *(c for c in parents.columns if c not in ("document_id", "chunk_id"))))).alias("parents"))
    about = M.by_id(meta).withColumnRenamed("key", "_k")
    rows = stats.join(above, "document_id", "full").join(about, F.lower("document_id") == F.col("_k"), "left")
    document = F.struct(*(c for c in about.columns if c != "_k"))
    whole = F.struct(document.alias("document"), F.struct(F.coalesce("parent_count", F.lit(0)).alias("parent_count"), F.coalesce("child_count", F.lit(0)).alias("child_count"), "average_child_tokens", "max_child_tokens", "fallback_token_splits").alias("statistics"), "parents", "children")
    return rows.select("document_id", F.to_json(whole).alias("value"))


def points(children: DataFrame, vector: str | None = None) -> DataFrame:
    """id, vector and payload columns of the children that get a vector."""
    cols = ["document_id", "chunk_id", "parent_id", "chunk_index", "unit_type", "retrieval_text", "token_count"]
    return children.select(F.col("chunk_id").alias("id"), *([F.col(vector).alias("vector")] if vector else []), *cols)


def legacy_point_id(document_id, index):
    return I.stable_id(document_id, F.concat(F.lit("chunk-"), index.cast("string")))


def sequence(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` renumbered from 1 within ``by``."""
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
