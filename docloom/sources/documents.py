"""Reading OCR documents, metadata, prompts and relational tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import ids as I
from docloom.operators import shred

# Fixed value: the columns of the metadata extract, all text.
METADATA_COLUMNS = "Id KeyFileId Page No Author Summary DateDocument RecordId RecordCode RecordName RecordTypeCode RecordTypeName BoxCode TableOfContentCode TableOfContentName DocumentBlockCode DocumentBlockName OrganizationId FileIdMinio FileNameMinio FilePathMinio".split()


def discover(spark: SparkSession, path: str, pattern: str = "*.json", recursive: bool = False, limit: int | None = None) -> DataFrame:
    """file_path and stem of the files under a folder, by name without regard to case; with ``limit`` the first ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select(F.col("path").alias("file_path"))
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", "")
    rows = files.select("file_path", stem.alias("stem")).orderBy(F.lower("file_path"))
    return rows if limit is None else rows.limit(limit)


def read_json(spark: SparkSession, path: str, pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """rec_id, stem and payload of each JSON file, read whole; unreadable ones are told by ``shred.unreadable``."""
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).text(path).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file_path"))
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", "")
    return texts.select(F.xxhash64("file_path").alias("rec_id"), F.lower(stem).alias("stem"), "payload")


def ocr_blocks(documents: DataFrame, document: str = "stem") -> DataFrame:
    """OCR documents (rec_id, a document id, payload) as rows of the block schema.

    Field names come under all their aliases; page numbers are read from
    ``page_001`` too; boxes are scaled to 0..1 where the page's size is known and
    they aren't already.
    """
    shredded = shred.shred(documents)
    blocks, pages = shred.block_table(shredded), shred.page_table(shredded).select("rec_id", "page_pos", "page_number", "width", "height")
    names = documents.select("rec_id", F.col(document).alias("document_id")).dropDuplicates(["rec_id"])
    rows = blocks.join(pages, ["rec_id", "page_pos"]).join(names, "rec_id")
    scaled = F.when((F.col("width") > 0) & (F.col("height") > 0) & (F.greatest(F.abs(F.col("bbox")[0]), F.abs(F.col("bbox")[2])) > 1), F.array(F.col("bbox")[0] / F.col("width"), F.col("bbox")[1] / F.col("height"), F.col("bbox")[2] / F.col("width"), F.col("bbox")[3] / F.col("height"))).otherwise(F.col("bbox"))
    place = F.coalesce(F.col("block_index"), F.element_at(F.split("block_path", r"\."), -1).cast("int") + 1)
    return rows.select(
        F.xxhash64("rec_id", "page_pos", "block_path").alias("block_key"), "document_id", F.col("page_number").cast("int").alias("page_number"), place.alias("block_index"), F.coalesce("label", F.lit("text")).alias("block_type"), scaled.alias("bbox"), F.array_join("texts", "\n").alias("content_raw"), I.block_id("page_number", place).alias("block_id")
    )


def resolve_paths(meta: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """Each document id with the file its stem names: as written, else in capitals, else in small letters; null if there is none."""
    ids = meta.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "").select(F.trim(F.col(key)).alias("document_id")).distinct()
    joined = ids.join(files.select("file_path", "stem"), F.lower("document_id") == F.lower("stem"), "left")
    rank = F.when(F.col("stem") == F.col("document_id"), 0).when(F.col("stem") == F.upper("document_id"), 1).when(F.col("stem") == F.lower("document_id"), 2).otherwise(3)
    return joined.groupBy("document_id").agg(F.min_by("file_path", F.struct(rank, "file_path")).alias("file_path"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata extract from CSV: every column text, names in any case, columns under their lower-case names (no as doc_no)."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    have = {c.lstrip("﻿").lower(): c for c in raw.columns}
    named = {"No": "doc_no"}
    return raw.select(*((F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None).cast("string")).alias(named.get(c, c.lower())) for c in METADATA_COLUMNS))


def metadata_override(spark: SparkSession, path: str) -> DataFrame:
    """One metadata object for a single document; raises if it has no Id."""
    row = spark.read.option("multiLine", True).schema(T.StructType([T.StructField(c, T.StringType()) for c in METADATA_COLUMNS])).json(path)
    return row.withColumn("Id", F.when(F.trim(F.coalesce("Id", F.lit(""))) != "", F.col("Id")).otherwise(F.raise_error(F.lit("a metadata override needs an Id"))))


def read_table(spark: SparkSession, query: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A query of the relational store; its address and login come from DOCLOOM_JDBC_URL, _USER and _PASSWORD.

    ``partition`` is (column, lowest, highest, parts) to read in parallel.
    """
    reader = spark.read.format("jdbc").option("url", os.environ["DOCLOOM_JDBC_URL"]).option("user", os.environ.get("DOCLOOM_JDBC_USER", "")).option("password", os.environ.get("DOCLOOM_JDBC_PASSWORD", ""))
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, parts = partition
    return reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def read_objects(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length and content of objects in a store that Hadoop can read (s3a, abfs, hdfs, file)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def objects_of(rows: DataFrame, objects: DataFrame, name: Column) -> DataFrame:
    """Rows with the object their name ends in, and whether it is there."""
    known = objects.select(F.col("path").alias("_path"), F.element_at(F.split("path", "/"), -1).alias("_name"))
    joined = rows.join(known, F.element_at(F.split(name, "/"), -1) == F.col("_name"), "left")
    return joined.withColumn("found", F.col("_path").isNotNull()).withColumnRenamed("_path", "object_path").drop("_name")


def read_recognition(spark: SparkSession, path: str) -> DataFrame:
    """Recogniser results (arrays of lines) as id, poly, text, model, score; a missing text is empty, of equal ids the last stands."""
    schema = "id long, poly array<array<double>>, text string, model string, score double"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("_at", F.monotonically_increasing_id())
    return rows.groupBy("id").agg(*(F.max_by(c, "_at").alias(c) for c in ("poly", "model", "score")), F.coalesce(F.max_by("text", "_at"), F.lit("")).alias("text"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Templates as whole texts, with their path."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("prompt_path"), F.col("value").alias("template"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of language model runs."""
    return spark.read.schema("model string, prompt_path string, input_tokens long, generated_tokens long, latency_sec double, answer string, gen_kwargs map<string,string>").json(path)


def with_names(rows: DataFrame) -> DataFrame:
    """Rows of a source that gives no column names, or blank ones, under col1, col2, …"""
    return rows.toDF(*(f"col{i}" if not name.strip() or name == f"_c{i - 1}" else name for i, name in enumerate(rows.columns, 1)))


def object_store(spark: SparkSession) -> bool:
    """Points Hadoop's s3a files at the store named by DOCLOOM_S3_ENDPOINT, _ACCESS_KEY, _SECRET_KEY and _SECURE; False, and nothing done, without an endpoint."""
    endpoint = os.environ.get("DOCLOOM_S3_ENDPOINT")
    if not endpoint:
        return False
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    settings = {"endpoint": endpoint, "access.key": os.environ.get("DOCLOOM_S3_ACCESS_KEY", ""), "secret.key": os.environ.get("DOCLOOM_S3_SECRET_KEY", ""), "path.style.access": "true", "connection.ssl.enabled": os.environ.get("DOCLOOM_S3_SECURE", "false").lower()}
    for name, value in settings.items():
        conf.set(f"fs.s3a.{name}", value)
    return True


def download_report(rows: DataFrame) -> DataFrame:
    """Of rows of ``objects_of``: how many there are, and how many objects were and weren't found."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("missing"))
