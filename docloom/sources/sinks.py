"""Writing: tables, texts, run rows, vector collections and graphs, all as folders of parquet or text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.metadata import upsert
from docloom.operators.retrieval import require_dimension

#: names that can't be written, so the first index stays as it was
PROTECTED = ("documents_v1",)


def write_csv(rows: DataFrame, path: str) -> bool:
    """With a header; nothing is written, and False returned, if there are no rows."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    return True


def write_texts(rows: DataFrame, path: str, document: str, text: str, order: list[str]) -> None:
    """One folder a document with its lines in order."""
    rows.repartition(F.col(document)).sortWithinPartitions(document, *order).select(document, F.col(text).alias("value")).write.mode("overwrite").partitionBy(document).text(path)


def append_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def create_collection(spark: SparkSession, root: str, name: str, dimension: int, create: bool = True) -> str:
    """The folder of a vector collection. A protected name, another dimension, or a missing collection that isn't to be made, is an error."""
    if name in PROTECTED:
        raise ValueError(f"{name} is protected")
    path = f"{root}/{name}"
    if _exists(spark, f"{path}/_dimension"):
        have = spark.read.parquet(f"{path}/_dimension").first()["dimension"]
        if have != dimension:
            raise ValueError(f"{name} holds vectors of dimension {have}, not {dimension}")
    elif create:
        spark.createDataFrame([(dimension,)], "dimension int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_dimension")
    else:
        raise ValueError(f"there is no collection {name}")
    return path


def _current(spark: SparkSession, path: str) -> int | None:
    """The version a folder's pointer names; None if there is none."""
    if not _exists(spark, f"{path}/_current"):
        return None
    return max(r.version for r in spark.read.parquet(f"{path}/_current").collect())


def _switch(spark: SparkSession, path: str, version: int) -> None:
    """Makes a written version the one that is read; one small file is added, and only then are versions before the last two removed."""
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{path}/_current")
    jvm = spark.sparkContext._jvm
    for old in range(max(0, version - 4), version - 1):
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}")
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_version(rows: DataFrame, path: str, *parts: str) -> int:
    """Rows as a new version of a folder: written beside the one that is read, which stands until the new one is whole."""
    spark = rows.sparkSession
    version = (_current(spark, path) or 0) + 1
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*parts) if parts else writer).parquet(f"{path}/v{version}")
    _switch(spark, path, version)
    return version


def read_version(spark: SparkSession, path: str) -> DataFrame:
    version = _current(spark, path)
    if version is None:
        raise ValueError(f"nothing was written to {path}")
    return spark.read.parquet(f"{path}/v{version}")


def upsert_points(points: DataFrame, path: str, dimension: int, version: str = "version") -> None:
    """Points (id, vector, further columns, a version) into a collection: of equal ids the newest stays. A run that breaks off leaves the collection as it was."""
    spark = points.sparkSession
    rows = require_dimension(points, dimension, "vector")
    target = f"{path}/points"
    if _current(spark, target) is not None:
        rows = read_version(spark, target).unionByName(rows, allowMissingColumns=True)
    write_version(upsert(rows, ["id"], [version]), target)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return read_version(spark, f"{path}/points")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by label, edges by relation; a run replaces the whole graph."""
    write_version(nodes, f"{path}/nodes", "label")
    write_version(edges, f"{path}/edges", "relation")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_version(spark, f"{path}/nodes"), read_version(spark, f"{path}/edges")


def write_debug(documents: DataFrame, path: str) -> None:
    """One JSON text a document (of ``chunks.debug_json``), as lines of text files."""
    documents.select("value").write.mode("overwrite").text(path)
