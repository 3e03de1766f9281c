"""Documents and events as they arrive: watermarked, de-duplicated, upserted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.metadata import upsert
from docloom.session import checkpoint_dir


def watch(spark: SparkSession, path: str, schema, time: str | None = None) -> DataFrame:
    """A stream of the parquet files a path (a folder, a file or a pattern) names; ``time`` is brought to a timestamp of the session's zone."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows if time is None else rows.withColumn(time, F.col(time).cast("timestamp"))


def once_each(stream: DataFrame, key: list[str], time: str, late: str = "30 days") -> DataFrame:
    """The stream with rows sent again left out, as long as they come within ``late`` of each other."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, time: str, group: str, value: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and group; rows later than ``late`` are left out."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, length), group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), group, "n", "total")


def sessions(stream: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: rows at most ``gap`` apart."""
    rows = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), user, "n")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that is there now, run through the stream and read back from the shared folder."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


#: parts by key of a table that a stream keeps up to date
PARTS = 64


def upsert_into(stream: DataFrame, path: str, key: list[str], newest: list[str], checkpoint: str, parts: int = PARTS):
    """A running query that keeps one row a key, the newest, in a folder; a batch that is run again changes nothing.

    Keys are spread over ``parts`` folders; a batch writes a new version of those
    it touches only. Versions go on from what is there, so a new checkpoint
    doesn't go back over older ones.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")).persist()
        try:
            touched = sorted(r[0] for r in rows.select("_part").distinct().collect())  # at most ``parts``
            have = versions(spark, path)
            for part in touched:
                mine = rows.where(F.col("_part") == part).drop("_part")
                if part in have:
                    mine = spark.read.parquet(f"{path}/part={part}/v={have[part]}").unionByName(mine, allowMissingColumns=True)
                upsert(mine, key, newest).write.mode("overwrite").parquet(f"{path}/part={part}/v={have.get(part, -1) + 1}")
        finally:
            rows.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).start()


def versions(spark: SparkSession, path: str) -> dict[int, int]:
    """The newest whole version of each part of a kept table."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/part=*/v=*/_SUCCESS")) or []
    out: dict[int, int] = {}
    for item in found:
        part, version = (int(x.rpartition("=")[2]) for x in str(item.getPath().getParent()).rsplit("/", 2)[1:])
        out[part] = max(version, out.get(part, -1))
    return out


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a kept table: the newest version of every part."""
    have = versions(spark, path)
    if not have:
        raise ValueError(f"nothing was written to {path}")
    return spark.read.parquet(*(f"{path}/part={part}/v={version}" for part, version in sorted(have.items())))
