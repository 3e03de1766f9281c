"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import names
from docloom.session import table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "extract_entites").select(F.col("name_key").alias("key"), "recordid", "name")
    typed = table(spark, sf_dir, "embbeding").select(F.col("name_key").alias("key"), "recordid", F.col("author").alias("name"))
    return found.unionByName(typed)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs(_rows(spark, sf_dir))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.link(_rows(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes}
SQL: dict[str, str] = {}
