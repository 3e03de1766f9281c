"""Queries of problems 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import containers, mixture
from docloom.session import cut, spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.fill(_documents(spark, sf_dir))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.report(containers.fill(_documents(spark, sf_dir)))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(spread(table(spark, sf_dir, "documents", "doc_id", "text", "source")), table(spark, sf_dir, "source_weights"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = cut(mixture.sized(spread(table(spark, sf_dir, "documents", "doc_id", "text", "source"))))
    plan = mixture.budgets(documents, table(spark, sf_dir, "source_weights"))
    return mixture.shares(mixture.select(documents, plan), plan)


QUERIES = {"p7_packed": p7_packed, "p7_report": p7_report, "p8_mixture": p8_mixture, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
