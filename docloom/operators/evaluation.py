"""Measures of recognition, of retrieval and of boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X


def sequence_distance(left: Column, right: Column) -> Column:
    """Edit distance of two arrays, item by item; null counts as empty.

    Each different item of a row becomes one character, so the distance of
    strings does the rest in the JVM.
    """
    a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in (left, right))
    items = F.array_distinct(F.concat(a, b))
    index = F.map_from_arrays(items, F.sequence(F.lit(1), F.size(items)))
    coded = lambda c: F.array_join(F.transform(c, lambda x: F.decode(F.unhex(F.lpad(F.hex(F.element_at(index, x) + 0xFFFF), 8, "0")), "UTF-32")), "")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.greatest(F.size(a), F.size(b))).otherwise(F.levenshtein(coded(a), coded(b)))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def recognition(pairs: DataFrame, group: list[str], truth: str = "truth", read: str = "read") -> DataFrame:
    """Character and word error rates over all lines (sum of distances by sum of lengths) and the share of equal lines.

    Texts are compared as given; bring both into one form first. Null counts as empty.
    """
    a, b = F.coalesce(F.col(truth), F.lit("")), F.coalesce(F.col(read), F.lit(""))
    rows = pairs.select(*group, a.alias("a"), b.alias("b")).withColumn("wa", X.words("a")).withColumn("wb", X.words("b"))
    rows = rows.select(*group, "a", "b", F.levenshtein("a", "b").alias("d"), F.length("a").alias("n"), sequence_distance(F.col("wa"), F.col("wb")).alias("wd"), F.size("wa").alias("wn"))
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("lines"), F.round(_ratio(F.sum("d"), F.sum("n")), 6).alias("cer"), F.round(_ratio(F.sum("wd"), F.sum("wn")), 6).alias("wer"), F.round(F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)), 6).alias("line_accuracy")
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared items by all items of two arrays, 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def ranking(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: hit, recall, reciprocal rank, nDCG and average precision at k.

    ``hits``: query_id, item, rank (from 1); ``relevant``: query_id, item. A
    query without relevant items or hits gets zeros.
    """
    totals = relevant.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    marked = hits.where(F.col("rank") <= k).join(relevant.distinct().withColumn("rel", F.lit(1)), ["query_id", "item"], "left").fillna(0, ["rel"])
    return judged(marked, totals, k)


def judged(marked: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """``ranking`` of hits (query_id, rank from 1, rel 0 or 1) already held against what is relevant; ``totals``: query_id, total."""
    running = marked.withColumn("found", F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank")))
    got = running.groupBy("query_id").agg(
        F.max("rel").alias("hit"), F.sum("rel").alias("n"), F.max(F.when(F.col("rel") == 1, 1 / F.col("rank"))).alias("mrr"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.when(F.col("rel") == 1, F.col("found") / F.col("rank")).otherwise(0.0)).alias("ap")
    )
    most = F.least(F.col("total"), F.lit(k)).cast("int")
    ideal = F.when(most > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))
    zero = F.lit(0.0)
    share = lambda top, bottom: F.round(F.coalesce(F.when(bottom > 0, top / bottom), zero), 6)
    return totals.join(got, "query_id", "full").select(
        "query_id", F.coalesce("hit", F.lit(0)).alias("hit"), share(F.col("n"), F.col("total")).alias("recall"), F.round(F.coalesce("mrr", zero), 6).alias("mrr"), share(F.col("dcg"), ideal).alias("ndcg"), share(F.col("ap"), most).alias("map"),
    )


def boundaries(gold: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """Precision, recall, F1 and the share of false splits of predicted boundaries (rows of ``key``)."""
    both = gold.select(*key).distinct().withColumn("g", F.lit(1)).join(predicted.select(*key).distinct().withColumn("p", F.lit(1)), key, "full")
    n = both.agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(_ratio(2 * p * r, p + r), 6).alias("f1"), F.round(_ratio(F.col("fp"), F.col("tp") + F.col("fp")), 6).alias("false_split_rate"))


def length_statistics(rows: DataFrame, group: list[str], column: str) -> DataFrame:
    """Count, mean, population deviation, extremes and interpolated percentiles of a length."""
    q = F.percentile(column, F.array(*(F.lit(x) for x in (0.5, 0.75, 0.9, 0.95, 0.99))))
    stats = rows.groupBy(*group).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("least"), F.max(column).alias("most"), q.alias("q"))
    return stats.select(*group, "n", "mean", "std", "least", "most", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((50, 75, 90, 95, 99))))


def ranked_report(rates: DataFrame, *by: str) -> DataFrame:
    """Error rates with their place, the least first: ordered by the numbers, not by their written form."""
    return rates.withColumn("place", F.row_number().over(Window.orderBy(*by)))  # a row an engine or type
