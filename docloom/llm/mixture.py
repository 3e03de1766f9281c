"""Problem 8: records of several sources mixed to target shares of all tokens.

Efraimidis-Spirakis sampling: a document of quality weight w gets the key
-ln(u) / w, with u from a hash of its id. Each source's budget is its share of
the largest mixture that the caps on repeats allow; it is filled by complete
epochs of the source and then by the documents of least key until the budget is
met. Prefix sums are taken in two steps, over ranges of keys and within one
range, so no source is ever sorted in one task. Ranges have equal width in
log(key) = log(-ln u) - log w: a weight only moves a document along, so no
weight crowds the documents of a source into one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import tokens
from docloom.session import cut


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """key, source, n_tokens, weight of each document; weight is its lexical variety, from 0.1 to 1.

    Rows without text or source are left out, an empty text has no tokens.
    """
    kind = df.select(F.col(key)).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoding(vocabulary).encode_ordinary
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes = np.fromiter((len(encode(t)) for t in texts), dtype=np.int64, count=len(texts))
            variety = np.empty(len(texts))
            for i, t in enumerate(texts):
                words = t.split()
                variety[i] = len(set(words)) / len(words) if words else 0
            weight = np.clip(np.sqrt(variety), 0.1, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(weight)], names=["key", "source", "n_tokens", "weight"])

    rows = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("t"))
    return rows.where("t is not null and source is not null").mapInArrow(run, f"key {kind}, source string, n_tokens long, weight double").withColumnRenamed("key", key)


def budgets(documents: DataFrame, weights: DataFrame, total: int | None = None) -> DataFrame:
    """One row a source of ``weights``: its tokens, budget, complete epochs and the tokens left for a fraction.

    Shares of sources without tokens are spread over the others in proportion.
    The mixture is the largest at which no source is used more than max_repeats
    times, or ``total`` tokens if that is less.
    """
    have = documents.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    wanted = weights.select("source", F.col("target_share").cast("double").alias("target_share"), F.coalesce(F.col("max_repeats"), F.lit(1)).alias("max_repeats")).where("source is not null").dropDuplicates(["source"])
    rows = wanted.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"))
    live = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    everything = Window.partitionBy(F.lit(1))  # one row a source
    rows = rows.withColumn("share", F.when(live, F.col("target_share") / F.sum(F.when(live, F.col("target_share"))).over(everything)).otherwise(F.lit(0.0)))
    most = F.min(F.when(F.col("share") > 0, F.col("max_repeats") * F.col("tokens") / F.col("share"))).over(everything)
    rows = rows.withColumn("mixture", F.coalesce(most if total is None else F.least(most, F.lit(float(total))), F.lit(0.0)))
    rows = rows.withColumn("budget", F.floor(F.col("share") * F.col("mixture") + F.lit(1e-6)))
    rows = rows.withColumn("epochs", F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.col("max_repeats").cast("long"))).otherwise(F.lit(0)))
    return rows.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0)))


def mix(df: DataFrame, weights: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: int | None = None, seed: int = 17, ranges: int = 4096) -> DataFrame:
    """The selection: key, source, n_tokens, times (how often the document is used, at least 1).

    ``weights`` has source, target_share and max_repeats. Documents without
    source or text, and those of sources without weight, take no part. Ties of
    keys are broken by the id. An empty table gives an empty selection.
    """
    documents = cut(sized(df, key, text, source))
    plan = budgets(documents, weights, total)
    return select(documents, plan, key, seed, ranges)


def select(documents: DataFrame, plan: DataFrame, key: str = "doc_id", seed: int = 17, ranges: int = 4096) -> DataFrame:
    """Documents of ``sized`` by the ``budgets``; see ``mix``. A range is 32 / ``ranges`` wide in log(key) and holds at most 12 / ``ranges`` of a source, whatever the weights."""
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)) + F.lit(1)) / F.lit(float((1 << 52) + 1))
    keyed = documents.withColumn("es_key", -F.log(u) / F.col("weight"))
    keyed = keyed.withColumn("range", F.greatest(F.lit(0), F.least(F.floor((F.log("es_key") + F.lit(26.0)) * (ranges / 32)), F.lit(ranges - 1))).cast("int"))
    sums = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("held"))
    before = sums.withColumn("before", F.sum("held").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    spent = before.join(plan.select("source", "epochs", "rest"), "source").select("source", "range", F.coalesce("before", F.lit(0)).alias("before"), "epochs", "rest")
    within = Window.partitionBy("source", "range").orderBy("es_key", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = keyed.join(spent, ["source", "range"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(within))
    times = F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)
    return run.select(key, "source", "n_tokens", times.cast("int").alias("times")).where("times > 0")


def shares(selection: DataFrame, plan: DataFrame) -> DataFrame:
    """What each source of the weights really got: documents, tokens, share, most repeats, beside its targets."""
    got = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("selected_tokens"), F.count(F.lit(1)).alias("selected_documents"), F.max("times").alias("most_times"))
    rows = plan.join(got, "source", "left").fillna(0, ["selected_tokens", "selected_documents", "most_times"])
    all_of = F.sum("selected_tokens").over(Window.partitionBy(F.lit(1)))  # one row a source
    return rows.select(
        "source", "target_share", F.round("share", 9).alias("reachable_share"), "max_repeats", "tokens", "documents", "selected_documents", "selected_tokens", "most_times", F.round(F.when(all_of > 0, F.col("selected_tokens") / all_of).otherwise(0.0), 9).alias("actual_share"),
    )
