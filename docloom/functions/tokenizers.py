"""Adapters of model tokenizers: how much a model takes, flat token ids, counts and splits in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MADE: dict[str, Callable[[str], object]] = {}
#: a length beyond which a tokenizer only says that it has no limit
NO_LIMIT = 1_000_000


def flat_ids(value: object) -> list[int]:
    """Token ids as a flat list of numbers, from a list, a tuple, an array or the one-row batch of any of these."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    try:
        items = list(value)  # type: ignore[call-overload]
    except TypeError as problem:
        raise ValueError("token ids come as a list") from problem
    if items and isinstance(items[0], (list, tuple)):
        items = list(items[0])
    return [int(x) for x in items]


def longest_input(*stated: int | None, default: int = 256) -> int:
    """The first stated length that is a real limit (model, then tokenizer, then position table), else the default."""
    return next((int(n) for n in stated if n is not None and 0 < int(n) < NO_LIMIT), default)


def token_counts(df: DataFrame, key: str, text: str, name: str, factory: Callable[[], Callable[[str], object]], extra: int = 0) -> DataFrame:
    """key and n_tokens by a model's tokenizer, made once in each worker; a null text has null."""
    kind = df.select(F.col(key)).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MADE:
            _MADE[name] = factory()
        encode = _MADE[name]
        for batch in batches:
            counts = [None if t is None else len(flat_ids(encode(t))) + extra for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=["key", "n_tokens"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, n_tokens int").withColumnRenamed("key", key)


def require_fit(counted: DataFrame, most: int, policy: str = "fail") -> DataFrame:
    """Rows with ``compatible`` (n_tokens within ``most``). ``fail`` raises at one that isn't, ``mark`` only tells; nothing is ever cut off silently."""
    if policy not in ("fail", "mark"):
        raise ValueError("the policy is fail or mark")
    fits = F.coalesce(F.col("n_tokens"), F.lit(0)) <= most
    if policy == "fail":
        fits = F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit(f"more than the {most} tokens the model takes: "), F.col("n_tokens").cast("string"))))
    return counted.withColumn("compatible", fits)
