"""Places where a model is plugged in: embedding, generation, page images, text recognition.

A factory makes the model once in each Python worker; Spark gives it Arrow
batches. The stand-ins here need no model files.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Factory = Callable[[], Callable[[list], list]]
_MADE: dict[str, Callable[[list], list]] = {}


def _model(name: str, factory: Factory) -> Callable[[list], list]:
    if name not in _MADE:
        _MADE[name] = factory()
    return _MADE[name]


def hashing_embedder(dimension: int = 64) -> Factory:
    """Words hashed to signed places, vectors of unit norm (of zeros for a text without words)."""

    def make() -> Callable[[list], list]:
        known: dict[str, tuple[int, float]] = {}

        def place(word: str) -> tuple[int, float]:
            if word not in known:
                if len(known) > 200_000:
                    known.clear()
                h = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
                known[word] = (int(h[:8], 16) % dimension, 1.0 if int(h[8], 16) > 7 else -1.0)
            return known[word]

        def embed(texts: list) -> list:
            out = np.zeros((len(texts), dimension), dtype=np.float32)
            for i, text in enumerate(texts):
                for word in re.findall(r"\w+", (text or "").lower()):
                    at, sign = place(word)
                    out[i, at] += sign
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return list(out / np.where(norms > 0, norms, 1))

        return embed

    return make


def applied(df: DataFrame, key: str, column: str, out: str, kind: str, arrow: pa.DataType, name: str, factory: Factory) -> DataFrame:
    """key and the model's answer for ``column``; a null input is given to the model as it is."""
    key_kind = df.select(F.col(key)).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name, factory)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(batch.column(1).to_pylist()), arrow)], names=["key", "out"])

    return df.select(F.col(key).alias("key"), F.col(column)).mapInArrow(run, f"key {key_kind}, out {kind}").withColumnsRenamed({"key": key, "out": out})


def embed(df: DataFrame, key: str, text: str, dimension: int = 64, name: str = "hashing", factory: Factory | None = None) -> DataFrame:
    """key and vector of unit norm for each text."""
    return applied(df, key, text, "vector", "array<float>", pa.list_(pa.float32()), f"{name}-{dimension}", factory or hashing_embedder(dimension))


def generate(prompts: DataFrame, key: str, prompt: str, name: str, factory: Factory, most: int = 512) -> DataFrame:
    """key, model, answer, latency_sec of each prompt; a prompt of more than ``most`` words isn't cut but raises."""
    checked = prompts.withColumn(prompt, F.when(F.size(F.split(F.col(prompt), r"\s+")) <= most, F.col(prompt)).otherwise(F.raise_error(F.lit("the prompt is longer than the model takes"))))

    def timed() -> Callable[[list], list]:
        inner = factory()

        def run(texts: list) -> list:
            out = []
            for text in texts:
                began = time.perf_counter()
                answer = inner([text])[0]
                out.append({"answer": answer, "latency_sec": time.perf_counter() - began})
            return out

        return run

    rows = applied(checked, key, prompt, "r", "struct<answer:string,latency_sec:double>", pa.struct([("answer", pa.string()), ("latency_sec", pa.float64())]), f"generate-{name}", timed)
    return rows.select(key, F.lit(name).alias("model"), "r.answer", "r.latency_sec")


def page_images(objects: DataFrame, render: Callable[[bytes], list[bytes]]) -> DataFrame:
    """path, page_number (from 1) and image of every page of binary documents, by the given renderer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                images = render(content)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(images)), pa.array(range(1, len(images) + 1), pa.int32()), pa.array(images, pa.binary())], names=["path", "page_number", "image"])

    return objects.select("path", "content").mapInArrow(run, "path string, page_number int, image binary")


def recognise(images: DataFrame, engine: Callable[[bytes], list[dict]], name: str) -> DataFrame:
    """Lines (id, poly, text, score) that an engine reads on page images, with its name; the steps before (deskew, stamps, crops) are the engine's."""
    kind = "array<struct<id:long,poly:array<array<double>>,text:string,score:double>>"
    line = pa.struct([("id", pa.int64()), ("poly", pa.list_(pa.list_(pa.float64()))), ("text", pa.string()), ("score", pa.float64())])
    keyed = images.withColumn("page_key", F.concat_ws("#", "path", F.col("page_number").cast("string")))
    rows = applied(keyed, "page_key", "image", "lines", kind, pa.list_(line), f"ocr-{name}", lambda: lambda pages: [engine(p) for p in pages])
    return rows.select("page_key", F.lit(name).alias("model"), F.explode("lines").alias("l")).select("page_key", "model", "l.*")


def best_reading(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Of several readings the one of the best score; ties by the engine's name, then by the text."""
    return lines.groupBy(*keys).agg(F.max_by(F.struct("text", "model", "score"), F.struct(F.coalesce("score", F.lit(-1.0)), "model", "text")).alias("b")).select(*keys, "b.*")


def http_detector(url: str, seconds: float = 60.0) -> Factory:
    """A client of a layout detection service: each page image is posted, the service answers with the layout as JSON."""

    def make() -> Callable[[list], list]:
        from urllib import request

        def detect(images: list) -> list:
            out = []
            for image in images:
                if image is None:
                    out.append(None)
                    continue
                mark = b"docloom-page"
                body = b"--" + mark + b'\r\nContent-Disposition: form-data; name="file"; filename="page.png"\r\nContent-Type: image/png\r\n\r\n' + image + b"\r\n--" + mark + b"--\r\n"
                asked = request.Request(url, body, {"Content-Type": "multipart/form-data; boundary=docloom-page"})  # noqa: S310 - the address is the caller's
                with request.urlopen(asked, timeout=seconds) as answer:  # noqa: S310
                    out.append(answer.read().decode())
            return out

        return detect

    return make


def layouts(images: DataFrame, name: str, factory: Factory) -> DataFrame:
    """rec_id, page_key and payload (JSON, for ``shred``) of each page image by a detector."""
    keyed = images.withColumn("page_key", F.concat_ws("#", "path", F.col("page_number").cast("string")))
    return applied(keyed, "page_key", "image", "payload", "string", pa.string(), f"layout-{name}", factory).select(F.xxhash64("page_key").alias("rec_id"), "page_key", "payload")


def benchmark(prompts: DataFrame, key: str, prompt: str, models: dict[str, Factory], most: int = 512) -> DataFrame:
    """``generate`` for each model in turn: every prompt has a row of every model."""
    made = [generate(prompts, key, prompt, name, factory, most) for name, factory in models.items()]
    out = made[0]
    for rows in made[1:]:
        out = out.unionByName(rows)
    return out
