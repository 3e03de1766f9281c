"""Detected layout boxes: filters, duplicates, order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G

# Which label wins among duplicates, and which labels are read.
PRIORITY = {"table": 0, "title": 1, "table_caption": 2, "figure_caption": 3, "plain_text": 4, "figure": 5, "abandon": 9}
NOT_READ = ("FIGURE", "ABANDON")
INSIDE_TABLE = ("plain_text", "title", "table_caption", "figure_caption")


def _pages(df: DataFrame, keys: list[str], order: list[str], schema: str, names: list[tuple[str, pa.DataType]], work: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """``work`` on the rows of each page, pages one after the other out of sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, names)], names=[n for n, _ in names])

        for batch in batches:
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in keys):
                    out += work(held)
                    held = []
                held.append(row)
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        yield batch_of(out + (work(held) if held else []))

    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def clusters(boxes: list[list[float]], least: float = 0.9) -> list[int]:
    """The first box of each box's cluster; boxes that overlap by ``least`` of their union, directly or over others, are one cluster."""
    n = len(boxes)
    above = list(range(n))

    def find(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    b = np.asarray(boxes, dtype=float).reshape(-1, 4)
    area = np.clip(b[:, 2] - b[:, 0], 0, None) * np.clip(b[:, 3] - b[:, 1], 0, None)
    for i in range(n - 1):
        wide = np.clip(np.minimum(b[i, 2], b[i + 1 :, 2]) - np.maximum(b[i, 0], b[i + 1 :, 0]), 0, None)
        high = np.clip(np.minimum(b[i, 3], b[i + 1 :, 3]) - np.maximum(b[i, 1], b[i + 1 :, 1]), 0, None)
        shared = wide * high
        whole = area[i] + area[i + 1 :] - shared
        for j in np.flatnonzero((whole > 0) & (shared >= least * whole)):
            a, c = sorted((find(i), find(i + 1 + int(j))))
            above[c] = a
    return [find(i) for i in range(n)]


def clustered(rows: DataFrame, page: list[str], key: str, least: float = 0.9) -> DataFrame:
    """``page`` columns, key and cluster of each row with a box. Each page is worked on alone."""
    kinds = dict(rows.select(*page, key).dtypes)
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names = [(c, arrow[kinds[c]]) for c in [*page, key]] + [("cluster", arrow[kinds[key]])]
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*page, key]) + f", cluster {kinds[key]}"

    def work(held: list[dict]) -> list[tuple]:
        found = clusters([r["bbox"] for r in held], least)
        return [(*(r[c] for c in page), r[key], held[c0][key]) for r, c0 in zip(held, found)]

    return _pages(rows.select(*page, key, "bbox"), page, [key], schema, names, work)


def duplicate_pairs(rows: DataFrame, page: list[str], key: str, least: float = 0.9) -> DataFrame:
    """Pairs of boxes of a page that overlap by ``least`` of their union. Joined within strips of the page's height, so only boxes that may touch meet."""
    strip = F.explode(F.sequence(F.floor(F.greatest(G.side("bbox", 1), F.lit(0.0)) / 256), F.floor(F.greatest(G.side("bbox", 3), G.side("bbox", 1), F.lit(0.0)) / 256)))
    a = rows.select(*page, F.col(key).alias("a"), F.col("bbox").alias("box_a")).join(rows.select(*page, F.col(key).alias("a"), strip.alias("strip")), [*page, "a"])
    b = rows.select(*page, F.col(key).alias("b"), F.col("bbox").alias("box_b")).join(rows.select(*page, F.col(key).alias("b"), strip.alias("strip")), [*page, "b"])
    return a.join(b, [*page, "strip"]).where(F.col("a") < F.col("b")).where(G.iou("box_a", "box_b") >= least).select(*page, "a", "b").distinct()


def standardise(blocks: DataFrame, pages: DataFrame, least_area: float = 200, least: float = 0.9, drop_inside: bool = True) -> DataFrame:
    """Boxes of the detector as numbered, clean blocks of a page.

    ``blocks``: rec_id, page_pos, block_path, label, block_index, score, bbox;
    ``pages``: rec_id, page_pos, width, height. Boxes are clipped to the page,
    small and abandoned ones dropped, of duplicates the best label and score is
    kept, and text inside a table goes with the table.
    """
    page = ["rec_id", "page_pos"]
    rows = blocks.where("bbox is not null").join(pages.select(*page, "width", "height").where("width > 0 and height > 0"), page)
    rows = rows.withColumn("bbox", F.transform(G.clip("bbox", F.col("width"), F.col("height")), lambda x: x.cast("double"))).withColumn("kind", F.regexp_replace(F.lower(F.coalesce("label", F.lit("plain text"))), "[ -]", "_"))
    rows = rows.where((G.area("bbox") >= least_area) & (F.col("kind") != "abandon"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*page).orderBy("block_path")))
    rank = F.lit(99)
    for label, value in PRIORITY.items():
        rank = F.when(F.col("kind") == label, F.lit(value)).otherwise(rank)
    joined = rows.join(clustered(rows, page, "at", least), [*page, "at"])
    best = Window.partitionBy(*page, "cluster").orderBy(rank, F.coalesce("score", F.lit(1.0)).desc(), "at")
    kept = joined.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    if drop_inside:
        tables = kept.where("kind = 'table'").select(*page, F.col("bbox").alias("table_box"))
        held = F.exists("_tables", lambda t: G.contains(t, "bbox", 0.9))
        grouped = tables.groupBy(*page).agg(F.collect_list("table_box").alias("_tables"))
        kept = kept.join(grouped, page, "left").where(~(F.col("kind").isin(*INSIDE_TABLE) & F.coalesce(held, F.lit(False)))).drop("_tables")
    order = Window.partitionBy(*page).orderBy(F.coalesce("block_index", F.lit(10**9)), G.side("bbox", 1), G.side("bbox", 0), "at")
    return kept.select(*page, "block_path", F.row_number().over(order).alias("id"), F.upper("kind").alias("label"), "score", "bbox", (~F.upper("kind").isin(*NOT_READ)).alias("ocr"))


def text_boxes(rows: DataFrame, poly: str = "poly", score: str = "score", least_score: float = 0.0, width: float = 2480, height: float = 3508) -> DataFrame:
    """Detected text boxes worth reading: by score, size (25 to any width, 12 to 260 high, 300 in area) and not along a margin."""
    box = G.polygon_box(poly)
    out = rows.where(F.col(poly).isNotNull()).withColumn("bbox", box)
    w, h = G.side("bbox", 2) - G.side("bbox", 0), G.side("bbox", 3) - G.side("bbox", 1)
    edge = (G.side("bbox", 0) < 8) | (G.side("bbox", 1) < 8) | (width - G.side("bbox", 2) < 8) | (height - G.side("bbox", 3) < 8)
    return out.where((F.coalesce(F.col(score), F.lit(1.0)) >= least_score) & (w >= 25) & (h >= 12) & (h <= 260) & (w * h >= 300) & ~(edge & ((w > 0.85 * width) | (h > 0.85 * height))))


def reading_lines(rows: DataFrame, page: list[str], key: str, tolerance: float = 18) -> DataFrame:
    """``page`` columns, key, line and place on the line: a box joins the line whose first box is at most ``tolerance`` above it."""
    kinds = dict(rows.select(*page, key).dtypes)
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names = [(c, arrow[kinds[c]]) for c in [*page, key]] + [("line", pa.int32()), ("place", pa.int32())]

    def work(held: list[dict]) -> list[tuple]:
        lines: list[list[dict]] = []
        for row in sorted(held, key=lambda r: (r["bbox"][1], r["bbox"][0])):
            if not lines or abs(row["bbox"][1] - lines[-1][0]["bbox"][1]) > tolerance:
                lines.append([])
            lines[-1].append(row)
        return [(*(r[c] for c in page), r[key], i, j) for i, line in enumerate(lines) for j, r in enumerate(sorted(line, key=lambda r: r["bbox"][0]))]

    return _pages(rows.select(*page, key, "bbox"), page, [key], ", ".join(f"{c} {kinds[c]}" for c in [*page, key]) + ", line int, place int", names, work)
