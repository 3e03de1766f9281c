"""Splitters of plain text: by article, by fixed windows, by size, recursively; and logical spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Where an article begins in the first chunker; sizes of the second.
ARTICLE = r"Điều\s+\d+\s*:"
LONG, SHORT = 3000, 200
MAX_CHARS, MIN_CHARS, OVERLAP_WORDS = 1024, 200, 40
BLANK = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}"
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", "; ", ", ", " ")


def _bare(column):
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def articles_v1(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk_index, chunk_type (dieu, header), chunk: cut before each article; an article beyond 3000 characters by blank lines.

    Pieces of a long article of up to 200 characters are dropped, as in the first chunker.
    """
    parts = df.select(key, F.posexplode(F.split(F.col(text), f"(?={ARTICLE})")).alias("i", "part")).withColumn("part", _bare("part")).where("part <> ''")
    pieces = F.when(F.length("part") > LONG, F.filter(F.transform(F.split("part", r"\n{2,}"), _bare), lambda x: F.length(x) > SHORT)).otherwise(F.array("part"))
    rows = parts.select(key, "i", "part", F.posexplode(pieces).alias("j", "chunk"))
    kind = F.when(F.col("part").startswith("Điều"), "dieu").otherwise("header")
    at = F.row_number().over(Window.partitionBy(key).orderBy("i", "j")) - 1
    return rows.select(key, at.alias("chunk_index"), kind.alias("chunk_type"), "chunk")


def fixed(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` words, each beginning ``size - overlap`` words after the last; the last one ends the text."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap has to be less than the size")
    step = size - overlap
    words = df.select(key, F.regexp_extract_all(F.col(text), F.lit(f"([^{BLANK}]+)"), F.lit(1)).alias("w")).where(F.size("w") > 0)
    count = F.when(F.size("w") <= size, F.lit(1)).otherwise(F.ceil((F.size("w") - size) / F.lit(float(step))).cast("int") + 1)
    at = words.select(key, "w", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    return at.select(key, "chunk_index", F.array_join(F.slice("w", F.col("chunk_index") * step + 1, size), " ").alias("chunk"))


def spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each line that isn't blank with its place: span_index, start_char, end_char (exclusive), span."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("span_index", "span"))
    upto = Window.partitionBy(key).orderBy("span_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = (F.sum(F.length("span") + 1).over(upto) - 1).cast("int")
    placed = lines.withColumn("end_char", end).withColumn("start_char", F.col("end_char") - F.length("span"))
    return placed.where(F.trim("span") != "").select(key, "span_index", "start_char", "end_char", "span")


def in_python(df: DataFrame, key: str, text: str, split: Callable[[str], list[str]]) -> DataFrame:
    """key, chunk_index, chunk by a Python splitter, in Arrow batches. Null texts give nothing."""
    kind = df.select(F.col(key)).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, made = [], [], []
            for row, whole in enumerate(batch.column(1).to_pylist()):
                for i, piece in enumerate(split(whole)):
                    rows.append(row)
                    index.append(i)
                    made.append(piece)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(index, pa.int32()), pa.array(made, pa.string())], names=["key", "chunk_index", "chunk"])

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).where("t is not null")
    return source.mapInArrow(run, f"key {kind}, chunk_index int, chunk string").withColumnRenamed("key", key)


# The lines at which the second chunker cuts.
_SECTION = re.compile(r"^(?=(?:Chương\s+[IVXLC]+|Mục\s+\d+|Điều\s+\d+)\s*[:.]?)", re.IGNORECASE | re.MULTILINE)
_CLAUSE = re.compile(r"^(?=\s*\d+\.\s)", re.MULTILINE)


def _line_runs(text: str, most: int, overlap: int) -> list[str]:
    """Whole lines together as far as ``most`` characters go; each run begins with the last words of the one before. A longer line stays whole."""
    out: list[str] = []
    held: list[str] = []
    for line in filter(None, map(str.strip, text.splitlines())):
        if held and sum(len(x) + 1 for x in held) + len(line) + 1 > most + bool(out):
            out.append(" ".join(held))
            held = [" ".join(out[-1].split()[-overlap:])] if overlap else []
        held.append(line)
    return [*out, " ".join(held)] if held else out


def by_size(text: str, most: int = MAX_CHARS, least: int = MIN_CHARS, overlap: int = OVERLAP_WORDS) -> list[str]:
    """Sections; where one is too long its clauses; where one of these is, runs of lines. A small piece joins the one before if both fit."""
    out: list[str] = []
    for section in _SECTION.split(re.sub(r"\n{2,}", "\n", text).strip()):
        parts = [section] if len(section.strip()) <= most else _CLAUSE.split(section)
        for part in filter(None, map(str.strip, parts)):
            for piece in [part] if len(part) <= most else _line_runs(part, most, overlap):
                if out and len(piece) < least and len(out[-1]) + 1 + len(piece) <= most:
                    out[-1] = f"{out[-1].rstrip()} {piece}"
                else:
                    out.append(piece)
    return out


def sized(df: DataFrame, key: str, text: str) -> DataFrame:
    return in_python(df, key, text, by_size)


def recursively(text: str, most: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Cut at the coarsest separator that helps, finer ones for pieces still too long; neighbours are joined up to ``most``. Nothing but separators is lost."""
    if len(text) <= most:
        return [text] if text.strip() else []
    for depth, separator in enumerate(separators):
        if separator in text:
            parts = [p for part in text.split(separator) for p in recursively(part, most, separators[depth + 1 :])]
            break
    else:
        return [text[i : i + most] for i in range(0, len(text), most)]
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(separator) + len(part) <= most:
            out[-1] += separator + part
        else:
            out.append(part)
    return out


def recursive(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    return in_python(df, key, text, lambda t: recursively(t, most))


def semantic(sentences: DataFrame, key: str, order: str, text: str, vector: str, share: float = 0.95) -> DataFrame:
    """Sentences joined until the distance to the next is above a percentile of the document's distances."""
    from docloom.operators.retrieval import cosine

    by = Window.partitionBy(key).orderBy(order)
    following = F.lead(vector).over(by)
    rows = sentences.withColumn("_d", F.when(following.isNotNull(), 1 - cosine(F.col(vector), following)))
    bars = rows.groupBy(key).agg(F.percentile("_d", F.lit(share)).alias("_bar"))
    marked = rows.join(bars, key).withColumn("_break", F.coalesce((F.lag("_d").over(by) > F.col("_bar")).cast("int"), F.lit(0)))
    grouped = marked.withColumn("chunk_index", F.sum("_break").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return grouped.groupBy(key, "chunk_index").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("chunk"))


def packed(pieces: DataFrame, key: str, order: str, text: str, least: int, most: int) -> DataFrame:
    """key, chunk_index, chunk, n_tokens: pieces (of ``semantic``) of at least ``least`` tokens where that is possible within ``most``.

    A piece beyond ``most`` is cut at its separators, and a run without any by
    words; a piece below ``least`` joins the one before if both fit.
    """
    from docloom.operators.packing import count_tokens, windows

    kind = pieces.select(F.col(key)).dtypes[0][1]

    def cut_up(whole: str) -> list[str]:
        if count_tokens(whole) <= most:
            return [whole] if whole.strip() else []
        for separator in SEPARATORS:
            parts = [p for p in whole.split(separator) if p.strip()]
            if len(parts) > 1:
                out: list[str] = []
                for part in (p for x in parts for p in cut_up(x)):
                    if out and count_tokens(out[-1]) + count_tokens(separator) + count_tokens(part) <= most:
                        out[-1] += separator + part
                    else:
                        out.append(part)
                return out
        return windows(whole, most, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(owner: object, texts: list[str]) -> list[tuple]:
            out: list[str] = []
            for piece in (p for t in texts for p in cut_up(t)):
                small = out and (count_tokens(piece) < least or count_tokens(out[-1]) < least)
                if small and count_tokens(out[-1]) + count_tokens(piece) <= most:
                    out[-1] = f"{out[-1]} {piece}"
                else:
                    out.append(piece)
            return [(owner, i, p, count_tokens(p)) for i, p in enumerate(out)]

        def batch_of(rows: list[tuple], owners: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (owners, pa.int32(), pa.string(), pa.int32()))], names=["key", "chunk_index", "chunk", "n_tokens"])

        current, held, made, owners = None, [], [], pa.string()
        for batch in batches:
            owners = batch.schema.field(0).type
            for owner, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and owner != current:
                    made += close(current, held)
                    held = []
                current = owner
                held.append(piece)
            if len(made) > 5000:
                yield batch_of(made, owners)
                made = []
        yield batch_of(made + (close(current, held) if held else []), owners)

    width = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t"), F.col(order).alias("o")).repartition(width, "key").sortWithinPartitions("key", "o").select("key", "t")
    return rows.mapInArrow(run, f"key {kind}, chunk_index int, chunk string, n_tokens int").withColumnRenamed("key", key)
