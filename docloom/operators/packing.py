"""Text units packed under a token budget, and the chunks made of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import ids as I
from docloom.functions import text as X

TOKEN = re.compile(r"\w+|[^\w\s]")
HEADING = "Nội dung:"


@dataclass(frozen=True)
class Budget:
    """Tokens of a chunk at most, of these kept free; tokens repeated by the last resort; whether a table row stands alone."""

    most: int = 256
    margin: int = 16
    overlap: int = 20
    extra: int = 2
    least: int = 3
    single_rows: bool = True

    @property
    def room(self) -> int:
        if self.most - self.margin <= 0:
            raise ValueError("the margin leaves no room")
        return self.most - self.margin


def count_tokens(text: str) -> int:
    return len(TOKEN.findall(text))


_PARAGRAPH = re.compile(r"\n\s*\n|(?=^\s*\d+[.)]\s+)|(?=^\s*[a-zđ][.)]\s+)", re.MULTILINE)
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+(?=[A-ZÀ-Ỹ0-9])")


def semantic_parts(text: str) -> tuple[list[str], str]:
    """Paragraphs or items if there are several, else sentences if there are several."""
    for rule, name in ((_PARAGRAPH, "paragraph"), (_SENTENCE, "sentence")):
        parts = [p.strip() for p in rule.split(text) if p and p.strip()]
        if len(parts) > 1:
            return parts, name
    return [text.strip()], "none"


def windows(text: str, room: int, overlap: int) -> list[str]:
    """Runs of at most ``room`` tokens of the text, each beginning with the last tokens of the one before."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    if room < 1:
        raise ValueError("the context leaves no room for text")
    step = max(1, room - min(overlap, room - 1))
    out, at = [], 0
    while spans:
        end = min(len(spans), at + room)
        out.append(text[spans[at][0] : spans[end - 1][1]])
        if end == len(spans):
            break
        at += step
    return out


def fit(text: str, room: int, overlap: int) -> list[tuple[str, str]]:
    """The text in pieces of at most ``room`` tokens, with how they were cut: not at all, by meaning, or by window."""
    if count_tokens(text) <= room:
        return [(text, "")]
    parts, how = semantic_parts(text)
    if len(parts) == 1:
        return [(p, "token_window") for p in windows(text, room, overlap)]
    out = []
    for part in parts:
        out += [(part, how)] if count_tokens(part) <= room else [(p, "token_window") for p in windows(part, room, overlap)]
    return out


def pack(units: list[dict], budget: Budget, count: Callable[[str], int] = count_tokens) -> list[list[dict]]:
    """Neighbouring units of one parent, type, path and table together, as many as fit with their context.

    Tokens never span the blank lines between units, so a pack's count is that of
    the context, of the heading before the text and of its units; with another
    tokenizer give its ``count``.
    """
    out: list[list[dict]] = []
    room, held, last = 0, 0, None
    for unit in units:
        free = budget.room - budget.extra - count(unit["context"]) - (count(HEADING) if unit["text"].strip() else 0)
        for at, (piece, how) in enumerate(fit(unit["text"], free, budget.overlap)):
            size = count(piece)
            same = (unit["primary"], unit["unit_type"], unit["path"], unit["table_key"])
            alone = budget.single_rows and unit["unit_type"] == "table_row"
            item = {**unit, "text": piece, "how": how, "unit_id": f"{unit['unit_id']}:{how}:{at}" if how else unit["unit_id"]}
            if not out or alone or same != last or held + size > room:
                out.append([item])
                held, room = 0, free
            else:
                out[-1].append(item)
            held += size
            last = None if alone else same
    return out


def context_lines(summary: Column, number: Column, author: Column, date: Column, path: Column) -> Column:
    """The lines that stand before a chunk's text; a blank field gives none."""
    line = lambda label, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(label + ": "), F.trim(c)))
    joined = F.array_join(F.filter(F.transform(path, lambda y: F.trim(y)), lambda x: x != ""), " > ")
    return F.concat_ws("\n", line("Văn bản", summary), line("Số", number), line("Cơ quan ban hành", author), line("Ngày", date), line("Phần", joined))


def retrieval_text(context: Column, body: Column) -> Column:
    text = F.trim(F.coalesce(body, F.lit("")))
    return F.when(text == "", context).otherwise(F.concat_ws("\n", F.nullif(context, F.lit("")), F.lit(""), F.lit(HEADING), text))


PACKED = "document_id string, chunk_index int, unit_type string, primary int, section_path array<string>, table_key long, text string, how string, page_start int, page_end int, blocks array<string>, unit_ids array<string>"


def pack_units(units: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Packs of each document, in order.

    ``units``: document_id, at (a sortable order), unit_id, unit_type, primary,
    section_path, table_key (null but for table rows), text, context, page_start,
    page_end, blocks. The fold needs a document's units in order, in one stream.
    """
    strings = pa.list_(pa.string())
    types = (pa.string(), pa.int32(), pa.string(), pa.int32(), strings, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), strings, strings)
    names = ["document_id", "chunk_index", "unit_type", "primary", "section_path", "table_key", "text", "how", "page_start", "page_end", "blocks", "unit_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[dict]) -> list[tuple]:
            made = []
            for i, group in enumerate(pack(rows, budget)):
                first = group[0]
                hows = [g["how"] for g in group if g["how"]]
                made.append((first["document_id"], i, first["unit_type"], first["primary"], first["section_path"], first["table_key"], "\n\n".join(g["text"] for g in group if g["text"]), hows[-1] if hows else None, min(g["page_start"] for g in group), max(g["page_end"] for g in group), list(dict.fromkeys(b for g in group for b in g["blocks"])), [g["unit_id"] for g in group]))
            return made

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

        held: list[dict] = []
        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                row["path"] = tuple(row["section_path"] or ())
                if held and held[0]["document_id"] != row["document_id"]:
                    out += close(held)
                    held = []
                held.append(row)
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        yield batch_of(out + (close(held) if held else []))

    width = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = units.select("document_id", "at", "unit_id", "unit_type", F.col("primary").cast("int").alias("primary"), "section_path", F.col("table_key").cast("long").alias("table_key"), "text", "context", F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"), "blocks")
    return rows.repartition(width, "document_id").sortWithinPartitions("document_id", "at", "unit_id").mapInArrow(run, PACKED)


def child_chunks(packs: DataFrame) -> DataFrame:
    """Packs with their ids: the parent's, that of a row's table, and their own, which depend on what they hold and not on their place."""
    name = F.concat_ws(":", F.lit("v2:child"), "unit_type", F.array_join("section_path", " > "), F.array_join("blocks", ","), F.array_join("unit_ids", ","))
    parent = I.stable_id("document_id", F.concat_ws(":", F.lit("v2:parent"), F.col("primary").cast("string")))
    table = F.when(F.col("table_key").isNotNull(), I.stable_id("document_id", F.concat_ws(":", F.lit("v2:parent:table"), F.col("table_key").cast("string"))))
    return packs.select("*", I.stable_id("document_id", name).alias("chunk_id"), parent.alias("parent_id"), table.alias("table_parent_id"), F.lit("child").alias("record_type"))


def parent_chunks(units: DataFrame) -> DataFrame:
    """One chunk for each primary parent and each table: the texts of its units in order, its pages and blocks."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "unit_id", "text", "blocks")))

    def grouped(rows: DataFrame, key: str, name: str, gap: str) -> DataFrame:
        made = rows.groupBy("document_id", key).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), gap).alias("text"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["blocks"]))).alias("blocks"), F.min_by("section_path", "at").alias("section_path"))
        return made.withColumn("chunk_id", I.stable_id("document_id", F.concat_ws(":", F.lit(name), F.col(key).cast("string")))).drop(key)

    tables = grouped(units.where("table_key is not null"), "table_key", "v2:parent:table", "\n\n").withColumn("chunk_type", F.lit("table"))
    return grouped(units, "primary", "v2:parent", "\n\n").withColumn("chunk_type", F.lit("section")).unionByName(tables).withColumn("record_type", F.lit("parent"))


def linked(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents with the ids of their children in order, from either link."""
    links = children.select(F.col("parent_id").alias("chunk_id"), "chunk_index", F.col("chunk_id").alias("child")).unionByName(children.where("table_parent_id is not null").select(F.col("table_parent_id").alias("chunk_id"), "chunk_index", F.col("chunk_id").alias("child")))
    ids = links.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "child"))), lambda x: x["child"]).alias("child_ids"))
    return parents.join(ids, "chunk_id", "left").withColumn("child_ids", F.coalesce("child_ids", F.array().cast("array<string>")))


def violations(children: DataFrame, parents: DataFrame, text: str = "retrieval_text", budget: Budget = Budget()) -> DataFrame:
    """chunk_id and every rule a chunk breaks: repeated id, no parent, no text, wrong count, too long, too short, a table row without table or path."""
    known = parents.select(F.col("chunk_id").alias("_p")).distinct()
    twice = children.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = children.join(known, F.col("parent_id") == F.col("_p"), "left").join(twice, "chunk_id")
    actual = X.token_count(text)
    empty = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    row = F.col("unit_type") == "table_row"
    broken = F.array_compact(F.array(
        F.when(F.col("_n") > 1, "repeated id"), F.when(F.col("_p").isNull(), "no parent"), F.when(empty, "no text"), F.when(~empty & (F.coalesce("token_count", F.lit(-1)) != actual), "wrong count"), F.when(~empty & (actual > budget.most), "too long"),
        F.when(~empty & (actual < budget.least), "too short"), F.when(row & F.col("table_key").isNull(), "no table"), F.when(row & (F.coalesce(F.size("section_path"), F.lit(0)) <= 0), "no path"),
    ))
    return rows.select("chunk_id", F.explode(broken).alias("rule"))


def require_valid(children: DataFrame, parents: DataFrame, text: str = "retrieval_text", budget: Budget = Budget()) -> DataFrame:
    """``children``, raising at one that breaks a rule."""
    bad = violations(children, parents, text, budget).groupBy("chunk_id").agg(F.array_join(F.collect_set("rule"), ", ").alias("_bad"))
    rows = children.join(bad, "chunk_id", "left")
    return rows.withColumn("chunk_id", F.when(F.col("_bad").isNull(), F.col("chunk_id")).otherwise(F.raise_error(F.concat(F.lit("chunk "), F.col("chunk_id"), F.lit(": "), F.col("_bad"))))).drop("_bad")
