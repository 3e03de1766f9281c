"""Queries of problems 1, 4, 5, 6 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import lookalike, pages, pieces, pii, sentences
from docloom.session import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = pii.find(spread(table(spark, sf_dir, "ocr_block", "block_key", "content_raw")), "block_key", "content_raw")
    chunks = pii.find(spread(table(spark, sf_dir, "chunk", "chunk_key", "raw_text")), "chunk_key", "raw_text")
    return (
        blocks.select(F.lit("ocr_block").alias("src_table"), F.col("block_key").alias("row_key"), "pii_type", "start_pos")
        .unionByName(chunks.select(F.lit("chunk").alias("src_table"), F.col("chunk_key").alias("row_key"), "pii_type", "start_pos"))
    )


def p1_redacted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(spread(table(spark, sf_dir, "ocr_block", "block_key", "content_raw")), "block_key", "content_raw")


def p1_redacted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(spread(table(spark, sf_dir, "chunk", "chunk_key", "raw_text")), "chunk_key", "raw_text")


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = pages.block_rows(table(spark, sf_dir, "ocr_block"))
    return blocks.unionByName(pages.line_rows(table(spark, sf_dir, "page_vietocr_results")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.find(_page_rows(spark, sf_dir))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.repair(_page_rows(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike(table(spark, sf_dir, "ocr_block", "block_key", "content_raw", "content_normalized"), "block_key", "content_raw", "content_normalized")


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical_fields(spread(table(spark, sf_dir, "ocr_block")), "block_key", ["content_raw", "content_normalized"])


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.groups(spread(table(spark, sf_dir, "ocr_block", "block_key", "content_raw")), "block_key", "content_raw")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pieces.split(spread(table(spark, sf_dir, "chunk", "chunk_key", "raw_text", "section_path")))
    return made.where("piece_index = 1").select("chunk_key").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split(spread(table(spark, sf_dir, "chunk", "chunk_key", "raw_text", "section_path"))).distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split(spread(table(spark, sf_dir, "documents", "doc_id", "text")))


def p9_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.texts(spread(table(spark, sf_dir, "documents", "doc_id", "text")))


QUERIES = {
    "p1_found": p1_found, "p1_redacted_blocks": p1_redacted_blocks, "p1_redacted_chunks": p1_redacted_chunks, "p4_found": p4_found, "p4_paragraphs": p4_paragraphs, "p5_found": p5_found, "p5_canonical": p5_canonical, "p5_groups": p5_groups,
    "p6_found": p6_found, "p6_pieces": p6_pieces, "p9_found": p9_found, "p9_units": p9_units,
}
SQL = {
    "p6_found": r"""SELECT DISTINCT chunk_key FROM chunk WHERE len(regexp_extract_all(raw_text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{000B}\x{001C}-\x{001F}]')) + 2 > 256""",
}
