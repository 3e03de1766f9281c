"""Texts for models: embedding texts, contexts of several shapes, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X

# Prompts in which {context} and {question} are filled in; give a template of one's own instead (``documents.read_prompts``).
PROMPTS = {
    "answer": "Bạn trả lời câu hỏi về văn bản hành chính tiếng Việt.\nChỉ dùng CONTEXT; không suy đoán; thiếu dữ liệu thì trả lời: \"Không đủ dữ liệu trong context\".\n\nCONTEXT:\n{context}\n\nCÂU HỎI:\n{question}\n\nCÂU TRẢ LỜI CUỐI CÙNG:\n",
    "cited": "Bạn trả lời câu hỏi về văn bản hành chính tiếng Việt.\nChỉ dùng CONTEXT; sau mỗi ý ghi nguồn [E?].\n\nCONTEXT:\n{context}\n\nQUESTION:\n{question}\n\nYÊU CẦU TRẢ LỜI:\nngắn gọn, đúng trọng tâm\n",
}
VARIANTS = ("plain", "sources", "evidence", "fields", "chunks")


def embedding_text(summary: Column, number: Column, author: Column, date: Column, body: Column) -> Column:
    """The first index's text: four labelled lines, a blank one, the body under its heading. Null fields are empty."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.trim(F.concat(F.lit("Văn bản: "), blank(summary), F.lit("\nSố: "), blank(number), F.lit("\nCơ quan ban hành: "), blank(author), F.lit("\nNgày: "), blank(date), F.lit("\n\nNội dung:\n"), blank(body)))


def prompt(template: Column | str, context: Column, question: Column) -> Column:
    """A template with its two places filled; a marker inside the context or question isn't filled again."""
    base = F.lit(PROMPTS[template]) if isinstance(template, str) else template
    put = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("{"), F.lit("\x01"))
    made = F.replace(F.replace(base, F.lit("{context}"), put(context)), F.lit("{question}"), put(question))
    return F.replace(made, F.lit("\x01"), F.lit("{"))


def contexts(rows: DataFrame, group: list[str], order: list[str], variant: str, most: int | None = None) -> DataFrame:
    """One context a group of hits (text, document_id, doc_no, date, summary, chunk_index, file_url), in order.

    plain: the texts, then the last file's url; sources: each with its document
    and source; evidence: numbered, made compact, a text that comes again left
    out; fields: numbered with all fields; chunks: numbered texts. With ``most``
    it stops before the first block that would exceed so many characters.
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant is one of {VARIANTS}")
    some = lambda c, other="N/A": F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(other))
    body = X.compact("text") if variant == "evidence" else F.trim(F.coalesce("text", F.lit("")))
    kept = rows.withColumn("_t", body).where("_t <> ''")
    window = Window.partitionBy(*group)
    if variant == "evidence":
        kept = kept.withColumn("_again", F.row_number().over(Window.partitionBy(*group, F.lower("_t")).orderBy(*order))).where("_again = 1")
    kept = kept.withColumn("_n", F.row_number().over(window.orderBy(*order)))
    n = F.col("_n").cast("string")
    block = {
        "plain": F.col("_t"), "chunks": F.concat(F.lit("[CHUNK "), n, F.lit("]\n"), F.col("_t")), "sources": F.concat(F.lit("[DOC_ID: "), some("document_id", ""), F.lit("]\n"), F.col("_t"), F.lit("\nNGUỒN: "), some("file_url"), F.lit("\n")),
        "evidence": F.concat(F.lit("[E"), n, F.lit("]\nso_quyet_dinh: "), some("doc_no"), F.lit("\nngay_ban_hanh: "), some("date"), F.lit("\ntom_tat_tai_lieu: "), some("summary"), F.lit("\ndoan_van_ban_ocr:\n"), F.col("_t"), F.lit("\n")),
        "fields": F.concat(F.lit("[E"), n, F.lit("] doc_no: "), some("doc_no"), F.lit("\ndate: "), some("date"), F.lit("\nsummary: "), some("summary"), F.lit("\nchunk_index: "), some("chunk_index"), F.lit("\nfile_url: "), some("file_url"), F.lit("\ntext:\n"), F.col("_t"), F.lit("\n")),
    }[variant]
    made = kept.withColumn("_b", block)
    if most is not None:
        made = made.withColumn("_used", F.sum(F.length("_b")).over(window.orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("_used") <= most)
    gap = {"plain": "\n", "chunks": "\n\n"}.get(variant, "\n---\n")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_b"))), lambda x: x["_b"]), gap)
    out = made.groupBy(*group).agg(parts.alias("context"), F.max_by(some("file_url", ""), "_n").alias("_url"))
    context = F.concat("context", F.lit("\nFile_URL: "), F.col("_url")) if variant == "plain" else F.col("context")
    return out.select(*group, context.alias("context"))
