"""A universal outline: boundary candidates with scores, levels and guards; zones, titles and document types."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X

# Kinds of boundaries in order of precedence with nominal level, base score, threshold and pattern over the match key.
REGISTRY = (
    ("annex", 0, 0.60, 0.50, r"^\s*phu\s*luc(?:\s+(?:so\s*)?[0-9ivxlcdm]+)?\s*[:.\-]?\s*"), ("part", 0, 0.60, 0.50, r"^\s*phan\s+(?:thu\s+)?(?:[0-9]+|[ivxlcdm]+|mot|hai|ba|tu|nam|sau|bay|tam|chin|muoi)\s*[:.\-]?\s"), ("chapter", 0, 0.60, 0.50, r"^\s*chuong\s+(?:[0-9]+|[ivxlcdm]+)\s*[:.\-]?\s*"),
    ("section_word", 1, 0.60, 0.50, r"^\s*muc\s+(?:[0-9]+|[ivxlcdm]+)\s*[:.\-]?\s*"), ("article", 2, 0.60, 0.50, r"^\s*dieu\s+\d+[a-z]?\s*[:.\-]?\s*"), ("clause_word", 3, 0.60, 0.50, r"^\s*khoan\s+\d+(?:\.\d+)*\s*[:.\-]?\s*"), ("point_word", 4, 0.60, 0.50, r"^\s*diem\s+[a-z]\s*[:.\-)]?\s*"),
    ("decimal_number", 3, 0.55, 0.65, r"^\s*\d+(?:\.\d+)+\s*[.)]?\s+"), ("roman", 1, 0.50, 0.70, r"^\s*[ivxlcdm]+\s*[.)]\s+"), ("primary_number", 2, 0.52, 0.72, r"^\s*\d{1,3}\s*[.)]\s+"), ("letter_point", 4, 0.50, 0.68, r"^\s*[a-z]\s*[.)]\s+"),
    ("semantic_heading", 1, 0.45, 0.72, r"^\s*(?:kinh gui|noi dung(?: de nghi| to trinh)?|su can thiet|co so (?:phap ly|thuc tien)|muc dich|pham vi|doi tuong|to chuc thuc hien|dieu khoan (?:chung|thi hanh)|trach nhiem cac ben|quyen va nghia vu|(?:dai dien )?ben [abc]|noi nhan)\s*(?:[:.]|$)"), ("style_heading", 1, 0.75, 0.75, r"(?!)"), ("bullet", 5, 0.60, 0.50, r"^\s*[-+*•▪–—]\s+"),
)
TYPE_RULES = {
    "DECISION": ((10, "title", r"^quyet dinh"), (3, "articles", r""), (2, "legal", r""), (1, "text", r"noi nhan")), "CONTRACT": ((10, "title", r"^hop dong"), (6, "parties", r""), (3, "text", r"hai ben (?:thong nhat|thoa thuan)"), (3, "articles", r""), (2, "text", r"hop dong so")),
    "PROPOSAL": ((10, "title", r"^to trinh"), (4, "text", r"kinh gui"), (3, "text", r"su can thiet|noi dung trinh|kien nghi")), "OFFICIAL_LETTER": ((6, "title", r"v/v"), (6, "title", r"^cong van"), (4, "text", r"kinh gui"), (3, "text", r"noi nhan")),
}
MIN_SCORE, MIN_MARGIN = 8.0, 2.0
# What looks like a boundary and is none, in the order in which a reason is given.
GUARDS = (
    ("inline_reference", r"^\s*(?:theo|tai|can cu|(?:duoc )?quy dinh tai|neu tai)\s+(?:dieu|khoan|diem)\b"), ("legal_reference", r"^\s*(?:dieu|khoan|diem)\s+\S+\s+(?:cua|nay|luat|nghi dinh|quy che|thong tu)"),
    ("numeric_value", r"^\s*\d{1,3}(?:[.,]\d+)+\s*(?:%|dong|vnd|usd|trieu|ty)|^\s*\d{1,3}(?:\.\d{3})+\s|^\s*\d{1,2}\.\d{1,2}\.\d{4}"), ("page_number", r"^\s*\d{1,4}\s*[.)]?\s*$"),
)
#: kinds that end an article when they are accepted
ABOVE_CLAUSES = ("annex", "part", "chapter", "section_word", "article", "roman", "semantic_heading", "style_heading")


def features(spans: DataFrame) -> DataFrame:
    """Spans (document_id, at, text, block_type, bbox) with what they look like: match key, words, share of capitals, centred, place on the page."""
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    rows = spans.withColumn("key", X.match_key("text")).withColumn("word_count", F.size(F.split(F.trim("text"), r"\s+")))
    rows = rows.withColumn("uppercase_ratio", F.when(letters > 0, F.regexp_count("text", F.lit(r"\p{Lu}")) / letters).otherwise(0.0))
    middle, top = (F.get("bbox", F.lit(0)) + F.get("bbox", F.lit(2))) / 2, F.get("bbox", F.lit(1))
    return rows.withColumn("centred", F.coalesce(F.abs(middle - 0.5) <= 0.05, F.lit(False))).withColumn("place", F.when(top < 0.15, "top").when(top > 0.85, "bottom").otherwise("middle"))


def style_score(rows: DataFrame) -> Column:
    """How much a span looks like a heading. Bold type and type size count only where the recogniser gives them (is_bold, font_ratio)."""
    plus = lambda hit, weight: F.when(hit, weight).otherwise(0.0)
    score = plus(F.col("block_type") == "title", 0.25) + plus(F.col("centred"), 0.15) + plus(F.col("uppercase_ratio") >= 0.75, 0.10) + plus(F.col("word_count") <= 14, 0.10) + plus(F.col("text").rlike(r":\s*$"), 0.05)
    score = score - plus(F.col("word_count") > 30, 0.25) - plus(F.col("text").rlike(r"[.;,!?]\s*$"), 0.30) - plus(F.length("text") > 220, 0.30)
    if "is_bold" in rows.columns:
        score = score + plus(F.coalesce("is_bold", F.lit(False)), 0.20)
    if "font_ratio" in rows.columns:
        score = score + plus(F.coalesce("font_ratio", F.lit(1.0)) >= 1.20, 0.15)
    return score


def candidates(rows: DataFrame) -> DataFrame:
    """The first kind each span matches, its score from base and evidence, whether it is accepted, and the ``reason`` if it isn't.

    Guards come before scores: an inline reference, a number that is a value, a
    bare page number and text in a table open nothing. A span that goes on with
    the sentence of the one before, or cites an article of a law, scores less.
    """
    style = style_score(rows)
    kind, level, base, bar = F.lit("plain_paragraph"), F.lit(None).cast("int"), F.lit(0.0), F.lit(2.0)
    for name, lv, score, least, pattern in reversed(REGISTRY):
        hit = F.round(style, 6) >= least if name == "style_heading" else F.col("key").rlike(pattern)
        kind, level, base, bar = F.when(hit, name).otherwise(kind), F.when(hit, F.lit(lv)).otherwise(level), F.when(hit, F.lit(score)).otherwise(base), F.when(hit, F.lit(least)).otherwise(bar)
    order = Window.partitionBy("document_id").orderBy("at")
    previous = F.lag("text").over(order)
    mid = F.coalesce(previous.rlike(r"[,\p{Ll}]\s*$") & ~previous.rlike(r"[.:;!?]\s*$"), F.lit(False)) & F.col("text").rlike(r"^\s*\p{Ll}") & ~F.col("text").rlike(r"^\s*\p{Ll}\s*[.)]\s")
    plus = lambda hit, weight: F.when(hit, weight).otherwise(0.0)
    guards = dict(GUARDS)
    evidence = F.lit(0.15) + plus(F.col("block_type") == "title", 0.15) + plus(F.col("centred"), 0.08) + plus(F.col("uppercase_ratio") >= 0.75, 0.05) + plus(F.col("word_count") <= 14, 0.05)
    against = plus(mid, 0.60) + plus(F.col("key").rlike(guards["legal_reference"]), 0.55) + plus(F.col("word_count") > 45, 0.15) + plus(F.col("text").rlike(r"^\s*[,;]"), 0.20)
    made = rows.withColumn("kind", kind).withColumn("nominal_level", level).withColumn("_base", base).withColumn("_bar", bar)
    made = made.withColumn("score", F.when(F.col("kind") == "plain_paragraph", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_base") + evidence - against))))
    number = F.try_to_number(F.regexp_extract("key", r"^\s*(\d{1,3})\s*[.)]", 1), F.lit("999")).cast("int")
    follows = F.lag(number).over(Window.partitionBy("document_id", "kind").orderBy("at")) + 1 == number
    article = F.last(F.when(F.col("kind") == "article", F.regexp_extract("key", r"^\s*dieu\s+(\d+)", 1)), ignorenulls=True).over(order)
    of_article = F.regexp_extract("key", r"^\s*(\d+)\.\d", 1) == article
    bonus = plus((F.col("kind") == "primary_number") & F.coalesce(follows | (number == 1), F.lit(False)), 0.05) + plus((F.col("kind") == "decimal_number") & F.coalesce(of_article, F.lit(False)), 0.05)
    made = made.withColumn("score", F.when(F.col("kind") == "plain_paragraph", 0.0).otherwise(F.round(F.least(F.lit(1.0), F.col("score") + bonus), 6)))
    numbered = F.col("kind").isin("decimal_number", "primary_number", "roman")
    reason = F.when(F.col("key").rlike(guards["inline_reference"]), "inline_reference").when((F.col("kind") != "plain_paragraph") & (F.col("block_type") == "table"), "table")
    reason = reason.when(numbered & F.col("key").rlike(guards["numeric_value"]), "numeric_value").when(F.col("key").rlike(guards["page_number"]), "page_number")
    low = F.when(mid, "sentence_continuation").when(F.col("key").rlike(guards["legal_reference"]), "legal_reference").otherwise("low_score")
    made = made.withColumn("reason", reason).withColumn("reason", F.coalesce("reason", F.when((F.col("kind") != "plain_paragraph") & (F.col("score") < F.col("_bar")), low)))
    return made.withColumn("accepted", F.col("reason").isNull() & (F.col("score") >= F.col("_bar"))).drop("_base", "_bar")


def style_headings(rows: DataFrame) -> DataFrame:
    """Spans with what speaks for a heading without a mark, and whether it is enough."""
    return rows.withColumn("style_score", F.round(style_score(rows), 6)).withColumn("style_heading", F.col("style_score") >= 0.75)


def leveled(rows: DataFrame) -> DataFrame:
    """Accepted spans with their effective ``level``; null where a deep mark has nothing to stand under (it stays a paragraph).

    A number under an article lies one below it, decimal numbers as deep as
    their parts say, at most 5. An article is open until the next heading of its
    own level or above; a letter or bullet needs a heading of level 0 to 3 before.
    """
    upto = Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.where("accepted")
    above = F.last(F.when(F.col("kind").isin(*ABOVE_CLAUSES), F.col("kind")), ignorenulls=True).over(upto)
    depth = F.regexp_count(F.regexp_extract("key", r"^\s*(\d+(?:\.\d+)+)", 1), F.lit(r"\.")) + 1
    level = F.when((F.col("kind") == "primary_number") & (above == "article"), 3).when(F.col("kind") == "decimal_number", F.when(depth <= 2, 3).when(depth == 3, 4).otherwise(5)).otherwise(F.col("nominal_level"))
    made = heads.withColumn("level", level.cast("int"))
    lone = (F.col("level") >= 4) & F.max(F.when(F.col("level") <= 3, 1)).over(upto).isNull()
    return made.withColumn("level", F.when(lone, F.lit(None).cast("int")).otherwise(F.col("level")))


def outline(rows: DataFrame) -> DataFrame:
    """document_id, at, effective level, parent (``at`` of the enclosing heading, null at the top) and path of accepted candidates.

    The parent is the nearest heading before with a lower level: a stack, kept
    while a document's headings stream by in order. The path holds the labels
    from the top down, a label equal to the one above it once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stack = None, []
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, at, level, label, key in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if doc != current:
                    current, stack = doc, []
                while stack and stack[-1][0] >= level:
                    stack.pop()
                path = stack[-1][2] if stack else []
                path = path if not label or stack and stack[-1][3] == key else [*path, label]
                for column, value in zip(out, (doc, at, level, stack[-1][1] if stack else None, path)):
                    column.append(value)
                stack.append((level, at, path, key if label else stack[-1][3] if stack else ""))
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["document_id", "at", "level", "parent_at", "path"])

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = leveled(rows).where("level is not null").select(F.col("document_id").cast("string").alias("document_id"), F.col("at").cast("long").alias("at"), "level", path_label(F.col("kind"), F.col("text")).alias("label"), F.trim("key").alias("key"))
    return heads.repartition(width, "document_id").sortWithinPartitions("document_id", "at").mapInArrow(run, "document_id string, at long, level int, parent_at long, path array<string>")


def path_label(kind: Column, text: Column) -> Column:
    """What a heading is called in a path: its line without blanks and closing marks around it, at most 80 characters."""
    bare = F.regexp_replace(F.trim(text), r"[\s.:;,]+$", "")
    return F.when(F.length(bare) > 80, F.concat(F.rtrim(F.substring(bare, 1, 79)), F.lit("…"))).otherwise(bare)


def collapsed(path: Column) -> Column:
    """A section path without blank labels and without a label that, case put aside, repeats the one before it."""
    kept = F.filter(F.transform(path, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.filter(kept, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(kept, i - 1))))


def zones(rows: DataFrame) -> DataFrame:
    """Spans with their zone: HEADER until the first body mark, BODY, CLOSING from the list of recipients or a signer, ANNEX from an annex on."""
    signal = F.when(F.col("kind") == "annex", "ANNEX").when(F.col("key").rlike(r"^\s*(?:noi nhan|hieu truong|giam doc|chu tich|kt\.|tl\.)"), "CLOSING").when(F.col("kind").isin("article", "chapter", "part", "section_word", "primary_number", "roman"), "BODY").when(F.col("key").rlike(r"^\s*can cu"), "BODY")
    upto = Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closed = F.max(F.when(signal == "CLOSING", 1)).over(upto)
    annexed = F.max(F.when(signal == "ANNEX", 1)).over(upto)
    return rows.withColumn("zone", F.when(annexed == 1, "ANNEX").when(closed == 1, "CLOSING").otherwise(F.coalesce(F.last(signal, ignorenulls=True).over(upto), F.lit("HEADER"))))


def titles(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """The best title line of the first page, else the summary; none is made up."""
    score = F.when(F.col("block_type") == "title", 0.4).otherwise(0.0) + F.when(F.col("uppercase_ratio") >= 0.75, 0.2).otherwise(0.0) + F.when(F.col("key").rlike(r"^\s*(?:quyet dinh|to trinh|hop dong|cong van|thong bao|bien ban|ke hoach)"), 0.5).otherwise(0.0) - F.when(F.col("key").rlike("cong hoa xa hoi|doc lap"), 1.0).otherwise(0.0)
    best = rows.where("page = 1").withColumn("_s", score).where("_s >= 0.5").groupBy("document_id").agg(F.max_by("text", F.struct("_s", -F.col("at"))).alias("title"))
    return summaries.select("document_id", "summary").join(best, "document_id", "full").select("document_id", F.coalesce("title", F.nullif(F.trim("summary"), F.lit(""))).alias("title"))


def document_types(rows: DataFrame) -> DataFrame:
    """document_id, type and score: the best type if it reaches the least score and leads by the margin, else UNKNOWN."""
    facts = rows.groupBy("document_id").agg(
        F.coalesce(F.min_by("key", F.when((F.col("page") == 1) & F.col("key").rlike(r"^\s*(?:quyet dinh|hop dong|to trinh|cong van|v/v)"), F.col("at"))), F.lit("")).alias("title"), F.count_if((F.col("kind") == "article") & F.col("accepted")).alias("articles"), F.count_if(F.col("key").rlike(r"^\s*can cu")).alias("legal"),
        F.count_if(F.col("key").rlike(r"^\s*ben (?:[ab]|thu (?:nhat|hai))")).alias("parties"), *(F.max(F.col("key").rlike(rule).cast("int")).alias(f"t{i}") for i, rule in enumerate(_text_rules())),
    )
    scored = facts
    texts = _text_rules()
    for kind, rules in TYPE_RULES.items():
        parts = [F.when({"title": F.col("title").rlike(rule), "articles": F.col("articles") >= 2, "legal": F.col("legal") >= 2, "parties": F.col("parties") >= 2}.get(what, F.col(f"t{texts.index(rule)}") == 1 if what == "text" else F.lit(False)), float(weight)).otherwise(0.0) for weight, what, rule in rules]
        scored = scored.withColumn(kind, reduce(lambda a, b: a + b, parts))
    order = F.sort_array(F.array(*(F.struct(F.col(k).alias("s"), F.lit(k).alias("k")) for k in TYPE_RULES)), asc=False)
    ranked = scored.withColumn("_o", order)
    sure = (F.col("_o")[0]["s"] >= MIN_SCORE) & (F.col("_o")[0]["s"] - F.col("_o")[1]["s"] >= MIN_MARGIN)
    return ranked.select("document_id", F.when(sure, F.col("_o")[0]["k"]).otherwise("UNKNOWN").alias("doc_type"), F.col("_o")[0]["s"].alias("score"))


def _text_rules() -> list[str]:
    return list(dict.fromkeys(rule for rules in TYPE_RULES.values() for _, what, rule in rules if what == "text"))


def audit(rows: DataFrame) -> DataFrame:
    """Per document: spans, accepted and rejected candidates, why they were rejected, accepted ones by level and kind, and deep marks left as paragraphs."""
    marked = F.col("kind") != "plain_paragraph"
    counts = rows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(marked & F.col("accepted")).alias("accepted"), F.count_if(marked & ~F.col("accepted")).alias("rejected"), *(F.count_if(F.col("reason") == r).alias(f"rejected_{r}") for r in ("inline_reference", "legal_reference", "sentence_continuation", "numeric_value", "page_number", "table", "low_score")),
        *(F.count_if(F.col("accepted") & (F.col("kind") == k)).alias(f"{k}s") for k in ("article", "clause_word", "point_word", "annex", "style_heading")),
    )
    levels = leveled(rows).groupBy("document_id").agg(F.count_if(F.col("level").isNull()).alias("orphans"), *(F.count_if(F.col("level") == i).alias(f"level_{i}") for i in range(6)))
    return counts.join(levels, "document_id", "left").fillna(0)


def violations(heads: DataFrame) -> DataFrame:
    """document_id, at and rule of headings (of ``outline``) that break one: not below the parent, a deep mark at the top, a parent that isn't there, no path."""
    above = heads.select("document_id", F.col("at").alias("parent_at"), F.col("level").alias("_up"))
    rows = heads.join(above, ["document_id", "parent_at"], "left")
    broken = F.array_compact(F.array(
        F.when(F.col("_up").isNotNull() & (F.col("level") <= F.col("_up")), "level order"), F.when(F.col("parent_at").isNull() & (F.col("level") >= 4), "orphan"),
        F.when(F.col("parent_at").isNotNull() & F.col("_up").isNull(), "no parent"), F.when(F.coalesce(F.size("path"), F.lit(0)) <= 0, "no path"),
    ))
    return rows.select("document_id", "at", F.explode(broken).alias("rule"))
