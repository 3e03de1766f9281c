"""The structure of an administrative document as windows over its lines.

Nothing is parsed step by step: what is current at a line (article, clause,
point, region) is the last such line before it, so each is a running ``last``
over the reading order of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import ids as I
from docloom.functions import text as X

# How the parts of a document begin, and what isn't content.
ARTICLE = r"(?iu)^\s*Điều\s+(\d+[A-Za-z]?)\s*[:.\-]?\s*"
CLAUSE = r"^\s*(\d{1,3})[.)]\s+"
POINT = r"(?iu)^\s*([a-zđ])[.)]\s+"
LEGAL_BASIS = r"(?iu)^\s*[-–—]?\s*(?:Căn\s+c[ứửưúủu](?:\s+vào)?|Theo\s+đề\s+nghị)(?![\p{L}\p{N}_])"
RECIPIENTS = r"(?iu)^\s*Nơi\s+nhận\s*[:.]?"
DECISION = r"(?iu)^\s*QUY[ẾE]T\s+ĐỊNH(?![\p{L}\p{N}_])"
SIGNER = r"(?iu)^\s*(?:KT\.?\s+|TL\.?\s+|TUQ\.?\s+)?(?:HIỆU TRƯỞNG|GIÁM ĐỐC|PHÓ\s+(?:HIỆU TRƯỞNG|GIÁM ĐỐC)|CHỦ TỊCH|THỦ TRƯỞNG|BỘ TRƯỞNG|NGƯỜI KÝ|ĐÃ KÝ)(?![\p{L}\p{N}_])"
PAGE_NUMBER = r"(?iu)^\s*(?:trang\s*)?\d{1,4}\s*$"
OPERATOR_NOTE = r"^\s*[A-ZÀ-Ỹ][\p{L}\p{N}_ .'-]{0,28}\s*\((?:ĐT|DT|đt|dt)\)\s*$"
STAMP = r"(?iu)^(?:ký bởi|signed by|signature valid|digitally signed)(?![\p{L}\p{N}_])"
VALUABLE = r"(?iu)(?<![\p{L}\p{N}_])(?:BỘ|TRƯỜNG|ỦY BAN|CỘNG HÒA|Số\s*:|QUYẾT ĐỊNH|Căn cứ|Điều\s+\d+)(?![\p{L}\p{N}_])"
PRIMARY = ("article", "preamble", "recipients", "signature", "metadata", "decision_heading", "document")
UNIT_TYPES = {"article": "article_intro", "recipients": "recipient_item"}


def blocks_of(ocr: DataFrame) -> DataFrame:
    """OCR blocks in one vocabulary: document_id (lower case), page, idx, block_type, bbox, raw, norm, block_id, key. Sent-again rows count once.

    Blocks without a document belong to no tree and are left out. The rows are
    laid out by document once; what follows keeps that partitioning.
    """
    width = int(ocr.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = ocr.where("document_id is not null").select("block_key", F.lower("document_id").alias("document_id"), "page_number", "block_index", "block_type", "bbox", "content_raw")
    rows = given.repartition(width, "document_id").dropDuplicates(["document_id", "block_key"])
    return rows.select(
        "document_id", F.coalesce(F.col("page_number"), F.lit(1)).alias("page"), F.coalesce(F.col("block_index"), F.lit(0)).alias("idx"), X.block_type("block_type").alias("block_type"), "bbox",
        F.coalesce(F.col("content_raw"), F.lit("")).alias("raw"), X.tidy_plain("content_raw").alias("norm"), F.col("block_key").alias("key"),
    ).withColumn("block_id", I.block_id("page", "idx"))


def is_indexable(kind: Column, text: Column) -> Column:
    """Whether a block carries content: rules in order, the first that applies decides."""
    return (
        F.when(F.trim(text) == "", False).when(text.rlike(PAGE_NUMBER), False).when((kind == "table_footnote") & text.rlike(OPERATOR_NOTE), False).when(text.rlike(STAMP), False).when(kind == "figure", False)
        .when(kind == "abandon", text.rlike(VALUABLE)).when((F.length(text) <= 2) & ~text.rlike(r"[\p{L}\p{N}_]"), False).otherwise(True)
    )


def indexable(blocks: DataFrame) -> DataFrame:
    return blocks.where(is_indexable(F.col("block_type"), F.col("norm")))


def reading_order() -> list[Column]:
    """Page, top (to four places), left, index; blocks without a box come last on their page."""
    top = F.bround(F.get("bbox", F.lit(1)), 4)
    return [F.col("page"), top.asc_nulls_last(), F.get("bbox", F.lit(0)).asc_nulls_last(), F.col("idx"), F.col("key")]


def lines(blocks: DataFrame) -> DataFrame:
    """Lines of the blocks in reading order, ``seq`` from 1; a table is one line."""
    ordered = blocks.withColumn("_at", F.row_number().over(Window.partitionBy("document_id").orderBy(*reading_order())))
    split = F.when(F.col("block_type") == "table", F.array("norm")).otherwise(F.filter(F.transform(F.split("norm", "\n"), lambda y: F.trim(y)), lambda x: x != ""))
    rows = ordered.select("*", F.posexplode(split).alias("segment", "text"))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("document_id").orderBy("_at", "segment"))).drop("_at")


def tree(blocks: DataFrame) -> DataFrame:
    """The nodes of every document but its root.

    Rows: document_id, ordinal (creation order, the root is 1), node_id,
    node_type, title, text, page_start, page_end (own), block_id, parent_ordinal,
    ancestors (ordinals from the root down to the node), section_path, seq, segment.
    Lines that go on a signature are joined to it.
    """
    doc = Window.partitionBy("document_id").orderBy("seq")
    upto = doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    text = F.col("text")
    words = F.size(F.split(F.trim(text), r"\s+"))
    signer = text.rlike(SIGNER) | (F.col("block_type") == "figure_caption") & words.between(2, 12) & text.rlike(r"\p{L}")
    strong = F.when(text.rlike(ARTICLE), "article").when(text.rlike(RECIPIENTS), "recipients").when(signer, "signature").when(text.rlike(DECISION), "decision_heading")
    rows = lines(blocks).withColumn("strong", strong).withColumn("_last", F.last("strong", ignorenulls=True).over(before))
    rows = rows.withColumn("kind", F.coalesce("strong", F.when(text.rlike(LEGAL_BASIS) & (F.coalesce("_last", F.lit("")) != "article"), "legal_basis")))
    rows = rows.withColumn("mode", F.coalesce(F.last("kind", ignorenulls=True).over(upto), F.lit("metadata")))
    plain = F.col("kind").isNull()
    in_article = plain & (F.col("mode") == "article")
    node_type = (
        F.when(~plain, F.col("kind")).when(F.col("block_type") == "table", "table").when(F.col("mode") == "recipients", "recipient_item").when(F.col("mode") == "signature", "signature")
        .when(in_article & text.rlike(CLAUSE), "clause").when(in_article & text.rlike(POINT), "point").otherwise("paragraph")
    )
    rows = rows.withColumn("node_type", node_type)
    # a signature goes on until the next article or list of recipients
    rows = rows.withColumn("_region", F.sum(F.col("kind").isin("article", "recipients").cast("int")).over(upto))
    rows = rows.withColumn("_region", F.coalesce("_region", F.lit(0)))
    signed = F.sum((F.col("node_type") == "signature").cast("int")).over(Window.partitionBy("document_id", "_region").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_goes_on", (F.col("node_type") == "signature") & (F.coalesce(signed, F.lit(0)) > 0))
    loose = (F.col("node_type") == "paragraph") & (F.col("mode") == "metadata")
    rows = rows.withColumn("_preamble", F.min(F.when(F.col("kind") == "legal_basis", F.col("seq"))).over(Window.partitionBy("document_id"))).withColumn("_metadata", F.min(F.when(loose, F.col("seq"))).over(Window.partitionBy("document_id")))
    own = F.sum((~F.col("_goes_on")).cast("int")).over(upto)
    extra = lambda c: F.coalesce((F.col(c) <= F.col("seq")).cast("int"), F.lit(0))
    rows = rows.withColumn("ordinal", F.lit(1) + own + extra("_preamble") + extra("_metadata"))
    started = F.last(F.when((F.col("node_type") == "signature") & ~F.col("_goes_on"), F.col("ordinal")), ignorenulls=True).over(upto)
    rows = rows.withColumn("ordinal", F.when(F.col("_goes_on"), started).otherwise(F.col("ordinal")))
    at = lambda flag: F.last(F.when(flag, F.col("ordinal")), ignorenulls=True).over(upto)
    since = lambda flag, reset: F.nullif(F.last(F.when(flag, F.col("ordinal")).when(reset, F.lit(0)), ignorenulls=True).over(upto), F.lit(0))
    closing = F.col("kind").isin("article", "recipients", "signature", "decision_heading")
    is_type = lambda *t: F.col("node_type").isin(*t)
    label = F.when(F.col("node_type") == "article", F.concat(F.lit("Điều "), F.regexp_extract("text", ARTICLE, 1))).when(F.col("node_type") == "clause", F.concat(F.lit("Khoản "), F.regexp_extract("text", CLAUSE, 1))).when(F.col("node_type") == "point", F.concat(F.lit("Điểm "), F.regexp_extract("text", POINT, 1)))
    rows = rows.withColumn("_label", label)
    rows = rows.withColumn("_decision", at(is_type("decision_heading"))).withColumn("_article", F.when(F.col("mode") == "article", at(is_type("article")))).withColumn("_recipients", at(is_type("recipients")))
    rows = rows.withColumn("_clause", F.when(F.col("mode") == "article", since(is_type("clause"), closing))).withColumn("_point", F.when(F.col("mode") == "article", since(is_type("point"), closing | is_type("clause"))))
    named = lambda t: F.last(F.when(F.col("node_type") == t, F.col("_label")), ignorenulls=True).over(upto)
    rows = rows.withColumn("_article_label", named("article")).withColumn("_clause_label", named("clause")).withColumn("_point_label", named("point"))
    # the decision an article belongs to is the one before the article
    rows = rows.withColumn("_over", F.last(F.when(F.col("node_type") == "article", F.coalesce("_decision", F.lit(0))), ignorenulls=True).over(upto))
    first_at = lambda c: F.max(F.when(F.col("seq") == F.col(c), F.col("ordinal") - 1)).over(Window.partitionBy("document_id"))
    rows = rows.withColumn("_pre_at", first_at("_preamble")).withColumn("_meta_at", first_at("_metadata"))
    # where both virtual nodes would begin at one line only one does: a line is either a legal basis or loose
    seen = lambda c: F.when(F.col(c) <= F.col("seq"), True)
    pre_at, meta_at = F.when(seen("_preamble"), F.col("_pre_at")), F.when(seen("_metadata"), F.col("_meta_at"))
    art = F.when(F.col("_over") > 0, F.array(F.lit(1), "_over", "_article")).otherwise(F.array(F.lit(1), F.col("_article")))
    root = F.array(F.lit(1))
    deep = lambda *more: F.array_compact(F.concat(art, F.array(*more)))
    above = (
        F.when(is_type("article"), F.when(F.col("_decision").isNotNull(), F.array(F.lit(1), "_decision")).otherwise(root)).when(is_type("recipients", "signature", "decision_heading"), root).when(is_type("legal_basis"), F.array(F.lit(1), F.col("_pre_at")))
        .when(is_type("table"), F.when(F.col("_article").isNotNull(), art).when(F.col("_decision").isNotNull(), F.array(F.lit(1), "_decision")).when(pre_at.isNotNull(), F.array(F.lit(1), pre_at)).when(meta_at.isNotNull(), F.array(F.lit(1), meta_at)).otherwise(root))
        .when(is_type("recipient_item"), F.array(F.lit(1), "_recipients")).when(is_type("clause"), art).when(is_type("point"), deep(F.col("_clause")))
        .when(F.col("mode") == "article", F.when(F.col("_point").isNotNull(), deep(F.col("_clause"), F.col("_point"))).otherwise(deep(F.col("_clause"))))
        .when(F.col("mode") == "legal_basis", F.array(F.lit(1), F.col("_pre_at"))).when(F.col("mode") == "decision_heading", F.array(F.lit(1), "_decision")).otherwise(F.array(F.lit(1), F.col("_meta_at")))
    )
    rows = rows.withColumn("_above", above)
    titles = F.array_compact(F.array(
        F.when(is_type("decision_heading") | (F.col("mode") == "decision_heading") & ~is_type("table", "recipient_item") | (F.col("mode") == "article") & (F.col("_over") > 0) & ~is_type("article") | is_type("article") & F.col("_decision").isNotNull() | is_type("table") & F.array_contains("_above", F.coalesce("_decision", F.lit(0))), "QUYẾT ĐỊNH"),
        F.when(is_type("legal_basis") | F.array_contains("_above", F.coalesce("_pre_at", F.lit(0))), "Phần căn cứ"), F.when(F.array_contains("_above", F.coalesce("_meta_at", F.lit(0))), "Thông tin văn bản"),
        F.when((F.col("mode") == "article") & ~is_type("recipients"), F.col("_article_label")), F.when((F.col("mode") == "article") & is_type("clause") | F.array_contains("_above", F.coalesce("_clause", F.lit(0))), F.col("_clause_label")),
        F.when((F.col("mode") == "article") & is_type("point") | F.array_contains("_above", F.coalesce("_point", F.lit(0))), F.col("_point_label")),
        F.when(is_type("recipients", "recipient_item"), "Nơi nhận"), F.when(is_type("signature"), "Chữ ký"), F.when(is_type("table"), "Bảng"),
    ))
    rows = rows.withColumn("section_path", titles)
    title = F.coalesce("_label", F.when(is_type("decision_heading"), "QUYẾT ĐỊNH").when(is_type("recipients"), "Nơi nhận").when(is_type("signature"), "Chữ ký").when(is_type("table"), "Bảng"))
    # a line makes a part of its node and, where it is the first of its kind, the virtual node before it
    part = lambda ordinal, node, named, words, block, path, over, segment: F.struct(ordinal.cast("long").alias("ordinal"), node.alias("node_type"), named.alias("title"), words.alias("text"), "page", block.alias("block_id"), over.cast("array<bigint>").alias("above"), path.alias("section_path"), "seq", segment.cast("int").alias("segment"))
    virtual = lambda first, ordinal, node, named: F.when(F.col("seq") == F.col(first), part(F.col(ordinal), F.lit(node), F.lit(named), F.lit(""), F.lit(None).cast("string"), F.array(F.lit(named)), root, F.lit(-1)))
    own_part = part(F.col("ordinal"), F.col("node_type"), title, F.col("text"), F.col("block_id"), F.col("section_path"), F.col("_above"), F.col("segment"))
    parts = F.array_compact(F.array(own_part, virtual("_preamble", "_pre_at", "preamble", "Phần căn cứ"), virtual("_metadata", "_meta_at", "metadata", "Thông tin văn bản")))
    lines_of = F.array_sort(F.collect_list(F.struct("seq", "text", "block_id")))
    nodes = rows.select("document_id", F.explode(parts).alias("_p")).select("document_id", "_p.*").groupBy("document_id", "ordinal").agg(
        F.min_by("node_type", "seq").alias("node_type"), F.min_by("title", "seq").alias("title"), F.array_join(F.transform(lines_of, lambda x: x["text"]), "\n").alias("text"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        F.min_by("block_id", "seq").alias("block_id"), F.array_distinct(F.array_compact(F.transform(lines_of, lambda x: x["block_id"]))).alias("blocks"), F.min_by("above", "seq").alias("above"), F.min_by("section_path", "seq").alias("section_path"), F.min("seq").alias("seq"), F.min_by("segment", "seq").alias("segment"),
    )
    name = F.concat_ws(":", F.lit("v2:node"), "node_type", F.coalesce("block_id", F.concat(F.lit("virtual-"), F.col("ordinal").cast("string"))), F.col("ordinal").cast("string"))
    return nodes.select("document_id", "ordinal", I.stable_id("document_id", name).alias("node_id"), "node_type", "title", "text", "page_start", "page_end", "block_id", "blocks", F.element_at("above", -1).alias("parent_ordinal"), F.concat("above", F.array("ordinal")).alias("ancestors"), "section_path", "seq", "segment")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """document_id, ordinal, pages and source blocks of each node with all that is below it, sources in tree order."""
    up = nodes.select("document_id", F.explode("ancestors").alias("node"), "page_start", "page_end", "blocks", "ancestors")
    ordered = F.array_sort(F.collect_list(F.struct("ancestors", "blocks")))
    return up.groupBy("document_id", F.col("node").alias("ordinal")).agg(F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"), F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["blocks"]))).alias("source_block_ids"))


def units(nodes: DataFrame, recipients: bool = True, signature: bool = True) -> DataFrame:
    """The nodes that become text units, each with its primary parent (article, preamble, recipients, signature, metadata, decision or document)."""
    primary = nodes.where(F.col("node_type").isin(*PRIMARY)).select("document_id", F.col("ordinal").alias("p"), F.col("node_type").alias("parent_type"))
    rows = nodes.where(~F.col("node_type").isin("table", "preamble", "metadata") & (F.trim("text") != ""))
    if not recipients:
        rows = rows.where(~F.col("node_type").isin("recipients", "recipient_item"))
    if not signature:
        rows = rows.where("node_type <> 'signature'")
    chain = rows.select("document_id", "ordinal", F.posexplode("ancestors").alias("depth", "p")).join(primary, ["document_id", "p"])
    nearest = chain.groupBy("document_id", "ordinal").agg(F.max_by("p", "depth").alias("primary"), F.max_by("parent_type", "depth").alias("parent_type"))
    kind = F.col("node_type")
    for node, unit in UNIT_TYPES.items():
        kind = F.when(F.col("node_type") == node, F.lit(unit)).otherwise(kind)
    return rows.join(nearest, ["document_id", "ordinal"], "left").select("document_id", "ordinal", kind.alias("unit_type"), F.coalesce("primary", F.lit(1)).alias("primary"), F.coalesce("parent_type", F.lit("document")).alias("parent_type"), "section_path", "text", "page_start", "page_end", "block_id", "blocks", "seq", "segment")


def deepest_node(nodes: DataFrame) -> DataFrame:
    """The last node in tree order of each source block."""
    rows = nodes.select("document_id", "ordinal", "ancestors", F.explode("blocks").alias("block_id"))
    return rows.groupBy("document_id", "block_id").agg(F.max_by("ordinal", "ancestors").alias("ordinal"))
