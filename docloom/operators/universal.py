"""What a document's type and parts say: markers and profiles, header fields, parties, annexes, addressees, typed prefixes, gates and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as X

# Markers in order of precedence with their canonical level and pattern over the match key (``case``: over the text as written).
MARKERS = (
    ("annex", 0, r"^\s*phu\s*luc\b"), ("recipients", None, r"^\s*noi\s+nhan\s*[:.]?"), ("signature", None, r"^\s*(?:kt\.?\s+|tl\.?\s+|tuq\.?\s+)?(?:pho\s+)?(?:hieu truong|giam doc|chu tich|thu truong|bo truong)\b"),
    ("part", 0, r"^\s*phan\s+(?:thu\s+)?(?:[0-9]+|[ivxlcdm]+|mot|hai|ba|tu|nam|sau|bay|tam|chin|muoi)\b"), ("chapter", 0, r"^\s*chuong\s+(?:[0-9]+|[ivxlcdm]+)\b"), ("section", 1, r"^\s*muc\s+(?:[0-9]+|[ivxlcdm]+)\b"),
    ("article", 2, r"^\s*dieu\s+\d+[a-z]?\s*[:.\-]"), ("clause", 3, r"^\s*khoan\s+\d+(?:\.\d+)*\b"), ("semantic", 1, r"^\s*(?:su can thiet|noi dung trinh|kien nghi|co so phap ly|to chuc thuc hien|dieu khoan chung)\s*[:.]?\s*$"),
    ("decimal", 3, r"^\s*\d+(?:\.\d+)+\s*[.)]?\s+\D"), ("number", 2, r"^\s*\d{1,3}\s*[.)]\s+"),
)
CASED = (("roman", 1, r"^\s*[IVXLCDM]+\s*[.)]\s+"), ("upper_alpha", 1, r"^\s*[A-ZĐ]\s*[.)]\s+"), ("lower_alpha", 3, r"^\s*[a-zđ]\s*[.)]\s+"))
ORDER = (*(m[0] for m in MARKERS[:9]), "roman", "decimal", "number", "upper_alpha", "lower_alpha")
# Which markers split a document of each type.
PROFILES = {
    "DECISION": ("annex", "recipients", "signature", "article", "clause", "number", "lower_alpha"), "CONTRACT": ("annex", "signature", "part", "chapter", "section", "roman", "article", "clause", "decimal", "number", "lower_alpha", "upper_alpha"),
    "PROPOSAL": ("annex", "recipients", "signature", "semantic", "roman", "upper_alpha", "decimal", "number", "lower_alpha"), "OFFICIAL_LETTER": ("annex", "recipients", "signature", "roman", "number", "lower_alpha"),
    "UNKNOWN": ("annex", "recipients", "part", "chapter", "section", "article"),
}
NAMES = {"DECISION": "Quyết định", "CONTRACT": "Hợp đồng", "PROPOSAL": "Tờ trình", "OFFICIAL_LETTER": "Công văn"}
# Fields of a document's head, and of a party, with the words before their colon.
HEADER = (
    ("motto", r"^\s*(?:cong hoa xa hoi chu nghia|doc lap\s*[-–]\s*tu do)"), ("number", r"^\s*so(?:\s*/\s*ky hieu|\s+ky hieu)?\s*:"), ("symbol", r"^\s*ky hieu\s*:"), ("date", r"(?:^|,)\s*ngay\s+\d{1,2}\s+thang\s+\d{1,2}\s+nam\s+\d{4}\s*$"),
)
LEGAL_BASIS = r"^\s*(?:-\s*)?(?:can cu(?: vao| tren co so)?|theo de nghi|xet de nghi)\b"
PARTY_FIELDS = {
    "party_name": ("ten don vi", "ten doanh nghiep", "ten"), "address": ("dia chi", "tru so"), "tax_code": ("ma so thue", "mst"), "representative": ("nguoi dai dien", "dai dien"), "title": ("chuc vu",), "account_number": ("so tai khoan", "tai khoan"), "bank": ("tai ngan hang", "ngan hang"),
    "phone": ("dien thoai", "dt"), "email": ("e-mail", "email"),
}
PARTY = r"^\s*ben\s+(a|b|c|d|mua|ban|thue|cho thue|cung cap)\b"
TABLE_TYPES = {
    "PAYMENT_SCHEDULE": ("dot thanh toan", "ty le", "dieu kien thanh toan", "thoi han", "gia tri thanh toan"), "PRICE_SCHEDULE": ("don gia", "thanh tien", "gia", "vat"), "QUANTITY_SCHEDULE": ("khoi luong", "so luong", "don vi tinh", "dvt"),
    "TECHNICAL_SPECIFICATION": ("thong so", "yeu cau ky thuat", "tieu chuan", "cau hinh"), "PARTY_CONTACT_TABLE": ("ho va ten", "so dinh danh", "dia chi", "dien thoai", "email", "chuc vu"),
}


def lines_of(df: DataFrame, document: str, text: str) -> DataFrame:
    """The lines of plain texts as spans: document_id, at (from 1), text, and what they look like without any layout."""
    from docloom.operators import outline

    rows = df.where(F.col(text).isNotNull()).select(F.col(document).cast("string").alias("document_id"), F.posexplode(F.split(F.col(text), "\n")).alias("_i", "text"))
    rows = rows.select("document_id", (F.col("_i") + 1).cast("long").alias("at"), F.trim("text").alias("text"), F.lit("text").alias("block_type"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(1).alias("page")).where("text <> ''")
    return outline.features(rows)


def markers(rows: DataFrame) -> DataFrame:
    """Spans (with ``key``) that begin with a marker: marker_type, ordinal as written, canonical_level, inferred_depth. The first in the order of precedence counts."""
    known = {name: (level, F.col("key").rlike(rule)) for name, level, rule in MARKERS} | {name: (level, F.col("text").rlike(rule)) for name, level, rule in CASED}
    kind, level = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name in reversed(ORDER):
        lv, hit = known[name]
        kind, level = F.when(hit, name).otherwise(kind), F.when(hit, F.lit(lv).cast("int")).otherwise(level)
    ordinal = F.regexp_extract("key", r"^\s*(?:[a-z]{3,}(?:\s+luc|\s+thu)?\s+)?(?:so\s+)?([0-9]+(?:\.[0-9]+)*[a-z]?|[ivxlcdm]+|[a-z])\s*(?:[.:)\-]|\s|$)", 1)
    made = rows.withColumn("marker_type", kind).where("marker_type is not null").withColumn("canonical_level", level)
    depth = F.when(F.col("marker_type") == "decimal", F.regexp_count(F.regexp_extract("key", r"^\s*(\d+(?:\.\d+)+)", 1), F.lit(r"\.")) + 1).otherwise(F.lit(1))
    return made.withColumn("ordinal", F.when(F.col("marker_type").isin("recipients", "signature", "semantic"), F.lit("")).otherwise(ordinal)).withColumn("inferred_depth", depth.cast("int"))


def profiles(spark: SparkSession) -> DataFrame:
    """doc_type and marker_type of every marker that a type's profile enables."""
    return spark.createDataFrame([(kind, marker) for kind, names in PROFILES.items() for marker in names], "doc_type string, marker_type string")


def profiled(marked: DataFrame, types: DataFrame) -> DataFrame:
    """Markers with the type of their document and whether its profile enables them; a document without a type has the careful profile."""
    rows = marked.join(types.select("document_id", "doc_type"), "document_id", "left").withColumn("doc_type", F.coalesce("doc_type", F.lit("UNKNOWN")))
    return rows.join(F.broadcast(profiles(marked.sparkSession).withColumn("enabled", F.lit(True))), ["doc_type", "marker_type"], "left").withColumn("enabled", F.coalesce("enabled", F.lit(False)))  # some fifty fixed rows


def header_fields(rows: DataFrame) -> DataFrame:
    """Spans (of ``outline.candidates``) that are a field of the document's head: motto, number, symbol, date, issuer, legal_basis.

    A legal basis stands before the first accepted heading; "căn cứ" inside a
    sentence or further down is text. Fields stay off the outline.
    """
    field = F.lit(None).cast("string")
    for name, rule in reversed(HEADER):
        field = F.when(F.col("key").rlike(rule), name).otherwise(field)
    opened = F.max(F.when(F.col("accepted") & ~F.col("kind").isin("bullet", "semantic_heading"), 1)).over(Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    issuer = F.col("key").rlike(r"^\s*(?:bo|truong|uy ban|so|phong|vien|trung tam)\s") & (F.col("uppercase_ratio") >= 0.75)
    field = F.coalesce(field, F.when(opened.isNull() & F.col("key").rlike(LEGAL_BASIS), "legal_basis").when(opened.isNull() & issuer, "issuer"))
    return rows.withColumn("field", field).where("field is not null")


def party_fields(rows: DataFrame) -> DataFrame:
    """document_id, at, party (its label), field and value in the regions of parties of a contract.

    A region begins at a party's label and ends at the next one, at "hai bên
    thống nhất" and the like, or at an accepted article, chapter or part. A value
    is what stands after a known word and a colon; the rest of the label's own
    line is the party's name.
    """
    label = F.nullif(F.regexp_extract("key", PARTY, 1), F.lit(""))
    stop = F.col("key").rlike(r"^\s*(?:hai|cac) ben\s+(?:thong nhat|thoa thuan|cung)") | F.col("accepted") & F.col("kind").isin("article", "chapter", "part")
    upto = Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_l", label).withColumn("_in", F.last(F.when(F.col("_l").isNotNull(), F.col("_l")).when(stop, "")  , ignorenulls=True).over(upto))
    field = F.when(F.col("_l").isNotNull(), "party_name")
    for name, words in PARTY_FIELDS.items():
        field = field.when(F.col("key").rlike(r"^\s*[-+]?\s*(?:" + "|".join(words) + r")\s*:"), name)
    value = F.trim(F.regexp_replace("text", r"^[^:]*:", ""))
    made = rows.where("_in <> ''").withColumn("field", field).where("field is not null").withColumn("value", F.when(F.col("text").contains(":"), value).otherwise(F.trim("text")))
    return made.where("value <> ''").select("document_id", "at", F.upper("_in").alias("party"), "field", "value")


def annexes(rows: DataFrame) -> DataFrame:
    """document_id, at, ordinal, title and the line of reference ("kèm theo …") of each annex; rows as of ``outline.candidates``."""
    order = Window.partitionBy("document_id").orderBy("at")
    after, after_key = F.lead("text").over(order), F.lead("key").over(order)
    ordinal = F.upper(F.regexp_extract("key", r"^\s*phu\s*luc(?:\s+hop dong)?\s+(?:so\s+)?([0-9]+|[ivxlcdm]+)\b", 1))
    title = F.trim(F.regexp_replace("text", r"(?iu)^\s*ph\S+\s+l\S+(?:\s+(?:số\s+)?(?:[0-9]+|[ivxlcdm]+)(?![\p{L}\p{N}]))?\s*[:.–-]*", ""))
    marked = rows.select("document_id", "at", "kind", "accepted", ordinal.alias("ordinal"), title.alias("title"), F.when(after_key.rlike(r"^\s*\(?\s*kem theo\b"), after).alias("reference"))
    return marked.where("kind = 'annex' and accepted").select("document_id", "at", "ordinal", "title", "reference")


def annex_mentions(rows: DataFrame, found: DataFrame) -> DataFrame:
    """document_id, at, ordinal, article of every mention of an annex inside text, with the annex (``annex_at``) whose ordinal is the same, null if none or several are.

    ``article`` is the number of the article the line names with it.
    """
    inside = F.regexp_extract_all("key", F.lit(r"\bphu\s*luc\s+(?:so\s+)?([0-9]+|[ivxlcdm]+)\b"), F.lit(1))
    article = F.nullif(F.regexp_extract("key", r"\bdieu\s+(\d+)", 1), F.lit(""))
    said = rows.where(~(F.coalesce(F.col("kind") == "annex", F.lit(False)) & F.col("accepted"))).select("document_id", "at", F.explode(inside).alias("ordinal"), article.alias("article")).withColumn("ordinal", F.upper("ordinal"))
    one = found.groupBy("document_id", "ordinal").agg(F.min("at").alias("annex_at"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return said.join(one, ["document_id", "ordinal"], "left").select("document_id", "at", "ordinal", "article", "annex_at")


def addressees(rows: DataFrame) -> DataFrame:
    """document_id, names (in order) and primary of "Kính gửi": the line's own rest and the list lines that follow it. ``primary`` is null unless there is one name."""
    upto = Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head, item = F.col("key").rlike(r"^\s*kinh gui\b"), F.col("text").rlike(r"^\s*[-–+•]\s+")
    open_ = F.last(F.when(head, True).when(~item, False), ignorenulls=True).over(upto)
    name = F.when(head, F.regexp_replace("text", r"(?iu)^\s*kính\s+gửi\s*:?\s*", "")).otherwise(F.regexp_replace("text", r"^\s*[-–+•]\s+", ""))
    found = rows.withColumn("_open", open_).where("_open").select("document_id", "at", F.regexp_replace(F.trim(name), r"[\s;.,]+$", "").alias("name")).where("name <> ''")
    names = F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])
    return found.groupBy("document_id").agg(names.alias("names")).withColumn("primary", F.when(F.size("names") == 1, F.col("names")[0]))


def table_types(tables: DataFrame, key: str, least: int = 2) -> DataFrame:
    """key and semantic type of parsed tables: course transfers by their schema, else the type with most headers of its own (at least ``least``), else GENERIC."""
    heads = F.transform("headers", lambda h: h)
    rows = tables.where("error is null").select(key, "schema_type", X.match_key(F.array_join(heads, "\n")).alias("_k")).withColumn("_h", F.split("_k", "\n"))

    def has(name: str) -> Column:
        return F.exists("_h", lambda h: h.rlike(rf"\b{name}\b")).cast("int")

    score = lambda names: reduce(lambda a, b: a + b, map(has, names))
    scores = F.array(*(F.struct(score(names).alias("s"), F.lit(-i).alias("i"), F.lit(kind).alias("k")) for i, (kind, names) in enumerate(TABLE_TYPES.items())))
    best = F.array_max(scores)
    return rows.withColumn("_b", best).select(key, F.when(F.col("schema_type") == "course_transfer", "COURSE_TRANSFER").when(F.col("_b.s") >= least, F.col("_b.k")).otherwise("GENERIC").alias("table_type"))


def typed_prefix(doc_type: Column, title: Column, number: Column, issuer: Column, recipients: Column, parties: Column, annex: Column, path: Column, most: int = 64) -> Column:
    """The lines before a chunk's text, by the type of its document; blank fields give none.

    ``recipients``, ``parties`` and ``path`` are arrays. Over ``most`` tokens the
    prefix is shortened step by step: three recipients, no parties but the first,
    the last two labels of the path; what then is still too long stays.
    """
    line = lambda name, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(name + ": "), F.trim(c)))
    some = lambda names, n: F.array_join(F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, n) if n else F.coalesce(names, F.array().cast("array<string>")), ", ")
    display = F.lit(None).cast("string")
    for kind, name in NAMES.items():
        display = F.when(doc_type == kind, name).otherwise(display)
    what = F.when(doc_type == "CONTRACT", "Hợp đồng").when(doc_type == "OFFICIAL_LETTER", "Trích yếu").otherwise("Văn bản")
    who = F.when(doc_type == "OFFICIAL_LETTER", "Cơ quan gửi").otherwise("Cơ quan ban hành")
    labels = F.coalesce(path, F.array().cast("array<string>"))

    def made(n_names: int, n_parties: int, n_labels: int) -> Column:
        short = F.when(F.size(labels) > n_labels, F.slice(labels, -n_labels, n_labels)).otherwise(labels) if n_labels else labels
        titled = F.when(F.trim(F.coalesce(title, F.lit(""))) != "", F.concat(what, F.lit(": "), F.trim(title)))
        sent = F.when((F.trim(F.coalesce(issuer, F.lit(""))) != "") & (F.coalesce(doc_type, F.lit("")) != "CONTRACT") & (F.coalesce(doc_type, F.lit("")) != "PROPOSAL"), F.concat(who, F.lit(": "), F.trim(issuer)))
        to = F.when(doc_type.isin("PROPOSAL", "OFFICIAL_LETTER"), line("Kính gửi", some(recipients, n_names)))
        sides = F.when(doc_type == "CONTRACT", line("Các bên", some(parties, n_parties)))
        return F.concat_ws("\n", line("Loại văn bản", display), titled, line("Số", number), sent, sides, to, line("Phụ lục", annex), line("Phần", F.array_join(short, " > ")))

    steps = [made(0, 0, 0), made(3, 0, 0), made(3, 1, 0), made(3, 1, 2)]
    out = steps[-1]
    for step in reversed(steps[:-1]):
        out = F.when(X.token_count(step, 0) <= most, step).otherwise(out)
    return out


def chunk_violations(children: DataFrame, parents: DataFrame, text: str, most: int = 256) -> DataFrame:
    """chunk_id and rule of stored children that the third gate stops: too long, no parent, no path, a table row without its table, empty, without a source."""
    known = parents.select(F.col("chunk_id").alias("_p")).distinct()
    rows = children.join(known, F.col("parent_id") == F.col("_p"), "left")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    row = F.coalesce(F.col("chunk_type") == "table_row", F.lit(False))
    broken = F.array_compact(F.array(
        F.when(X.token_count(F.coalesce(F.col(text), F.lit(""))) > most, "too long"), F.when(F.col("_p").isNull(), "no parent"), F.when(~some("section_path"), "no path"), F.when(row & F.col("parent_id").isNull(), "row without table"),
        F.when(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < 2, "empty"), F.when(~some("source_block_ids"), "no source"),
    ))
    return rows.select("chunk_id", F.explode(broken).alias("rule"))


def chunk_audit(chunks: DataFrame) -> DataFrame:
    """One row a document of stored chunks: parents, children, tokens (mean, 95th percentile interpolated, most), how children were split, table rows, chunks over several pages."""
    child = F.col("record_type") == "child"
    tokens = F.when(child, F.col("token_count"))
    method = F.element_at("metadata", F.lit("method"))
    return chunks.groupBy("document_id").agg(
        F.count_if(F.col("record_type") == "parent").alias("parents"), F.count_if(child).alias("children"), F.round(F.avg(tokens), 4).alias("mean_tokens"), F.round(F.percentile(tokens, F.lit(0.95)), 4).alias("p95_tokens"), F.max(tokens).alias("max_tokens"),
        F.count_if(child & (method == "token_window")).alias("window_splits"), F.count_if(child & (F.col("chunk_type") == "table_row")).alias("table_rows"), F.count_if(F.col("page_end") > F.col("page_start")).alias("over_pages"),
    )


def search(hits: DataFrame, parent: Column, k: int, most: int = 3, rerank: Column | None = None) -> DataFrame:
    """Hits (query_id, score, rank) of a child search, at most ``most`` of a parent, ordered again by ``rerank`` if one is given, cut to k."""
    from docloom.operators import retrieval as R

    kept = R.per_parent(hits, parent, most, "query_id")
    order = [F.col("rank")] if rerank is None else [F.round(rerank, 9).desc(), F.col("rank")]
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def neighbours(rows: DataFrame, parent: str, key: str, reach: int = 1) -> DataFrame:
    """Each row of a parent with the keys of up to ``reach`` rows before and after it (``window``), instead of a whole long parent."""
    near = Window.partitionBy(parent).orderBy(key).rowsBetween(-reach, reach)
    return rows.withColumn("window", F.array_remove(F.collect_list(key).over(near), F.col(key)))
