"""The metadata extract: file aliases, lookups, upserts and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_labels(meta: DataFrame) -> DataFrame:
    """id, label of the file (``_`` without one) and url, which is null without a path."""
    label = F.concat(F.coalesce("fileidminio", F.lit("")), F.lit("_"), F.coalesce("filenameminio", F.lit("")))
    return meta.select("id", label.alias("file_label"), F.concat(F.lit("minio://"), F.col("filepathminio")).alias("url")).distinct()


def _aliases(meta: DataFrame) -> DataFrame:
    stem = F.regexp_replace("filenameminio", r"\.[^.]*$", "")
    paged = F.concat("fileidminio", F.lit("_"), "page")
    rows = meta.where(F.trim(F.coalesce("id", F.lit(""))) != "").select("id", F.explode(F.array(stem, F.col("fileidminio"), paged)).alias("alias"))
    return rows.select(F.lower("alias").alias("alias"), "id").where(~F.trim(F.coalesce("alias", F.lit(""))).isin("", "_"))


def alias_index(meta: DataFrame) -> DataFrame:
    """Every name under which a document's file may turn up, with the document's id."""
    return _aliases(meta).distinct()


def alias_conflicts(meta: DataFrame) -> DataFrame:
    """Aliases that stand for more than one document; a strict load fails if there are any."""
    return _aliases(meta).groupBy("alias").agg(F.countDistinct("id").alias("ids")).where("ids > 1")


def require_no_conflicts(meta: DataFrame) -> DataFrame:
    """The alias index, raising where one alias stands for two documents."""
    ids = _aliases(meta).groupBy("alias").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    checked = F.when(F.col("id") == F.col("last"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("one alias, two documents: "), F.col("alias"))))
    return ids.select("alias", checked.alias("id"))


def by_id(meta: DataFrame) -> DataFrame:
    """One row a document, keyed by its id in lower case; of several rows the least values."""
    return meta.where("id is not null").groupBy(F.lower("id").alias("key")).agg(F.min("doc_no").alias("doc_no"), F.min("author").alias("author"), F.min("summary").alias("summary"), F.min("datedocument").alias("datedocument"))


def resolve(rows: DataFrame, stem: str, index: DataFrame) -> DataFrame:
    """Rows whose file stem, in any case, names a document, with its metadata."""
    return rows.join(index, F.lower(F.col(stem)) == F.col("key")).drop("key")


def unresolved(rows: DataFrame, stem: str, index: DataFrame) -> DataFrame:
    return rows.join(index, F.lower(F.col(stem)) == F.col("key"), "left_anti")


def upsert(rows: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """One row a key, the newest by the given columns (later wins, nulls lose)."""
    order = Window.partitionBy(*key).orderBy(*(F.col(c).desc_nulls_last() for c in newest))
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def pareto(rows: DataFrame, group: str, more: str, less: str) -> DataFrame:
    """Rows of a group that no other beats: none has at least as much of ``more`` and at most as much of ``less``, and one of them strictly.

    One sort per group: a row stays if its ``less`` is below all with greater
    ``more`` and least among those with equal ``more``.
    """
    best = rows.groupBy(group, more).agg(F.min(less).alias("_least"))
    above = Window.partitionBy(group).orderBy(F.col(more).desc()).rowsBetween(Window.unboundedPreceding, -1)
    kept = best.withColumn("_bar", F.min("_least").over(above)).where("_bar is null or _least < _bar").select(group, more, "_least")
    return rows.join(kept, [group, more]).where(F.col(less) == F.col("_least")).drop("_least")


_FORMATS = ("yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy")


def dates(rows: DataFrame, column: str, out: str = "date") -> DataFrame:
    """``rows`` with the date a text names in any of the usual forms, else null; the text itself is kept."""
    text: Column = F.col(column)
    spoken = F.regexp_replace(text, r"^ngày (\d+) tháng (\d+) năm (\d+)$", "$1/$2/$3")
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in _FORMATS] + [F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")), F.try_to_timestamp(spoken, F.lit("d/M/yyyy")), F.try_to_timestamp(text, F.lit("yyyyMMdd"))]
    return rows.withColumn(out, F.coalesce(*tries).cast("date"))


def document_objects(meta: DataFrame) -> DataFrame:
    """One object a document; the organisation falls back to the author."""
    rows = meta.where(F.trim(F.coalesce("id", F.lit(""))) != "").groupBy(F.col("id").alias("document_id"))
    organisation = F.coalesce(F.nullif(F.trim(F.max("organizationid")), F.lit("")), F.max("author"))
    return rows.agg(F.max("doc_no").alias("doc_no"), organisation.alias("organization_id"), F.max("recordid").alias("record_id"), F.max("boxcode").alias("box_code"), F.max("fileidminio").alias("file_id"))


def object_name(path: Column, name: Column) -> Column:
    """The object of a path and a file name: joined unless the path ends in the name; no slashes at the front."""
    base = F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", "")
    joined = F.when(base == "", F.coalesce(name, F.lit(""))).when(name.isNull() | base.endswith(name), base).otherwise(F.concat(base, F.lit("/"), name))
    return F.regexp_replace(joined, "^/+", "")
