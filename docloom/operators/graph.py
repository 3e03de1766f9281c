"""The property graph of documents, persons and events, as node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import ids as I

# Words that tell the kind of an event, in order of precedence.
EVENT_WORDS = {"DISCIPLINARY_ACTION": ("kỷ luật", "khiển trách", "cảnh cáo", "đình chỉ"), "REWARD": ("khen thưởng", "tuyên dương", "khen"), "DECISION": ("quyết định", "áp dụng", "ban hành")}
LABELS = {"Organization": ("organizationid", "author"), "DocumentBlock": ("documentblockcode", "documentblockname"), "TableOfContent": ("tableofcontentcode", "tableofcontentname"), "Box": ("boxcode", None), "RecordType": ("recordtypecode", "recordtypename"), "Record": ("recordid", "recordname"), "Document": ("id", "summary"), "FileObject": ("fileidminio", "filenameminio")}
RELATIONS = {"MANAGES": ("Organization", "DocumentBlock"), "HAS_TOC": ("DocumentBlock", "TableOfContent"), "CONTAINS_BOX": ("TableOfContent", "Box"), "CONTAINS_RECORD": ("Box", "Record"), "HAS_TYPE": ("Record", "RecordType"), "HAS_DOCUMENT": ("Record", "Document"), "STORED_AS": ("Document", "FileObject")}


def archive_nodes(meta: DataFrame) -> DataFrame:
    """label, id and name of every node of the archive; of several names the one that came last."""
    parts = [meta.select(F.lit(label).alias("label"), F.col(key).alias("id"), (F.col(name) if name else F.lit(None).cast("string")).alias("name"), F.struct(F.coalesce("ingested_at", F.lit(0).cast("timestamp")), F.coalesce(F.col(name) if name else F.lit(""), F.lit(""))).alias("at")) for label, (key, name) in LABELS.items()]
    rows = reduce(DataFrame.unionByName, parts).where("id is not null")
    return rows.groupBy("label", "id").agg(F.max_by("name", "at").alias("name"))


def archive_edges(meta: DataFrame) -> DataFrame:
    """src, relation, dst of the archive, each once; an edge needs both ends."""
    parts = [meta.select(F.col(LABELS[a][0]).alias("src"), F.lit(relation).alias("relation"), F.col(LABELS[b][0]).alias("dst")) for relation, (a, b) in RELATIONS.items()]
    return reduce(DataFrame.unionByName, parts).where("src is not null and dst is not null").distinct()


def mentions(found: DataFrame) -> DataFrame:
    """One row a name found in a document: document_id, person, person_id, event_type (upper case), description, event_id."""
    rows = found.where("document_id is not null and name is not null and trim(name) <> ''")
    return rows.select(F.lower("document_id").alias("document_id"), F.trim("name").alias("person"), I.slug("person", "name").alias("person_id"), F.upper("event_type").alias("event_type"), F.nullif(F.trim("description"), F.lit("")).alias("description"), F.when(F.col("event_type").isNotNull(), I.slug("event", F.concat_ws("_", F.upper("event_type"), F.trim("name")))).alias("event_id")).distinct()


def semantic_nodes(rows: DataFrame) -> DataFrame:
    """Person and Event nodes out of ``mentions``; names whose ids collide share a node, with the greatest name."""
    persons = rows.groupBy(F.col("person_id").alias("id")).agg(F.max("person").alias("name")).select(F.lit("Person").alias("label"), "id", "name")
    events = rows.where("event_id is not null").groupBy(F.col("event_id").alias("id")).agg(F.max("event_type").alias("name")).select(F.lit("Event").alias("label"), "id", "name")
    return persons.unionByName(events)


def semantic_edges(rows: DataFrame) -> DataFrame:
    """MENTIONS and DESCRIBES from documents, APPLIES_TO from each event to its person."""
    a = rows.select(F.col("document_id").alias("src"), F.lit("MENTIONS").alias("relation"), F.col("person_id").alias("dst"))
    b = rows.where("event_id is not null").select(F.col("document_id").alias("src"), F.lit("DESCRIBES").alias("relation"), F.col("event_id").alias("dst"))
    c = rows.where("event_id is not null").select(F.col("event_id").alias("src"), F.lit("APPLIES_TO").alias("relation"), F.col("person_id").alias("dst"))
    return a.unionByName(b).unionByName(c).distinct()


def single_links(rows: DataFrame) -> DataFrame:
    """event_id and person_id of documents that name exactly one person and one event description."""
    per = rows.groupBy("document_id").agg(F.countDistinct("person_id").alias("p"), F.countDistinct("description").alias("e"), F.min("person_id").alias("person_id"), F.min("description").alias("description"))
    return per.where("p = 1 and e = 1").select("document_id", I.slug("event", "description").alias("event_id"), "person_id")


def name_collisions(rows: DataFrame) -> DataFrame:
    """Person ids that stand for more than one name, as ids keep ASCII letters only."""
    return rows.groupBy("person_id").agg(F.countDistinct("person").alias("names")).where("names > 1")


def documents_of(edges: DataFrame, nodes: DataFrame, person: str | None = None, event_type: str | None = None) -> DataFrame:
    """Documents that describe an event of the type which applies to the person; with one of the two, of either alone."""
    if person is None and event_type is None:
        raise ValueError("a person, an event type or both")
    describes = edges.where("relation = 'DESCRIBES'").select(F.col("src").alias("document_id"), F.col("dst").alias("event"))
    hits = describes
    if event_type is not None:
        hits = hits.join(nodes.where((F.col("label") == "Event") & (F.col("name") == event_type)).select(F.col("id").alias("event")), "event", "left_semi")
    if person is not None:
        whom = nodes.where((F.col("label") == "Person") & (F.col("name") == person)).select(F.col("id").alias("dst"))
        applies = edges.where("relation = 'APPLIES_TO'").join(whom, "dst", "left_semi").select(F.col("src").alias("event"))
        hits = hits.join(applies, "event", "left_semi")
    return hits.select("document_id").distinct()


def event_type(question: Column) -> Column:
    """The first kind of event one of whose words the question holds."""
    low = F.lower(question)
    out = F.lit(None).cast("string")
    for kind, words in reversed(EVENT_WORDS.items()):
        out = F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), F.lit(kind)).otherwise(out)
    return out


def longest_name(questions: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """key and the longest of the names each question holds as whole words; ties by the lesser name.

    Names are found by their first word, the join is on equal strings; the rest
    of a name is then held against the words that follow, as many as the
    longest name has.
    """
    words = F.filter(F.split(F.col(text), r"[^\p{L}\p{N}_.']+"), lambda w: w != "")
    known = names.select(F.col("name")).where("name is not null").distinct().withColumn("_w", F.split("name", " ")).withColumn("_first", F.get("_w", F.lit(0))).where("_first != ''")
    most = known.agg(F.max(F.size("_w"))).first()[0] or 1  # a single number
    follow = F.transform("_q", lambda w, i: F.struct(w.alias("w"), F.slice("_q", i + 1, most).alias("run")))
    places = questions.select(key, words.alias("_q")).select(key, F.explode(follow).alias("_p")).select(key, F.col("_p.w").alias("_first"), F.col("_p.run").alias("_run"))
    firsts = known.select("_first").distinct()
    starts = places.join(firsts, "_first", "left_semi").select(key, "_first", F.array_join("_run", " ").alias("_rest"))
    fits = starts.join(known.select("_first", "name"), "_first").where(F.startswith(F.concat("_rest", F.lit(" ")), F.concat("name", F.lit(" "))))
    best = F.min_by("name", F.struct(-F.length("name"), F.col("name")))
    return fits.groupBy(key).agg(best.alias("name"))


def routes(questions: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """key, route, person and event_type of each question."""
    rows = questions.select(key, event_type(F.col(text)).alias("event_type")).join(longest_name(questions, names, key, text), key, "left")
    route = F.when(F.col("name").isNotNull() & F.col("event_type").isNotNull(), "PERSON_EVENT").when(F.col("name").isNotNull(), "PERSON_ONLY").when(F.col("event_type").isNotNull(), "EVENT_ONLY").otherwise("VECTOR_ONLY")
    return rows.select(key, route.alias("route"), F.col("name").alias("person"), "event_type")


def validated(rows: DataFrame, column: str) -> DataFrame:
    """Knowledge graphs as JSON text parsed to persons and events; one without persons or with an event that lacks a type raises."""
    kind = "struct<persons:array<struct<name:string>>,events:array<struct<type:string,description:string,applies_to:string>>>"
    kg = F.from_json(column, kind)
    bad = kg.isNull() | kg["persons"].isNull() | F.exists(F.coalesce(kg["events"], F.array().cast("array<struct<type:string,description:string,applies_to:string>>")), lambda e: e["type"].isNull())
    return rows.withColumn("kg", F.when(bad, F.raise_error(F.lit("not a knowledge graph of persons and events"))).otherwise(kg))
