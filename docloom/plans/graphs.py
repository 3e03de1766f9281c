"""Graph, layout and outline queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import graph as G
from docloom.operators import layout as L
from docloom.operators import outline as O
from docloom.operators import shred
from docloom.operators import structure as S
from docloom.plans import nested as N
from docloom.plans.structure import _ARTICLE, _TREE
from docloom.plans.universal import _CAND, _LEVEL, _key
from docloom.session import cut, table as t


def graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return G.archive_nodes(t(s, d, "doc_meta")).select("label", "id")


def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return G.archive_edges(t(s, d, "doc_meta"))


def _mentions(s: SparkSession, d: str) -> DataFrame:
    return G.mentions(t(s, d, "extract_entites"))


def semantic_nodes(s: SparkSession, d: str) -> DataFrame:
    return G.semantic_nodes(_mentions(s, d))


def semantic_edges(s: SparkSession, d: str) -> DataFrame:
    return G.semantic_edges(_mentions(s, d))


def graph_2hop(s: SparkSession, d: str) -> DataFrame:
    rows = _mentions(s, d)
    person = rows.where("event_type = 'REWARD'").agg(F.min("person").alias("p")).first()["p"]
    return G.documents_of(G.semantic_edges(rows), G.semantic_nodes(rows), person, "REWARD")


def graph_event(s: SparkSession, d: str) -> DataFrame:
    rows = _mentions(s, d)
    return G.documents_of(G.semantic_edges(rows), G.semantic_nodes(rows), None, "REWARD")


def single_links(s: SparkSession, d: str) -> DataFrame:
    return G.single_links(_mentions(s, d))


def name_collisions(s: SparkSession, d: str) -> DataFrame:
    return G.name_collisions(_mentions(s, d))


def event_types(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "embbeding", "name_key", "summary").distinct().select("name_key", G.event_type(F.col("summary")).alias("event_type"))


def longest_match(s: SparkSession, d: str) -> DataFrame:
    names = t(s, d, "extract_entites", "name").select(F.trim("name").alias("name"))
    questions = t(s, d, "ocr_block", "block_key", "content_raw").distinct().where("content_raw is not null")
    return G.longest_name(questions, names, "block_key", "content_raw")


def question_routes(s: SparkSession, d: str) -> DataFrame:
    names = t(s, d, "extract_entites", "name").select(F.trim("name").alias("name"))
    return G.routes(t(s, d, "ocr_block", "block_key", "content_raw").distinct().where("content_raw is not null"), names, "block_key", "content_raw").groupBy("route", "event_type").agg(F.count(F.lit(1)).alias("n"))


def _layout(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    shredded = cut(shred.shred(t(s, d, "layout_blocks_standard", "rec_id", "payload")))
    return shred.block_table(shredded), shred.page_table(shredded)


def layout_standard(s: SparkSession, d: str) -> DataFrame:
    blocks, pages = _layout(s, d)
    return L.standardise(blocks, pages).select("rec_id", "page_pos", "block_path", "id", "label", "ocr", F.array_join(F.transform("bbox", lambda x: x.cast("int").cast("string")), ",").alias("bbox"))


def iou_pairs(s: SparkSession, d: str) -> DataFrame:
    blocks, _ = _layout(s, d)
    return L.duplicate_pairs(blocks.where("bbox is not null"), ["rec_id", "page_pos"], "block_path", 0.3)


def text_boxes(s: SparkSession, d: str) -> DataFrame:
    return L.text_boxes(t(s, d, "page_vietocr_results").dropDuplicates(["line_key"]), least_score=0.7).select("line_key", F.array_join(F.transform("bbox", lambda x: x.cast("long").cast("string")), ",").alias("bbox"))


def reading_lines(s: SparkSession, d: str) -> DataFrame:
    rows = L.text_boxes(t(s, d, "page_vietocr_results").dropDuplicates(["line_key"])).withColumn("document_id", F.upper("document_id"))
    return L.reading_lines(rows, ["document_id", "page_number"], "line_key")


def _spans(s: SparkSession, d: str) -> DataFrame:
    rows = S.lines(S.indexable(S.blocks_of(t(s, d, "ocr_block")))).where("block_type <> 'table'")
    return cut(O.candidates(O.features(rows.select("document_id", F.col("seq").cast("long").alias("at"), "text", "block_type", "bbox", "page"))))


def boundary_candidates(s: SparkSession, d: str) -> DataFrame:
    return _spans(s, d).groupBy("kind", "accepted").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def outlines(s: SparkSession, d: str) -> DataFrame:
    return O.outline(_spans(s, d)).drop("path")


def zones(s: SparkSession, d: str) -> DataFrame:
    return O.zones(_spans(s, d)).groupBy("document_id", "zone").agg(F.count(F.lit(1)).alias("n"))


def document_types(s: SparkSession, d: str) -> DataFrame:
    return O.document_types(_spans(s, d))


def document_titles(s: SparkSession, d: str) -> DataFrame:
    about = t(s, d, "doc_meta", "id", "summary").groupBy(F.lower("id").alias("document_id")).agg(F.min("summary").alias("summary"))
    return O.titles(_spans(s, d), about)


def outline_audit(s: SparkSession, d: str) -> DataFrame:
    return O.audit(_spans(s, d))


def boundary_scores(s: SparkSession, d: str) -> DataFrame:
    """Articles of the outline held against those of the document tree."""
    from docloom.operators import evaluation as E

    gold = S.tree(S.indexable(S.blocks_of(t(s, d, "ocr_block")))).where("node_type = 'article'").select("document_id", F.col("seq").cast("long").alias("at"))
    return E.boundaries(gold, _spans(s, d).where("accepted and kind = 'article'"), ["document_id", "at"])


QUERIES = {
    "q_graph_nodes": graph_nodes, "q_graph_edges": graph_edges, "q_semantic_nodes": semantic_nodes, "q_semantic_edges": semantic_edges, "q_graph_2hop": graph_2hop, "q_graph_event": graph_event, "q_graph_single_link": single_links, "q_name_collisions": name_collisions, "q_event_types": event_types,
    "q_longest_match": longest_match, "q_question_routes": question_routes, "q_layout_standard": layout_standard, "q_iou_pairs": iou_pairs, "q_text_boxes": text_boxes, "q_reading_lines": reading_lines, "q_boundary_candidates": boundary_candidates, "q_outlines": outlines, "q_zones": zones,
    "q_document_types": document_types, "q_document_titles": document_titles, "q_outline_audit": outline_audit, "q_boundary_scores": boundary_scores,
}
_M = "(SELECT DISTINCT lower(document_id) document_id, trim(name) person, 'person_' || regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g') person_id, upper(event_type) event_type, nullif(trim(description), '') description, CASE WHEN event_type IS NOT NULL THEN 'event_' || regexp_replace(lower(trim(upper(event_type) || '_' || trim(name))), '[^a-z0-9]+', '_', 'g') END event_id FROM extract_entites WHERE document_id IS NOT NULL AND trim(coalesce(name, '')) <> '')"
_EVENT = " ".join("WHEN " + " OR ".join(f"contains(lower({{0}}), '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in G.EVENT_WORDS.items())
_LONGEST = r"""WITH q AS (SELECT DISTINCT block_key, content_raw FROM ocr_block WHERE content_raw IS NOT NULL), w AS (SELECT block_key, ' ' || array_to_string(regexp_extract_all(content_raw, '[\p{L}\p{N}_.'']+'), ' ') || ' ' AS words FROM q), n AS (SELECT DISTINCT trim(name) AS name FROM extract_entites WHERE name IS NOT NULL),
    best AS (SELECT block_key, name FROM (SELECT block_key, name, row_number() OVER (PARTITION BY block_key ORDER BY length(name) DESC, encode(name)) r FROM w JOIN n ON contains(words, ' ' || name || ' ')) WHERE r = 1) """
# DuckDB: the lines of the OCR blocks as spans, then the candidates of the universal outline
_OCR = _TREE[: _TREE.index("\ns1 AS")].rstrip(",").replace("bid, pos, unnest(segs) x", "bid, pos, bbox, unnest(segs) x") + f""", sp AS (SELECT d, seq ln, x, {_key('x')} k, len(regexp_extract_all(x, '\\p{{Lu}}')) / nullif(len(regexp_extract_all(x, '\\p{{L}}')), 0) up, len(regexp_split_to_array(x, '\\s+')) wc, k = 'title' ti, coalesce(abs((bbox[1] + bbox[3]) / 2 - 0.5) <= 0.05, false) ce, k bt, page FROM s0 WHERE k <> 'table')""" + _CAND
_TITLE = "^\\s*(?:quyet dinh|hop dong|to trinh|cong van|v/v)"
_TEXT_RULES = O._text_rules()
_RULE = {"articles": "articles >= 2", "legal": "legal >= 2", "parties": "parties >= 2"}
_TYPE_SCORES = ", ".join("[" + " + ".join(f"CASE WHEN {_RULE.get(what) or (f'regexp_matches(title, $${rule}$$)' if what == 'title' else f't{_TEXT_RULES.index(rule)}')} THEN {weight} ELSE 0 END" for weight, what, rule in rules) + "]" for rules in O.TYPE_RULES.values())
_TYPE_NAMES = ", ".join(f"'{k}'" for k in O.TYPE_RULES)
_CUM = "OVER (PARTITION BY d ORDER BY ln)"
_AREA = "greatest(0, {0}[3] - {0}[1]) * greatest(0, {0}[4] - {0}[2])"
_SHARED = "greatest(0, least({0}[3], {1}[3]) - greatest({0}[1], {1}[1])) * greatest(0, least({0}[4], {1}[4]) - greatest({0}[2], {1}[2]))"
_WHOLE = f"({_AREA.format('{0}')} + {_AREA.format('{1}')} - {_SHARED})"
_SIDE = lambda names: "list_filter([" + ", ".join(f"CASE WHEN {N._NUMBER.format(f'(page->{n!r})')} > 0 THEN {N._NUMBER.format(f'(page->{n!r})')} END" for n in names) + "], lambda v: v IS NOT NULL)[1]"
_EDGE = ", ".join(f"greatest(0, least({side}::BIGINT, round_even(box[{i}], 0)::BIGINT))::DOUBLE" for i, side in ((1, "trunc(w)"), (2, "trunc(h)"), (3, "trunc(w)"), (4, "trunc(h)")))
_PRIORITY = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.PRIORITY.items()) + " ELSE 99 END"
_BOXED = "SELECT DISTINCT ON (line_key) line_key, upper(document_id) d, page_number p, list_min(list_transform(poly, lambda p: p[1])) x1, list_min(list_transform(poly, lambda p: p[2])) y1, list_max(list_transform(poly, lambda p: p[1])) x2, list_max(list_transform(poly, lambda p: p[2])) y2 FROM page_vietocr_results WHERE poly IS NOT NULL"
SQL = {
    "q_iou_pairs": N.BLOCKS + f"SELECT x.rec_id, x.page_pos, x.path AS a, y.path AS b FROM k x JOIN k y ON x.rec_id IS NOT DISTINCT FROM y.rec_id AND x.page_pos = y.page_pos AND x.path < y.path WHERE {_WHOLE.format('x.box', 'y.box')} > 0 AND {_SHARED.format('x.box', 'y.box')} / {_WHOLE.format('x.box', 'y.box')} >= 0.3",
    "q_layout_standard": N.BLOCKS + f""", ps AS (SELECT rec_id, page_pos, {_SIDE(shred.WIDTH_NAMES)} w, {_SIDE(shred.HEIGHT_NAMES)} h FROM g), l0 AS (SELECT k.rec_id, k.page_pos, path, rank::INT rk, score, [{_EDGE}] box, regexp_replace(lower(coalesce(label, 'plain text')), '[ -]', '_', 'g') kind FROM k JOIN ps ON k.rec_id = ps.rec_id AND k.page_pos = ps.page_pos WHERE box IS NOT NULL AND w > 0 AND h > 0),
        l1 AS (SELECT *, row_number() OVER (PARTITION BY rec_id, page_pos ORDER BY path) AS n FROM l0 WHERE {_AREA.format('box')} >= 200 AND kind <> 'abandon'), e AS (SELECT x.rec_id, x.page_pos, x.n a, y.n b FROM l1 x JOIN l1 y ON x.rec_id = y.rec_id AND x.page_pos = y.page_pos AND x.n <> y.n WHERE {_WHOLE.format('x.box', 'y.box')} > 0 AND {_SHARED.format('x.box', 'y.box')} >= 0.9 * {_WHOLE.format('x.box', 'y.box')}),
        c AS (SELECT rec_id, page_pos, n a, n b FROM l1 UNION SELECT c.rec_id, c.page_pos, c.a, e.b FROM c JOIN e ON c.rec_id = e.rec_id AND c.page_pos = e.page_pos AND c.b = e.a), cl AS (SELECT rec_id, page_pos, a n, min(b) cluster FROM c GROUP BY 1, 2, 3),
        m AS (SELECT l1.*, cluster FROM l1 JOIN cl ON l1.rec_id = cl.rec_id AND l1.page_pos = cl.page_pos AND l1.n = cl.n QUALIFY row_number() OVER (PARTITION BY l1.rec_id, l1.page_pos, cluster ORDER BY {_PRIORITY}, coalesce(score, 1.0) DESC, l1.n) = 1),
        o AS (SELECT * FROM m WHERE NOT (kind IN ({", ".join(f"'{k}'" for k in L.INSIDE_TABLE)}) AND EXISTS (SELECT 1 FROM m t WHERE t.kind = 'table' AND t.rec_id = m.rec_id AND t.page_pos = m.page_pos AND {_AREA.format('m.box')} > 0 AND {_SHARED.format('t.box', 'm.box')} / ({_AREA.format('m.box')}) >= 0.9)))
        SELECT rec_id, page_pos, path AS block_path, row_number() OVER (PARTITION BY rec_id, page_pos ORDER BY coalesce(rk, 1000000000), box[2], box[1], n)::INT AS id, upper(kind) AS label, upper(kind) NOT IN ({", ".join(f"'{k}'" for k in L.NOT_READ)}) AS ocr, array_to_string(list_transform(box, lambda v: v::BIGINT::VARCHAR), ',') AS bbox FROM o""",
    "q_reading_lines": f"""WITH RECURSIVE b AS ({_BOXED}), f AS (SELECT *, row_number() OVER (PARTITION BY d, p ORDER BY y1, x1, line_key) AS n FROM b WHERE x2 - x1 >= 25 AND y2 - y1 BETWEEN 12 AND 260 AND (x2 - x1) * (y2 - y1) >= 300 AND NOT ((x1 < 8 OR y1 < 8 OR x2 > 2472 OR y2 > 3500) AND (x2 - x1 > 2108 OR y2 - y1 > 2981.8))),
        r AS (SELECT d, p, n, line_key, x1, y1 AS first, 0 AS line FROM f WHERE n = 1 UNION ALL SELECT f.d, f.p, f.n, f.line_key, f.x1, CASE WHEN abs(f.y1 - r.first) > 18 THEN f.y1 ELSE r.first END, CASE WHEN abs(f.y1 - r.first) > 18 THEN r.line + 1 ELSE r.line END FROM r JOIN f ON f.d IS NOT DISTINCT FROM r.d AND f.p IS NOT DISTINCT FROM r.p AND f.n = r.n + 1)
        SELECT d AS document_id, p AS page_number, line_key, line::INT AS line, (row_number() OVER (PARTITION BY d, p, line ORDER BY x1, n) - 1)::INT AS place FROM r""",
    "q_boundary_candidates": _OCR + " SELECT kind, ok AS accepted, count(*) AS n, round(avg(score), 4) AS mean_score FROM ca GROUP BY 1, 2",
    "q_outlines": _OCR + _LEVEL + ", pr AS (SELECT a.d, a.ln, max(b.ln) pa FROM l2 a LEFT JOIN l2 b ON a.d = b.d AND b.ln < a.ln AND b.level < a.level WHERE a.level IS NOT NULL GROUP BY 1, 2) SELECT l2.d AS document_id, l2.ln AS at, level, pa AS parent_at FROM l2 JOIN pr ON l2.d = pr.d AND l2.ln = pr.ln",
    "q_zones": _OCR + f""", z AS (SELECT *, CASE WHEN kind = 'annex' THEN 'ANNEX' WHEN regexp_matches(k, '^\\s*(?:noi nhan|hieu truong|giam doc|chu tich|kt\\.|tl\\.)') THEN 'CLOSING' WHEN kind IN ('article', 'chapter', 'part', 'section_word', 'primary_number', 'roman') THEN 'BODY' WHEN regexp_matches(k, '^\\s*can cu') THEN 'BODY' END sg FROM ca),
        y AS (SELECT d, CASE WHEN max((sg = 'ANNEX')::INT) {_CUM} = 1 THEN 'ANNEX' WHEN max((sg = 'CLOSING')::INT) {_CUM} = 1 THEN 'CLOSING' ELSE coalesce(last_value(sg IGNORE NULLS) {_CUM}, 'HEADER') END zone FROM z) SELECT d AS document_id, zone, count(*) AS n FROM y GROUP BY 1, 2""",
    "q_document_types": _OCR + f""", ft AS (SELECT d, coalesce(arg_min(CASE WHEN page = 1 AND regexp_matches(k, '{_TITLE}') THEN k END, CASE WHEN page = 1 AND regexp_matches(k, '{_TITLE}') THEN ln END), '') title, count(*) FILTER (kind = 'article' AND ok) articles, count(*) FILTER (regexp_matches(k, '^\\s*can cu')) legal, count(*) FILTER (regexp_matches(k, '^\\s*ben (?:[ab]|thu (?:nhat|hai))')) parties,
        {", ".join(f"bool_or(regexp_matches(k, '{r}')) t{i}" for i, r in enumerate(_TEXT_RULES))} FROM ca GROUP BY 1), gt AS (SELECT d, list_sort(list_zip(flatten([{_TYPE_SCORES}]), [{_TYPE_NAMES}]), 'DESC') o FROM ft)
        SELECT d AS document_id, CASE WHEN o[1][1] >= {O.MIN_SCORE} AND o[1][1] - o[2][1] >= {O.MIN_MARGIN} THEN o[1][2] ELSE 'UNKNOWN' END AS doc_type, o[1][1]::DOUBLE AS score FROM gt""",
    "q_document_titles": _OCR + """, gt AS (SELECT *, CASE WHEN bt = 'title' THEN 0.4 ELSE 0 END + CASE WHEN up >= 0.75 THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(k, '^\\s*(?:quyet dinh|to trinh|hop dong|cong van|thong bao|bien ban|ke hoach)') THEN 0.5 ELSE 0 END - CASE WHEN regexp_matches(k, 'cong hoa xa hoi|doc lap') THEN 1.0 ELSE 0 END sc2 FROM ca WHERE page = 1),
        h AS (SELECT d, x FROM gt WHERE round(sc2, 6) >= 0.5 QUALIFY row_number() OVER (PARTITION BY d ORDER BY round(sc2, 6) DESC, ln) = 1), m AS (SELECT lower(id) id, min(summary) summary FROM doc_meta GROUP BY 1) SELECT coalesce(m.id, h.d) AS document_id, coalesce(x, nullif(trim(summary), '')) AS title FROM m FULL JOIN h ON m.id = h.d""",
    "q_outline_audit": _OCR + _LEVEL + """, a AS (SELECT d, count(*) AS spans, count(*) FILTER (kind <> 'plain_paragraph' AND ok) AS accepted, count(*) FILTER (kind <> 'plain_paragraph' AND NOT ok) AS rejected, """ + ", ".join(f"count(*) FILTER (reason = '{r}') AS rejected_{r}" for r in ("inline_reference", "legal_reference", "sentence_continuation", "numeric_value", "page_number", "table", "low_score")) + ", " + ", ".join(f"count(*) FILTER (ok AND kind = '{k}') AS {k}s" for k in ("article", "clause_word", "point_word", "annex", "style_heading")) + """ FROM ca GROUP BY 1),
        lb AS (SELECT d, count(*) FILTER (level IS NULL) AS orphans, """ + ", ".join(f"count(*) FILTER (level = {i}) AS level_{i}" for i in range(6)) + " FROM l2 GROUP BY 1) SELECT a.d AS document_id, a.* EXCLUDE (d), coalesce(orphans, 0) AS orphans, " + ", ".join(f"coalesce(level_{i}, 0) AS level_{i}" for i in range(6)) + " FROM a LEFT JOIN lb ON a.d = lb.d",
    "q_boundary_scores": _OCR + f""", gold AS (SELECT DISTINCT d, seq ln FROM s0 WHERE regexp_matches(x, '{_ARTICLE}')), pred AS (SELECT DISTINCT d, ln FROM ca WHERE ok AND kind = 'article'), n AS (SELECT count(*) FILTER (g.d IS NOT NULL AND p.d IS NOT NULL) AS tp, count(*) FILTER (g.d IS NULL) AS fp, count(*) FILTER (p.d IS NULL) AS fn FROM gold g FULL JOIN pred p ON g.d = p.d AND g.ln = p.ln),
        r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END re FROM n) SELECT tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fp > 0 THEN fp / (tp + fp) ELSE 0 END, 6) AS false_split_rate FROM r""",
    "q_graph_nodes": " UNION ".join(f"SELECT '{label}' AS label, {key} AS id FROM doc_meta WHERE {key} IS NOT NULL" for label, (key, _) in G.LABELS.items()),
    "q_graph_edges": " UNION ".join(f"SELECT {G.LABELS[a][0]} AS src, '{r}' AS relation, {G.LABELS[b][0]} AS dst FROM doc_meta WHERE {G.LABELS[a][0]} IS NOT NULL AND {G.LABELS[b][0]} IS NOT NULL" for r, (a, b) in G.RELATIONS.items()),
    "q_semantic_nodes": f"SELECT 'Person' AS label, person_id AS id, max(person) AS name FROM {_M} GROUP BY 2 UNION ALL SELECT 'Event', event_id, max(event_type) FROM {_M} WHERE event_id IS NOT NULL GROUP BY 2",
    "q_semantic_edges": f"SELECT document_id AS src, 'MENTIONS' AS relation, person_id AS dst FROM {_M} UNION SELECT document_id, 'DESCRIBES', event_id FROM {_M} WHERE event_id IS NOT NULL UNION SELECT event_id, 'APPLIES_TO', person_id FROM {_M} WHERE event_id IS NOT NULL",
    "q_graph_2hop": f"WITH m AS {_M}, p AS (SELECT person_id FROM (SELECT person_id, max(person) n FROM m GROUP BY 1) WHERE n = (SELECT min(person) FROM m WHERE event_type = 'REWARD')), v AS (SELECT event_id FROM m GROUP BY 1 HAVING max(event_type) = 'REWARD') SELECT DISTINCT document_id FROM m WHERE event_id IN (SELECT event_id FROM v) AND event_id IN (SELECT event_id FROM m WHERE person_id IN (SELECT person_id FROM p))",
    "q_graph_event": f"WITH m AS {_M}, v AS (SELECT event_id FROM m GROUP BY 1 HAVING max(event_type) = 'REWARD') SELECT DISTINCT document_id FROM m WHERE event_id IN (SELECT event_id FROM v)",
    "q_graph_single_link": f"SELECT document_id, 'event_' || regexp_replace(lower(trim(min(description))), '[^a-z0-9]+', '_', 'g') AS event_id, min(person_id) AS person_id FROM {_M} GROUP BY 1 HAVING count(DISTINCT person_id) = 1 AND count(DISTINCT description) = 1",
    "q_name_collisions": f"SELECT person_id, count(DISTINCT person) AS names FROM {_M} GROUP BY 1 HAVING count(DISTINCT person) > 1",
    "q_event_types": "SELECT DISTINCT name_key, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(summary), '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in G.EVENT_WORDS.items()) + " END AS event_type FROM (SELECT DISTINCT name_key, summary FROM embbeding)",
    "q_longest_match": _LONGEST + "SELECT block_key, name FROM best",
    "q_question_routes": _LONGEST + f""", r AS (SELECT q.block_key, name, CASE {_EVENT.format("content_raw")} END AS e FROM q LEFT JOIN best USING (block_key))
        SELECT CASE WHEN name IS NOT NULL AND e IS NOT NULL THEN 'PERSON_EVENT' WHEN name IS NOT NULL THEN 'PERSON_ONLY' WHEN e IS NOT NULL THEN 'EVENT_ONLY' ELSE 'VECTOR_ONLY' END AS route, e AS event_type, count(*) AS n FROM r GROUP BY 1, 2""",
    "q_text_boxes": "WITH b AS (SELECT DISTINCT ON (line_key) line_key, score, list_min(list_transform(poly, lambda p: p[1])) x1, list_min(list_transform(poly, lambda p: p[2])) y1, list_max(list_transform(poly, lambda p: p[1])) x2, list_max(list_transform(poly, lambda p: p[2])) y2 FROM page_vietocr_results WHERE poly IS NOT NULL) SELECT line_key, concat_ws(',', trunc(x1)::BIGINT, trunc(y1)::BIGINT, trunc(x2)::BIGINT, trunc(y2)::BIGINT) AS bbox FROM b WHERE coalesce(score, 1) >= 0.7 AND x2 - x1 >= 25 AND y2 - y1 BETWEEN 12 AND 260 AND (x2 - x1) * (y2 - y1) >= 300 AND NOT ((x1 < 8 OR y1 < 8 OR x2 > 2472 OR y2 > 3500) AND (x2 - x1 > 2108 OR y2 - y1 > 2981.8))",
}
