"""Queries of problem 2: nested layout records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import shred as S
from docloom.session import spread, table


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "layout_blocks_standard", "rec_id", "payload"), "rec_id", "payload")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = S.blocks_of(_payloads(spark, sf_dir))
    whole = F.col("label").isNotNull() & F.col("bbox").isNotNull() & (F.size("texts") > 0)
    return blocks.where(whole).select("rec_id", "page_pos", "block_path", "parent_path")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks_of(_payloads(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pages_of(_payloads(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.line_table(S.blocks_of(_payloads(spark, sf_dir)))


def unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unreadable(spread(table(spark, sf_dir, "layout_blocks_standard", "rec_id", "payload")))


QUERIES = {"p2_found": found, "p2_blocks": blocks, "p2_pages": pages, "p2_lines": lines, "p2_unreadable": unreadable}
_DISTINCT = "SELECT DISTINCT rec_id, payload FROM layout_blocks_standard"


def _children(of: str) -> str:
    """The block lists of a JSON node with their elements, in one list of structs."""
    return "flatten([" + ", ".join(f"CASE WHEN json_type({of}->'{n}') = 'ARRAY' THEN list_transform(json_extract({of}, '$.{n}[*]'), lambda e, i: {{'i': i - 1, 'e': e}}) ELSE [] END" for n in S.BLOCK_LISTS) + "])"


_LISTED = "list_filter([{}], lambda l: len(l) > 0)[1]"
_GOOD = "list_filter([{}], lambda v: v IS NOT NULL)[1]"
_NUMBER = "CASE WHEN json_type({0}) IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DECIMAL') THEN ({0})::DOUBLE WHEN json_type({0}) = 'VARCHAR' AND isfinite(try_cast(trim({0}->>'$') AS DOUBLE)) THEN try_cast(trim({0}->>'$') AS DOUBLE) END"
_ATOMS = "list_transform(CASE WHEN json_type({0}) = 'ARRAY' THEN json_extract({0}, '$[*]') ELSE [] END, lambda e: {1})"


def _box(name: str) -> list[str]:
    """The ways in which a field holds a box: text, four numbers, points, corners."""
    at = f"b->'{name}'"
    four = lambda xs: f"CASE WHEN len({xs}) = 4 AND len(list_filter({xs}, lambda v: v IS NULL)) = 0 THEN {xs} END"
    text = f"CASE WHEN json_type({at}) = 'VARCHAR' THEN list_transform(regexp_split_to_array(trim({at}->>'$', ' []()'), '[\\s,;]+'), lambda v: CASE WHEN isfinite(try_cast(v AS DOUBLE)) THEN try_cast(v AS DOUBLE) END) ELSE [] END"
    flat = _ATOMS.format(at, _NUMBER.format("e"))
    points = f"list_transform(CASE WHEN json_type({at}->0) = 'ARRAY' THEN json_extract({at}, '$[*][*]') ELSE [] END, lambda e: {_NUMBER.format('e')})"
    odd, pair = (f"list_filter({points}, lambda v, i: i % 2 = {k})" for k in (1, 0))
    even = f"CASE WHEN len({points}) >= 4 AND len({points}) % 2 = 0 AND len(list_filter({points}, lambda v: v IS NULL)) = 0 THEN [list_min({odd}), list_min({pair}), list_max({odd}), list_max({pair})] END"
    corners = "[" + ", ".join(_NUMBER.format(f"(b->'{name}'->'{c}')") for c in S.CORNERS) + "]"
    return [four(text), f"CASE WHEN coalesce(json_type({at}->0), '') <> 'ARRAY' THEN {four(flat)} END", even, f"CASE WHEN json_type({at}) = 'OBJECT' THEN {four(corners)} END"]


def _texts() -> list[str]:
    """The ways in which a block holds its recognised texts, in order of precedence."""
    said = lambda x: f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x}->>'$', '\\S') THEN {x}->>'$' END"
    some = lambda xs: f"list_filter({xs}, lambda v: v IS NOT NULL)"
    out = []
    for name in S.OCR_NAMES:
        at = f"(b->'{name}')"
        out += [some(f"[{said(at)}]"), some(_ATOMS.format(at, said("e")))]
        out += [some(f"[{said(f'({at}->{n!r})')}]") for n in S.TEXT_NAMES]
        out += [some(_ATOMS.format(at, said(f"(e->{n!r})"))) for n in S.TEXT_NAMES]
        lines = f"({at}->'lines')"
        out += [some(_ATOMS.format(lines, said("e"))), *(some(_ATOMS.format(lines, said(f"(e->{n!r})"))) for n in S.TEXT_NAMES)]
    return out


_LABEL = _GOOD.format(", ".join(f"CASE WHEN json_type(b->'{n}') = 'VARCHAR' AND regexp_matches(b->>'{n}', '\\S') THEN b->>'{n}' END" for n in S.LABEL_NAMES))
_RANK = _GOOD.format(", ".join(_NUMBER.format(f"(b->'{n}')") for n in S.INDEX_NAMES))
#: DuckDB: every block with its place, label, rank, box and texts
BLOCKS = f"""WITH RECURSIVE j AS (SELECT rec_id, payload::JSON p FROM ({_DISTINCT}) WHERE json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT'),
    g0 AS (SELECT rec_id, unnest(CASE WHEN json_type(p->'pages') = 'ARRAY' THEN list_transform(json_extract(p, '$.pages[*]'), lambda e, i: {{'i': i - 1, 'e': e}}) ELSE [] END) u FROM j), g AS (SELECT rec_id, u.i AS page_pos, u.e AS page FROM g0),
    r AS (SELECT rec_id, page_pos, u.i::VARCHAR AS path, '' AS parent, u.e AS b FROM (SELECT rec_id, page_pos, unnest({_children('page')}) u FROM g) UNION ALL SELECT rec_id, page_pos, path || '.' || u.i, path, u.e FROM (SELECT rec_id, page_pos, path, unnest({_children('b')}) u FROM r)),
    k AS (SELECT rec_id, page_pos::INT AS page_pos, path, parent, b, {_LABEL} AS label, {_RANK} AS rank, {_NUMBER.format("(b->'score')")} AS score, {_GOOD.format(", ".join(w for n in S.BOX_NAMES for w in _box(n)))} AS box, coalesce({_LISTED.format(", ".join(_texts()))}, []) AS texts FROM r WHERE json_type(b) <> 'NULL') """
SQL = {
    "p2_found": BLOCKS + "SELECT rec_id, page_pos, path AS block_path, parent AS parent_path FROM k WHERE label IS NOT NULL AND box IS NOT NULL AND len(texts) > 0",
    "p2_lines": BLOCKS + "SELECT rec_id, page_pos, path AS block_path, (generate_subscripts(texts, 1) - 1)::INT AS line_pos, unnest(texts) AS text FROM k",
    "p2_unreadable": f"SELECT rec_id, CASE WHEN payload IS NULL THEN 'null' WHEN trim(payload) = '' THEN 'blank' WHEN json_valid(payload) THEN 'not an object' ELSE 'malformed' END AS reason FROM ({_DISTINCT}) WHERE NOT coalesce(json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT', false)",
    "p2_pages": rf"""WITH g AS (SELECT rec_id, CASE WHEN json_valid(payload) THEN payload END p FROM ({_DISTINCT})), u AS (SELECT rec_id, unnest(json_extract(p, '$.pages[*]')) page, generate_subscripts(json_extract(p, '$.pages[*]'), 1) i FROM g WHERE p IS NOT NULL)
        SELECT rec_id, (i - 1)::INT AS page_pos, coalesce(nullif(regexp_extract(coalesce(json_extract_string(page, '$.page_number'), json_extract_string(page, '$.page_id'), ''), '\d+'), '')::BIGINT, i) AS page_number, coalesce(json_extract_string(page, '$.width'), json_extract_string(page, '$.page_width'))::DOUBLE AS width, coalesce(json_extract_string(page, '$.height'), json_extract_string(page, '$.page_height'))::DOUBLE AS height FROM u""",
}
