"""Columnar shredding of nested records and its inverse.

``shred`` stripes every leaf of a JSON text into a column chunk of repetition
levels, definition levels and values. ``layout_tables`` rebuilds one flat table
per repeated ancestor (pages, blocks at any depth, text lines) from those level
sequences alone, with keys back to the parents. Blocks may hold further blocks
and one field may come as text, list or object, so the paths are found in each
record: a node of several kinds is striped once for each kind.

Conventions. A path such as ``pages[].blocks[].bbox[]`` has one repetition level
per ``[]``. The definition level counts the steps that are there: a key with a
value, a list element. A leaf that is absent still has an entry, at the level
reached, so the ordinals of all its repeated ancestors can be read from its
repetition levels. Values are JSON texts; a null value is a null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = pa.struct([("path", pa.string()), ("reps", pa.list_(pa.int32())), ("defs", pa.list_(pa.int32())), ("leaves", pa.list_(pa.string()))])
SHREDDED = "rec_id long, chunks array<struct<path: string, reps: array<int>, defs: array<int>, leaves: array<string>>>"

# The field names under which producers send the same thing, in order of precedence.
BLOCK_LISTS = ("blocks", "layout_blocks", "children")
BOX_NAMES = ("bbox", "bbox_xyxy", "box")
LABEL_NAMES = ("type", "category_name", "label")
OCR_NAMES = ("content_raw", "content", "text", "ocr")
TEXT_NAMES = ("text", "content", "rec_text")
INDEX_NAMES = ("block_index", "order", "reading_order", "id", "position")
WIDTH_NAMES = ("width", "page_width")
HEIGHT_NAMES = ("height", "page_height")
CORNERS = ("x1", "y1", "x2", "y2")
# Fixed value: bytes of payloads, or of their chunks, that a worker holds as Python objects at a time (they take about 30 times as much); a longer payload is held whole.
AT_A_TIME = 2 << 20


_quoted = json.encoder.encode_basestring


class _Kind:
    """What a node of a record can be: an atom, a list, an object; and the chunks of its own atoms and of all leaves from it down."""

    __slots__ = ("atom", "item", "keys", "chunk", "leaves")

    def __init__(self) -> None:
        self.atom, self.item, self.keys = False, None, {}
        self.chunk: tuple | None = None
        self.leaves: list[tuple] = []


def _kinds(value: object, kind: _Kind, skip: frozenset[str]) -> None:
    if isinstance(value, dict):
        for key, child in value.items():
            if key not in skip:
                below = kind.keys.get(key)
                if below is None:
                    below = kind.keys[key] = _Kind()
                _kinds(child, below, skip)
        kind.atom |= not value
    elif isinstance(value, list):
        kind.item = kind.item or _Kind()
        for child in value:
            _kinds(child, kind.item, skip)
    elif value is not None:
        kind.atom = True


def _step(key: str) -> str:
    return key.replace("~", "~0").replace(".", "~1").replace("[", "~2")


def _lay(kind: _Kind, path: str, out: dict[str, tuple[list[int], list[int], list[str | None]]]) -> list[tuple]:
    if kind.atom or not (kind.item or kind.keys):
        kind.chunk = out[path] = ([], [], [])
        kind.leaves.append(kind.chunk)
    if kind.item is not None:
        kind.leaves += _lay(kind.item, path + "[]", out)
    for key, child in kind.keys.items():
        kind.leaves += _lay(child, f"{path}.{_step(key)}" if path else _step(key), out)
    return kind.leaves


def _nothing(kind: _Kind, rep: int, level: int) -> None:
    for reps, defs, leaves in kind.leaves:
        reps.append(rep)
        defs.append(level)
        leaves.append(None)


def _walk(node: object, kind: _Kind, rep: int, level: int, depth: int) -> None:
    if node is None:
        _nothing(kind, rep, level)
        return
    if kind.chunk is not None:
        reps, defs, leaves = kind.chunk
        reps.append(rep)
        defs.append(level)
        leaves.append(None if isinstance(node, (dict, list)) else _quoted(node) if isinstance(node, str) else json.dumps(node))
    if kind.item is not None:
        if isinstance(node, list) and node:
            _walk(node[0], kind.item, rep, level + 1, depth + 1)
            for child in node[1:]:
                _walk(child, kind.item, depth + 1, level + 1, depth + 1)
        else:
            _nothing(kind.item, rep, level)
    if kind.keys:
        get = node.get if isinstance(node, dict) else {}.get
        for key, child in kind.keys.items():
            got = get(key)
            if got is None:
                _nothing(child, rep, level)
            else:
                _walk(got, child, rep, level + 1, depth)


def stripe(value: object, skip: frozenset[str] = frozenset()) -> dict[str, tuple[list[int], list[int], list[str | None]]]:
    """The column chunks of one parsed record, in the order of its fields; those of fields to ``skip`` aren't made.

    No function in here refers to itself: such a cycle would keep the chunks until Python happens to collect its garbage.
    """
    top = _Kind()
    _kinds(value, top, skip)
    out: dict[str, tuple[list[int], list[int], list[str | None]]] = {}
    _lay(top, "", out)
    _walk(value, top, 0, 0, 0)
    return out


def unstripe(chunks: dict[str, tuple[list[int], list[int], list[str | None]]]) -> dict[str, list[tuple[tuple[int, ...], object]]]:
    """The values that are there, by path, with the ordinals of their repeated ancestors: what a record holds, flat."""
    out = {}
    for path, (reps, _, leaves) in chunks.items():
        at = positions(np.asarray(reps, dtype=np.int64), path.count("[]"))
        out[path] = [(tuple(at[i].tolist()), json.loads(leaf)) for i, leaf in enumerate(leaves) if leaf is not None]
    return out


def positions(reps: np.ndarray, depth: int) -> np.ndarray:
    """Ordinals of each entry at repetition levels 1..depth, from the repetition levels alone.

    Level k counts up where rep == k and starts again at 0 where rep < k.
    """
    out = np.zeros((len(reps), depth), dtype=np.int64)
    if len(reps):
        where = np.arange(len(reps))
        for k in range(1, depth + 1):
            steps = np.cumsum(reps == k)
            starts = np.maximum.accumulate(np.where(reps < k, where, 0))
            out[:, k - 1] = steps - steps[starts]
    return out


def _no_constant(name: str) -> float:
    raise ValueError(name)


def _parse(text: str | None) -> tuple[bool, object]:
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False, None


def _parts(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, a part of those that begin within the same ``AT_A_TIME`` bytes: every row is in one, none is cut."""
    begins = (np.cumsum(sizes, dtype=np.int64) - sizes) // AT_A_TIME
    cuts = [0, *(np.flatnonzero(np.diff(begins)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[int | None, str | None]]]:
    """rec_id and payload of the rows of a table, a part at a time."""
    for batch in batches:
        for part in _parts(batch, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()):
            yield zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _striped(batches: Iterator[pa.RecordBatch], skip: frozenset[str] = frozenset()) -> Iterator[tuple[list[int | None], list[dict[str, tuple[list[int], list[int], list[str | None]]]]]]:
    """rec_id and column chunks of the payloads that can be shredded, a part at a time."""
    for rows in _texts(batches):
        recs, made = [], []
        for rec, text in rows:
            good, value = _parse(text)
            if good and isinstance(value, dict):
                recs.append(rec)
                made.append(stripe(value, skip))
        yield recs, made


def _source(df: DataFrame, key: str, payload: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("rec_id"), F.col(payload).cast("string").alias("payload"))
    return rows.dropDuplicates(["rec_id", "payload"])


def _columns(made: list[dict[str, tuple[list[int], list[int], list[str | None]]]]) -> pa.ListArray:
    """The chunks of several records as one Arrow array."""
    held = [c for record in made for c in record.values()]
    flat = lambda i: chain.from_iterable(c[i] for c in held)
    ends = pa.array(np.concatenate([[0], np.cumsum([len(c[0]) for c in held])]).astype(np.int32))
    numbers = lambda i: pa.array(np.fromiter(flat(i), dtype=np.int32))
    parts = [pa.ListArray.from_arrays(ends, x) for x in (numbers(0), numbers(1), pa.array(list(flat(2)), pa.string()))]
    chunks = pa.StructArray.from_arrays([pa.array([p for record in made for p in record], pa.string()), *parts], fields=list(CHUNK))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(record) for record in made])]).astype(np.int32)), chunks)


def shred(df: DataFrame, key: str = "rec_id", payload: str = "payload", skip: tuple[str, ...] = ()) -> DataFrame:
    """One row per valid payload: rec_id and its column chunks, without those of the fields named in ``skip``.

    A payload that is null, blank, not JSON or not an object gives no row here
    but one in ``unreadable``. A payload sent again (same key, same text) counts
    once. A null key is kept. Other columns of ``df`` are dropped, whatever
    their names. An empty table gives an empty one. Long payloads are taken whole.
    """

    pruned = frozenset(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for recs, made in _striped(batches, pruned):
            yield pa.RecordBatch.from_arrays([pa.array(recs, pa.int64()), _columns(made)], names=["rec_id", "chunks"])

    return _source(df, key, payload).mapInArrow(run, SHREDDED)


def unreadable(df: DataFrame, key: str = "rec_id", payload: str = "payload") -> DataFrame:
    """rec_id and reason (``null``, ``blank``, ``malformed``, ``not an object``) of each payload that can't be shredded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _texts(batches):
            recs, reasons = [], []
            for rec, text in rows:
                good, value = _parse(text)
                if not (good and isinstance(value, dict)):
                    recs.append(rec)
                    reasons.append("null" if text is None else "blank" if not text.strip() else "not an object" if good else "malformed")
            yield pa.RecordBatch.from_arrays([pa.array(recs, pa.int64()), pa.array(reasons, pa.string())], names=["rec_id", "reason"])

    return _source(df, key, payload).mapInArrow(run, "rec_id long, reason string")


class _Column:
    """The chunks of one path of all records of a batch; what is asked for is taken out of Arrow then, not before."""

    __slots__ = ("depth", "recs", "reps", "defs", "leaves", "_at")

    def __init__(self, depth: int, recs: np.ndarray, reps: np.ndarray, defs: np.ndarray, leaves: pa.Array):
        self.depth, self.recs, self.reps, self.defs, self.leaves = depth, recs, reps, defs, leaves
        self._at: np.ndarray | None = None

    @property
    def at(self) -> np.ndarray:
        """The record and the ordinals of all entries. A record begins at repetition level 0, so its levels start anew."""
        if self._at is None:
            self._at = np.column_stack([self.recs, positions(self.reps, self.depth)])
        return self._at

    def entries(self, depth: int, level: int | None) -> Iterator[tuple[tuple[int, ...], str | None]]:
        """Record and ancestors at ``depth`` and leaf of the entries with a value, or of all that reach a definition level."""
        leaves = self.leaves
        if level is None:
            if leaves.null_count == len(leaves):
                return iter(())
            taken = np.flatnonzero(leaves.is_valid().to_numpy(zero_copy_only=False)) if leaves.null_count else np.arange(len(leaves))
        else:
            taken = np.flatnonzero(self.defs >= level)
        if not len(taken):
            return iter(())
        return zip(map(tuple, self.at[taken, : depth + 1].tolist()), leaves.take(pa.array(taken)).to_pylist())


class Chunks:
    """The column chunks of the records of a batch, read by record and ancestor: the record is the first ordinal of each key."""

    def __init__(self, columns: dict[str, _Column]):
        self.columns = columns

    @classmethod
    def of_batch(cls, records: pa.ListArray) -> Chunks:
        """The chunks of all records of a batch, those of one path laid behind each other in the order of the records."""
        held = records.flatten()
        paths = held.field("path").dictionary_encode()
        codes = paths.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        owner = np.repeat(np.arange(len(records)), pc.fill_null(pc.list_value_length(records), 0).to_numpy())[order]
        reps, defs, leaves = held.field("reps"), held.field("defs"), held.field("leaves")
        begin = reps.offsets.to_numpy().astype(np.int64)
        begin = begin - begin[0]
        sizes = np.diff(begin)[order]
        ends = np.cumsum(sizes)
        taken = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[:-1][order] - (ends - sizes), sizes)
        recs, reps, defs, leaves = np.repeat(owner, sizes), reps.flatten().to_numpy()[taken], defs.flatten().to_numpy()[taken], leaves.flatten().take(pa.array(taken))
        names, cuts = paths.dictionary.to_pylist(), np.searchsorted(codes[order], np.arange(len(paths.dictionary) + 1))
        bounds = np.concatenate([[0], ends])[cuts].tolist()
        return cls({path: _Column(path.count("[]"), recs[a:b], reps[a:b], defs[a:b], leaves.slice(a, b - a)) for path, a, b in zip(names, bounds, bounds[1:])})

    @classmethod
    def of_records(cls, made: list[dict[str, tuple[list[int], list[int], list[str | None]]]]) -> Chunks:
        """The chunks of records striped a moment ago, laid out as by ``of_batch``."""
        laid: dict[str, tuple[list[int], list[int], list[int], list[str | None]]] = {}
        for rec, record in enumerate(made):
            for path, (reps, defs, leaves) in record.items():
                held = laid.get(path)
                if held is None:
                    held = laid[path] = ([], [], [], [])
                held[0].extend([rec] * len(reps))
                held[1].extend(reps)
                held[2].extend(defs)
                held[3].extend(leaves)
        numbers = lambda values: np.fromiter(values, dtype=np.int64, count=len(values))
        return cls({path: _Column(path.count("[]"), numbers(recs), numbers(reps), numbers(defs), pa.array(leaves, pa.string())) for path, (recs, reps, defs, leaves) in laid.items()})

    def lists(self, pattern: str) -> list[str]:
        """The list paths (ending in ``[]``) that match, shallow ones first."""
        rule, found = re.compile(pattern), {}
        for path in self.columns:
            end = path.find("[]")
            while end >= 0:
                end += 2
                head = path[:end]
                if head not in found:
                    found[head] = rule.fullmatch(head) is not None
                end = path.find("[]", end)
        found = {p: None for p, fits in found.items() if fits}
        return sorted(found, key=lambda p: (p.count("[]"), p))

    def elements(self, path: str) -> list[tuple[int, ...]]:
        """Records and ordinals of the elements of a list path that are there; any column below it tells those of its records."""
        depth, level = path.count("[]"), _level(path)
        seen = np.zeros(1 + max((int(c.recs[-1]) for c in self.columns.values() if len(c.recs)), default=0), dtype=bool)
        out: list[tuple[int, ...]] = []
        for name, column in self.columns.items():
            if name == path or name.startswith((path + ".", path + "[")):
                new = ~seen[column.recs]
                if new.any():
                    out += dict.fromkeys(map(tuple, column.at[new & (column.defs >= level), : depth + 1].tolist()))
                    seen[column.recs] = True
        return out

    def values(self, path: str, depth: int, nulls: bool = False) -> dict[tuple[int, ...], list]:
        """Values of a leaf path, those of one ancestor at ``depth`` together; with ``nulls`` list elements that are null are None."""
        out: dict[tuple[int, ...], list] = {}
        column = self.columns.get(path)
        if column is not None:
            for key, leaf in column.entries(depth, _level(path) if nulls else None):
                found = None if leaf is None else leaf[1:-1] if leaf[0] == '"' and "\\" not in leaf else int(leaf) if leaf.isdigit() else json.loads(leaf)
                held = out.get(key)
                if held is None:
                    out[key] = [found]
                else:
                    held.append(found)
        return out

    def first(self, path: str, names: tuple[str, ...], depth: int, good: Callable[[object], bool]) -> dict[tuple[int, ...], object]:
        """By ancestor, the first of several fields that has a value of the wanted kind."""
        out: dict[tuple[int, ...], object] = {}
        for name in names:
            for key, found in self.values(f"{path}.{name}", depth).items():
                if key not in out and good(found[0]):
                    out[key] = found[0]
        return out


def _level(path: str) -> int:
    """The definition level of a path's values: its steps."""
    return path.count("[]") + len(re.findall(r"[^.\[\]]+", path))


def _number(value: object) -> float | None:
    if value is None or isinstance(value, (bool, dict, list)):
        return None
    try:
        number = float(value)
    except ValueError:
        return None
    return number if np.isfinite(number) else None


def _box(values: list) -> list[float] | None:
    numbers = [_number(v) for v in values]
    return None if len(numbers) != 4 or None in numbers else numbers


def boxes(chunks: Chunks, path: str, depth: int) -> dict[tuple[int, ...], list[float]]:
    """x1, y1, x2, y2 of each element that has all of them, from a text, a list, points or an object."""
    out: dict[tuple[int, ...], list[float]] = {}
    for name in BOX_NAMES:
        base = f"{path}.{name}"
        for key, (text, *_) in chunks.values(base, depth).items():
            if isinstance(text, str) and key not in out and (box := _box(re.split(r"[\s,;]+", text.strip(" []()")))):
                out[key] = box
        for key, flat in chunks.values(base + "[]", depth, nulls=True).items():
            if key not in out and (box := _box(flat)):
                out[key] = box
        for key, flat in chunks.values(base + "[][]", depth, nulls=True).items():
            numbers = [_number(v) for v in flat]
            if key not in out and len(numbers) >= 4 and len(numbers) % 2 == 0 and None not in numbers:
                xs, ys = numbers[0::2], numbers[1::2]
                out[key] = [min(xs), min(ys), max(xs), max(ys)]
        corners = [chunks.values(f"{base}.{c}", depth) for c in CORNERS]
        for key in corners[0]:
            if key not in out and (box := _box([c.get(key, [None])[0] for c in corners])):
                out[key] = box
    return out


def lines(chunks: Chunks, path: str, depth: int) -> dict[tuple[int, ...], list[str]]:
    """The recognised texts of each element: its own or those of its lines, blank ones left out."""
    out: dict[tuple[int, ...], list[str]] = {}
    ends = ["", "[]", *(f".{n}" for n in TEXT_NAMES), *(f"[].{n}" for n in TEXT_NAMES), ".lines[]", *(f".lines[].{n}" for n in TEXT_NAMES)]
    for name in OCR_NAMES:
        for end in ends:
            for key, found in chunks.values(f"{path}.{name}{end}", depth).items():
                texts = [t for t in found if isinstance(t, str) and t.strip()]
                if texts and key not in out:
                    out[key] = texts
    return out


def _blocks(chunks: Chunks) -> Iterator[tuple]:
    names = "|".join(BLOCK_LISTS)
    for path in chunks.lists(rf"pages\[\](?:\.(?:{names})\[\])+"):
        depth = path.count("[]")
        label = chunks.first(path, LABEL_NAMES, depth, lambda v: isinstance(v, str) and bool(v.strip()))
        index = chunks.first(path, INDEX_NAMES, depth, lambda v: _number(v) is not None)
        score = chunks.first(path, ("score",), depth, lambda v: _number(v) is not None)
        box, text = boxes(chunks, path, depth), lines(chunks, path, depth)
        for at in chunks.elements(path):
            where = [str(i) for i in at[2:]]
            rank = _number(index.get(at))
            yield (at[0], at[1], ".".join(where), ".".join(where[:-1]), label.get(at), None if rank is None else int(rank), _number(score.get(at)), box.get(at), text.get(at, []))


def _pages(chunks: Chunks) -> Iterator[tuple]:
    width = chunks.first("pages[]", WIDTH_NAMES, 1, lambda v: (_number(v) or 0) > 0)
    height = chunks.first("pages[]", HEIGHT_NAMES, 1, lambda v: (_number(v) or 0) > 0)
    number = chunks.first("pages[]", ("page_number", "page_id"), 1, lambda v: v is not None and bool(re.search(r"\d", str(v))))
    for at in chunks.elements("pages[]"):
        digits = re.search(r"\d+", str(number[at])) if at in number else None
        yield (at[0], at[1], int(digits.group()) if digits else at[1] + 1, _number(width.get(at)), _number(height.get(at)))


def _batch(recs: list, chunks: Chunks, rows: Callable[[Chunks], Iterator[tuple]], schema: pa.Schema) -> pa.RecordBatch:
    out = [(recs[row[0]], *row[1:]) for row in rows(chunks)]
    columns = list(zip(*out)) if out else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)


def _at_once(df: DataFrame, key: str, payload: str, rows: Callable[[Chunks], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """``_assemble`` of ``shred`` in one stage, where the chunks themselves aren't wanted: they stay in the worker that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for recs, made in _striped(batches):
            yield _batch(recs, Chunks.of_records(made), rows, schema)

    return _source(df, key, payload).mapInArrow(run, ddl)


def _held(records: pa.ListArray) -> np.ndarray:
    """About the bytes of the column chunks of each record of a batch: 16 for an entry."""
    bounds = records.offsets.to_numpy().astype(np.int64)
    entries = records.flatten().field("reps").offsets.to_numpy().astype(np.int64)
    return 16 * np.diff(entries[bounds - bounds[0]])


def _assemble(shredded: DataFrame, rows: Callable[[Chunks], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, _held(batch.column(1))):
                yield _batch(part.column(0).to_pylist(), Chunks.of_batch(part.column(1)), rows, schema)

    return shredded.select("rec_id", "chunks").mapInArrow(run, ddl)


_BLOCK_ROWS = pa.schema([("rec_id", pa.int64()), ("page_pos", pa.int32()), ("block_path", pa.string()), ("parent_path", pa.string()), ("label", pa.string()), ("block_index", pa.int32()), ("score", pa.float64()), ("bbox", pa.list_(pa.float64())), ("texts", pa.list_(pa.string()))])
_BLOCK_DDL = "rec_id long, page_pos int, block_path string, parent_path string, label string, block_index int, score double, bbox array<double>, texts array<string>"
_PAGE_ROWS = pa.schema([("rec_id", pa.int64()), ("page_pos", pa.int32()), ("page_number", pa.int64()), ("width", pa.float64()), ("height", pa.float64())])
_PAGE_DDL = "rec_id long, page_pos int, page_number long, width double, height double"


def block_table(shredded: DataFrame) -> DataFrame:
    """Each block at any depth: rec_id, page_pos, block_path, parent_path, label, block_index, score, bbox, texts.

    (rec_id, page_pos, parent_path) names the enclosing block, ``''`` the page
    itself. label and bbox are null where they're missing or incomplete, texts
    is empty where nothing was recognised.
    """
    return _assemble(shredded, _blocks, _BLOCK_ROWS, _BLOCK_DDL)


def blocks_of(df: DataFrame, key: str = "rec_id", payload: str = "payload") -> DataFrame:
    """``block_table`` of the payloads of a table; what ``shred`` says of odd payloads holds here."""
    return _at_once(df, key, payload, _blocks, _BLOCK_ROWS, _BLOCK_DDL)


def page_table(shredded: DataFrame) -> DataFrame:
    """Each page: rec_id, page_pos, page_number (its place if it names none), width, height."""
    return _assemble(shredded, _pages, _PAGE_ROWS, _PAGE_DDL)


def pages_of(df: DataFrame, key: str = "rec_id", payload: str = "payload") -> DataFrame:
    """``page_table`` of the payloads of a table."""
    return _at_once(df, key, payload, _pages, _PAGE_ROWS, _PAGE_DDL)


def line_table(blocks: DataFrame) -> DataFrame:
    """Each recognised text line of a block table, with the key of its block."""
    return blocks.select("rec_id", "page_pos", "block_path", F.posexplode("texts").alias("line_pos", "text"))
