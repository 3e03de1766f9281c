"""Problem 1: personal data in free text, found by a linear-chain CRF and replaced by typed placeholders.

Features are word shapes, word forms and a gazetteer of family names at each
token and its neighbours; the model is trained on the driver from the labelled
table of ``pii_table`` (its size is a parameter) and sent along. Tokens are cut
from the text as stored, so every position is one in the stored text; look-alike
letters, invisible characters and widths are undone for the features only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import crf, pii_table
from docloom.llm.lookalike import canonical

TYPES = ("name", "email", "phone", "idno", "address")
LABELS = ["O", *(f"{p}-{t}" for t in TYPES for p in "BI")]
_GLUE = "̀-ͯ\xad​-‏⁠-⁤﻿"
TOKEN = re.compile(rf"[^\W_](?:[^\W_]|[{_GLUE}])*|[^\s{_GLUE}]")
_FAMILY = {pii_table.unaccented(n).lower() for n in pii_table.FAMILY}
#: rows of the labelled table
TABLE_SIZE = 1600
TOKENS_AT_ONCE = 400_000


def features(token: str) -> list[str]:
    """What is known of a token by itself."""
    text = canonical(token)
    low = text.lower()
    if text.isdigit():
        return [f"d{min(len(text), 13)}", "digits", "zero" if text[0] == "0" else "nozero"] + ([f"w:{low}"] if len(text) < 3 else [])
    if any(c.isdigit() for c in text):
        shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", lambda m: f"9{min(len(m.group()), 8)}", low))
        return ["mixed", f"m:{shape}", f"lead:{low[0]}", f"ends:{'d' if text[-1].isdigit() else 'a'}"]
    if not text or not text[0].isalpha():
        return [f"p:{low}"]
    fold = pii_table.unaccented(low)
    case = "XX" if text.isupper() and len(text) > 1 else "X" if text.isupper() else "xx" if text.islower() else "Xx" if text[0].isupper() and text[1:].islower() else "mix"
    out = [f"s:{case}", f"w:{low}", f"f:{fold}", f"len{min(len(text), 9)}"]
    if fold in _FAMILY:
        out += ["family", f"family:{case}"]
    if text.isascii():
        out.append(f"ascii:{case}")
        if len(text) > 5:
            out.append(f"long:{case}")
    return out


def label_tokens(parts: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Tokens of a labelled sentence and their labels."""
    text = "".join(p for p, _ in parts)
    ends = np.cumsum([len(p) for p, _ in parts])
    tokens, labels, seen = [], [], -1
    for m in TOKEN.finditer(text):
        part = int(np.searchsorted(ends, m.start(), side="right"))
        kind = parts[part][1]
        tokens.append(m.group())
        labels.append("O" if not kind else f"{'I' if part == seen else 'B'}-{kind}")
        seen = part
    return tokens, labels


def _allowed(a: str, b: str) -> bool:
    return b[0] != "I" or a[1:] == b[1:]


@cache
def model(size: int = TABLE_SIZE, seed: int = 11) -> crf.Model:
    """The model trained on ``size`` labelled sentences; trained once in a process."""
    table = [label_tokens(p) for p in pii_table.sentences(size, seed)]
    return crf.train(table, features, LABELS, _allowed)


def model_of(labelled: DataFrame, size: int = TABLE_SIZE) -> crf.Model:
    """A model trained on one's own labelled table instead: text, and marks as array<struct<start int, end int, type string>>.

    At most ``size`` rows are taken, those of least hash, so the driver holds a
    bounded sample. A null text is left out, null marks mark nothing; marks
    that overlap an earlier one or are of no known type are left out.
    """
    rows = labelled.where("text is not null").select("text", "marks").orderBy(F.xxhash64("text"), "text").limit(size).collect()
    table = []
    for text, marks in rows:
        parts, at = [], 0
        for start, end, kind in sorted((m["start"], m["end"], m["type"]) for m in marks or () if m["type"] in TYPES):
            if at <= start < end <= len(text):
                parts += [(text[at:start], ""), (text[start:end], kind)]
                at = end
        table.append(label_tokens([x for x in [*parts, (text[at:], "")] if x[0]]))
    return crf.train([x for x in table if x[0]], features, LABELS, _allowed)


_DECODERS: dict[tuple, crf.Decoder] = {}


def _decoder(made: crf.Model) -> crf.Decoder:
    key = (len(made.vocabulary), float(made.weights.sum()), float(made.moves.max()))
    if key not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[key] = crf.Decoder(made, features)
    return _DECODERS[key]


_LOCAL_PART = re.compile(rf"[\w.+%{_GLUE}-]+\s*\Z")
_LOCAL = re.compile(rf"[\w.+%{_GLUE}-]")
_BEFORE = re.compile(
    r"(?:(?:(?:số nhà|số|so)\s+)?\d+[A-Za-z]?(?:/\d+[A-Za-z]?)*\s+(?:đường\s+)?|(?:(?:số nhà|số|so)\s+)?\d+[A-Za-z]?/"
    r"|(?:số nhà|số|so|ấp|thôn|xóm|bản|tổ|khóm|lô)\s+|(?:ấp|thôn|xóm|bản|tổ|khóm|khu phố|tổ dân phố|xã|phường)\s+\w[\w ]{0,18},\s*|xã\s+|phường\s+)\Z",
    re.IGNORECASE,
)
_PLACE = re.compile(r"(?:phường|xã|khu phố|ấp|thôn|đường|quận|thành phố|huyện|tỉnh|street|ward|city|road|district)\b|\b(?:P|Q|TP|H|F)\.", re.IGNORECASE)
_AT = re.compile(r"@|\(at\)|\[at\]|\(a\s*còng\)", re.IGNORECASE)


def _holds(kind: str, text: str, tokens: int) -> bool:
    """An exact check of what the model marked."""
    plain = canonical(text)
    digits = sum(c.isdigit() for c in plain)
    if kind == "email":
        return bool(_AT.search(plain)) and bool(re.search(r"\.\s*[A-Za-z]{2,}", plain))
    if kind == "phone":
        return 9 <= digits + (plain[:1] in "Oo" or plain[:2] in ("(O", "(o")) <= 12
    if kind == "idno":
        return digits in (9, 10, 12) or digits in (7, 8) and plain[:1].isalpha() and not plain[1:2].isalpha()
    if kind == "name":
        return tokens >= 2 and sum(c.isalpha() for c in plain) >= 4 and digits == 0 and "passport" not in plain.lower() and (plain[:1].isalpha() or plain[:1] in _STRAY)
    return tokens >= 3 and ";" not in plain and bool(_PLACE.search(plain))


_STRAY = "?|~^;'`"
_WORD_AFTER = re.compile(r"(\w+\.?)\s+")
_WORD_BEFORE = re.compile(r"([^\s<>;:,()/-]+)[^\S\n]+\Z")
# The last words of kinds of organisations, after which a name is the organisation's.
_OF_BODIES = frozenset(("cứu", "dục", "phần", "đẳng", "học", "tạo"))
_TITLES = {t.rstrip(".").lower().split(".")[-1] for t in pii_table.TITLES} | {"viên", "hộ", "doctor", "professor"}


def _in_title(text: str, start: int) -> bool:
    """Whether a capitalised word that is no title stands right before, on the same line: part of a longer proper name."""
    if start and (text[start - 1] in _STRAY and text[start] not in _STRAY or text[start - 1] in "/-_" and text[start - 2 : start - 1].strip()):
        return True
    word = _word_before(text, start)
    if word is None:
        return False
    before = canonical(word.group(1))
    if before.lower() in _OF_BODIES:
        return True
    return before[-1:].isalnum() and before[:1].isupper() and before.lower() not in _TITLES and len(before) > 1


def _before(text: str, start: int) -> re.Match | None:
    """What belongs to an address right before it. The stretch that is read grows until a find doesn't fill it."""
    size = 40
    while True:
        low = max(0, start - size)
        found = _BEFORE.search(unicodedata.normalize("NFC", text[low:start]))
        if found is None or found.start() > 1 or low == 0:
            return found if found and text[low:start].endswith(found.group()) else None
        size *= 2


def _word_before(text: str, start: int) -> re.Match | None:
    """The word before a place on the same line, whole however long."""
    size = 24
    while True:
        low = max(0, start - size)
        found = _WORD_BEFORE.search(text[low:start])
        if low == 0 or (found is None and not text[low:start].isspace()) or (found is not None and found.start() > 0):
            return found
        size *= 2


def _begin(kind: str, text: str, start: int) -> int:
    """The exact beginning: a mail address has its whole local part, a house number its own word for "number"."""
    if kind == "email":
        while start and _LOCAL.match(text[start - 1]):
            start -= 1
        return start
    if kind == "address":
        while found := _before(text, start):
            at = start - len(found.group())
            if at and text[at - 1].isalnum() or found.group().rstrip()[-1].isalpha() and found.group()[0] not in "0123456789xXpP" and not text[start].isdigit() and "," not in found.group():
                break
            start = at
    if kind == "name":
        if start and text[start - 1] in _STRAY and (start == 1 or text[start - 2].isspace() or text[start - 2] in ">(:;,"):
            start -= 1  # its first letter was misread
        lead = _WORD_AFTER.match(text, start)
        if lead and canonical(lead.group(1)).rstrip(".").lower() in _TITLES:
            return lead.end()
        word = _word_before(text, start)
        if word and pii_table.unaccented(canonical(word.group(1)).lower()) in _FAMILY and word.group(1)[0].isupper():
            return start - len(word.group())
    return start


def spans(texts: list[str], made: crf.Model) -> list[list[tuple[int, int, str]]]:
    """start, end and type of each piece of personal data in each text."""
    decoder = _decoder(made)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        lists, total, stop = [], 0, at
        while stop < len(texts) and (total < TOKENS_AT_ONCE or stop == at):
            lists.append(TOKEN.findall(texts[stop]))
            total += len(lists[-1])
            stop += 1
        labels, begins = decoder.decode(lists)
        marked = np.flatnonzero(labels)
        if len(marked):
            rows = np.searchsorted(begins, marked, side="right") - 1
            for row in np.unique(rows).tolist():
                mine = labels[begins[row] : begins[row + 1]]
                out[at + row] = _spans_of(texts[at + row], mine)
        at = stop
    return out


def _spans_of(text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
    places = [m.span() for m in TOKEN.finditer(text)]
    found, i, n = [], 0, len(labels)
    while i < n:
        if labels[i] == 0:
            i += 1
            continue
        kind = LABELS[labels[i]][2:]
        inside = LABELS.index(f"I-{kind}")
        j = i + 1
        while j < n and labels[j] == inside:
            j += 1
        start, end = places[i][0], places[j - 1][1]
        while start < end and text[start] in ";:,.-/ \n":
            start += 1
        if kind == "email" and (at := _AT.search(text, start, end)):
            local = _LOCAL_PART.search(text[start : at.start()])
            start += local.start() if local else 0
        start = max(_begin(kind, text, start), found[-1][1] if found else 0)
        if _holds(kind, text[start:end], j - i) and not (kind == "name" and _in_title(text, start)):
            found.append((start, end, kind))
        i = j
    return found


def find(df: DataFrame, key: str, text: str, size: int = TABLE_SIZE, made: crf.Model | None = None) -> DataFrame:
    """Every piece of personal data: key, pii_type, start_pos, end_pos (exclusive), in the text as stored.

    A null, empty or blank text holds nothing. A row that stands twice counts
    once. Other columns are dropped, whatever their names. Texts are taken
    whole, whatever their length, and each alone; only the result is shuffled.
    ``made`` is a model of one's own (``model_of``), else that of the made-up table.
    """
    made = made or model(size)
    kind = df.select(F.col(key)).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans(batch.column(1).to_pylist(), made)
            rows = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            flat = [s for f in found for s in f]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([k for _, _, k in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int32()), pa.array([e for _, e, _ in flat], pa.int32())],
                names=["key", "pii_type", "start_pos", "end_pos"],
            )

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).where("t is not null and length(t) > 0")
    return source.mapInArrow(run, f"key {kind}, pii_type string, start_pos int, end_pos int").distinct().withColumnRenamed("key", key)


def redact(df: DataFrame, key: str, text: str, size: int = TABLE_SIZE, made: crf.Model | None = None) -> DataFrame:
    """key, the text with ``[NAME]``, ``[EMAIL]``, ``[PHONE]``, ``[IDNO]``, ``[ADDRESS]`` in place of personal data, and n_replaced.

    A null text stays null, everything outside the replaced pieces is kept as
    it was. A row that stands twice (same key and text) comes once.
    """
    made = made or model(size)
    kind = df.select(F.col(key)).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = spans([t or "" for t in texts], made)
            clean: list[str | None] = []
            for whole, pieces in zip(texts, found):
                parts, at = [], 0
                for start, end, what in pieces:
                    parts += [whole[at:start], f"[{what.upper()}]"]
                    at = end
                clean.append(None if whole is None else "".join([*parts, whole[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array([len(f) for f in found], pa.int32())], names=["key", "clean", "n_replaced"])

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).dropDuplicates(["key", "t"])
    return source.mapInArrow(run, f"key {kind}, clean string, n_replaced int").withColumnsRenamed({"key": key, "clean": text})
