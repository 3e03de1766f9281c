"""Problem 9: sentence units of texts in many languages and scripts.

A pushdown automaton runs over the marks of a text only: terminators, quotation
marks, brackets, line ends that start a list item, blank lines and, in Thai,
blanks. Its stacks hold the open quotations and brackets and the open list
levels, its state the start of the unit and whether the last thing inside a
quotation was a terminator. An abbreviation trie, read backwards from a full
stop, tells stops that end nothing. A line that goes on with the next number,
letter or bullet of an open list level is an item, however the line before ends.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations after which a unit goes on, and such that may also end one.
NEVER = (
    "tp p q tr đh cđ th thcs thpt cty ts ths gs pgs bs ks cn ths.bs pgs.ts gs.ts gs.tskh đ/c tx kp tt vd stt nxb "
    "mr mrs ms dr prof st sr jr no nos vol art arts para paras sec fig ch pp p ed eds cf i.e e.g vs co jan feb mar apr jun jul aug sep sept oct nov dec "
    "mme mlle m mm cf art n° av bd janv févr juil sept "
    "د أ م ص ج डॉ श्री พ.ศ ค.ศ ม.ค น.ส ดร"
).split()
MAYBE = "v.v etc a.m p.m u.s u.k u.n ltd inc corp h vv ú ibid al".split()
QUOTES = {"“": "”", "«": "»", "「": "」", "『": "』", "‘": "’", "„": "“", "‹": "›", "《": "》", "〈": "〉"}
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "｛": "｝"}
_PAIRS = QUOTES | BRACKETS
_CLOSERS = "".join(dict.fromkeys(_PAIRS.values()))
_ENDERS = "!?…。！？।॥។៕؟۔｡"
_LIST = r"(?:\d{1,3}[.)]|[^\W\d_A-Z]\)|[A-Z]\)|[-–—•+*◦▪]|\(\w{1,3}\)|[IVXLC]{1,6}[.)])[^\S\n]"

_COMMON = (
    r"(?P<para>\n[^\S\n]*\n\s*)"
    rf"|(?P<item>\n[^\S\n]*(?={_LIST}))"
    rf"|(?P<end>(?:[{_ENDERS}]|[.．](?:(?![\w．])|(?<=[^\W\d_][^\W\d_][.．])(?=[^\W\d_])))+)"
    rf"|(?P<mark>[\"{re.escape(''.join(_PAIRS))}{re.escape(_CLOSERS)}])"
)
_MARKS = re.compile(_COMMON)
_THAI_MARKS = re.compile(_COMMON + r"|(?P<thai>(?<=[ก-๛])\s+(?=[ก-๛]))")
_THAI = re.compile(r"[ก-๛]")
_PARA = re.compile(r"\n[^\S\n]*\n")
_LABEL = re.compile(r"\s*(?:[^\s.,;:]{1,14}\s+)?(?:\d{1,4}(?:\.\d{1,3})*|[IVXLC]{1,6}|[^\W\d_])\s*")
_ZH_SAID = re.compile(r"[^，。！？“”\s]{1,10}?(?:说道|说|道|回答|表示|指出|强调|问道|写道)[。，]")
_NEXT = re.compile(r"\S")
_MARKER = re.compile(r"(?P<open>\(?)(?:(?P<number>\d{1,3})|(?P<letter>[^\W\d_](?=[.)]))|(?P<roman>[IVXLC]{2,6}))(?P<close>[.)])[^\S\n]|(?P<bullet>[-–—•+*◦▪])[^\S\n]")
_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
PARA, ITEM, END, MARK, THAI = 1, 2, 3, 4, 5


def _trie(words: list[str] | tuple[str, ...]) -> dict:
    """Of the words read backwards; the empty key marks a whole word."""
    top: dict = {}
    for word in words:
        node = top
        for char in reversed(word):
            node = node.setdefault(char, {})
        node[""] = True
    return top


_NEVER, _MAYBE = _trie(NEVER), _trie(MAYBE)


def _in_trie(top: dict, text: str, low: int, stop: int) -> bool:
    """Whether a word of the trie stands before ``stop``, not as the end of a longer word."""
    node, i = top, stop - 1
    while i >= low:
        node = node.get(text[i].lower())
        if node is None:
            return False
        if "" in node:
            before = text[i - 1] if i > low else " "
            if not (before.isalnum() and before < "⺀" or before == "." or unicodedata.combining(before)):
                return True
        i -= 1
    return False


def _ends_here(text: str, start: int, s: int, e: int) -> bool:
    """Whether the terminators in text[s:e], outside any pair, end the unit that began at ``start``."""
    marks, size = text[s:e], len(text)
    after = text[e] if e < size else "\n"
    if after in ",;:，、；：)]）】":
        return False
    found = _NEXT.search(text, e)
    if found is None:
        return True
    following = text[found.start()]
    only_dots = not marks.strip(".．")
    if only_dots and len(marks) == 1:
        before = text[s - 1] if s else ""
        joined = before.isalpha() and before.islower() and after.isupper()  # the blank between two sentences was left out
        if not joined and not after.isspace() and (after.isascii() or after.isalpha()) and after not in "\"'":
            return False
        if _THAI.match(before):
            return False
        if before.isalpha() and before.isupper() and (s < 2 or not text[s - 2].isalnum() and text[s - 2] != "."):
            return False
        if _in_trie(_NEVER, text, start, s):
            return False
        if _LABEL.fullmatch(text, start, s):
            return False
        if _in_trie(_MAYBE, text, start, s):
            return following.isupper() or following.isdigit() or following in _PAIRS or following == '"' or not (following.isalpha() and following.islower())
        return not (following.isalpha() and following.islower())
    if not marks.strip(".．…") and not after.isspace():
        # an ellipsis joined to what follows goes on, but where words aren't spaced
        return not (following.isascii() or following.isalpha() and (following.islower() or following.isupper()))
    return not (following.isalpha() and following.islower())


def _ends_after_quote(text: str, e: int) -> bool:
    """Whether a quotation that closes at ``e``, just after a terminator, ends the unit."""
    size = len(text)
    if e >= size:
        return True
    after = text[e]
    if after in ",;:.!?…，、；：。！？।॥។៕؟" or after in _CLOSERS:
        return False
    found = _NEXT.search(text, e)
    if found is None:
        return True
    following = text[found.start()]
    if following.isalpha() and following.islower():
        return False
    if not after.isspace():
        if "぀" <= after <= "ゟ" or "가" <= after <= "힣":
            return False  # a particle goes on
        if "一" <= after <= "鿿" and _ZH_SAID.match(text, e):
            return False
    return True


def _level(text: str, at: int) -> tuple[str, int] | None:
    """The list level whose mark stands at a place, and its count there; bullets all count 0."""
    m = _MARKER.match(text, at)
    if m is None:
        return None
    if m["bullet"]:
        return m["bullet"], 0
    if m["number"]:
        count, kind = int(m["number"]), "1"
    elif m["letter"] and m["letter"] != "I":
        count, kind = ord(m["letter"]), "a" if m["letter"].islower() else "A"
    else:
        digits = [_ROMAN[c] for c in m["roman"] or "I"]
        count, kind = sum(-a if a < b else a for a, b in zip(digits, [*digits[1:], 0])), "I"
    return m["open"] + kind + m["close"], count


def _goes_on(levels: list[tuple[str, int]], here: tuple[str, int] | None) -> bool:
    """Whether a mark is the next of an open level."""
    return here is not None and any(kind == here[0] and here[1] == count + (count > 0) for kind, count in levels)


def _enter(levels: list[tuple[str, int]], here: tuple[str, int] | None) -> None:
    """Puts a mark on the stack of levels; levels below its own are closed."""
    if here is not None:
        for i, (kind, _) in enumerate(levels):
            if kind == here[0]:
                del levels[i:]
                break
        levels.append(here)


def _closes(text: str, partner: str, at: int, ahead: dict[str, int]) -> bool:
    """Whether the closing mark comes before the next blank line. Each mark is looked for once, from left to right."""
    close = ahead.get(partner, 0)
    if close < at:
        found = text.find(partner, at)
        close = ahead[partner] = found if found >= 0 else len(text) + 1
    para = ahead.get("", 0)
    if para < at:
        m = _PARA.search(text, at)
        para = ahead[""] = m.start() if m else len(text)
    return close <= len(text) and close < para


def units(text: str) -> list[tuple[int, int]]:
    """start and end (exclusive) of each sentence unit, in code points."""
    out: list[tuple[int, int]] = []
    first = _NEXT.search(text)
    if first is None:
        return out
    start = first.start()
    stack: list[str] = []
    levels: list[tuple[str, int]] = []  # the open list levels with the count of their last item
    entered = -1  # the start of the unit whose mark was last put there
    last_end = -1  # end of the last terminator inside a pair
    ahead: dict[str, int] = {}  # where each closing mark and the next blank line were last seen
    rules = _THAI_MARKS if _THAI.search(text) else _MARKS

    def emit(stop: int) -> None:
        nonlocal start
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        if stop > start:
            out.append((start, stop))
            found = _NEXT.search(text, stop)
            start = found.start() if found else len(text)

    for m in rules.finditer(text):
        s, e, kind = m.start(), m.end(), m.lastindex
        if kind == PARA:
            emit(s)
            stack.clear()
        elif kind == ITEM:
            if stack:
                continue
            before = s - 1
            while before > start and text[before].isspace():
                before -= 1
            mark = text[before]
            here = _level(text, e)
            if not levels or start != entered:
                _enter(levels, _level(text, start))
                entered = start
            if before >= start and (_goes_on(levels, here) or mark in ".;:!?…”»\"」』。！？।॥។៕؟؛；：)" and not (mark == "." and _in_trie(_NEVER, text, start, before))):
                emit(s)
                _enter(levels, here)
                entered = start
        elif kind == END:
            if stack:
                last_end = e
            elif s >= start and _ends_here(text, start, s, e):
                emit(e)
        elif kind == MARK:
            char = text[s]
            if char == '"':
                closing = '"' in stack
            else:
                closing = char in _CLOSERS and char in stack
            if closing:
                while stack.pop() != char:
                    pass
                if not stack and char not in ")]}）］】〕｝":
                    inside = s
                    while inside > start and text[inside - 1].isspace():
                        inside -= 1
                    if last_end == inside and _ends_after_quote(text, e):
                        emit(e)
            else:
                partner = '"' if char == '"' else _PAIRS.get(char)
                if partner is None:
                    continue
                if _closes(text, partner, e, ahead):
                    stack.append(partner)
        elif not stack:
            emit(s)
    emit(len(text))
    return out


def split(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every sentence unit of every text: key, start_pos, end_pos (exclusive).

    A null, empty or blank text has no units. Equal texts under two keys give
    units under both; a row that stands twice gives its units twice (``distinct``
    keys are the caller's matter). Other columns are dropped. Texts are taken
    whole, and each is worked on alone, so nothing is shuffled.
    """
    kind = df.select(F.col(key)).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: list[tuple[int, int]] = []
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            for row, whole in enumerate(batch.column(1).to_pylist()):
                found = units(whole)
                counts[row] = len(found)
                spans += found
            rows = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            flat = np.array(spans, dtype=np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["key", "start_pos", "end_pos"])

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    return source.mapInArrow(run, f"key {kind}, start_pos int, end_pos int").withColumnRenamed("key", key)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The units with their place (unit_index) and their text, for readers of the corpus."""
    kind = df.select(F.col(key)).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, made = [], [], []
            for row, whole in enumerate(batch.column(1).to_pylist()):
                for i, (s, e) in enumerate(units(whole)):
                    rows.append(row)
                    index.append(i)
                    made.append(whole[s:e])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(index, pa.int32()), pa.array(made, pa.string())], names=["key", "unit_index", "unit"])

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    return source.mapInArrow(run, f"key {kind}, unit_index int, unit string").withColumnRenamed("key", key)
