"""Problem 6: cutting texts that are too long at natural boundaries.

A dynamic programme over the gaps between tokens picks the cuts: it minimises
the penalties of the cuts (none at a blank line, most inside a word) plus the
imbalance of the pieces, subject to the limit and the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]")


@dataclass(frozen=True)
class Limits:
    """Tokens in a piece at most, of these ``extra`` that every piece is charged with; tokens repeated; penalties of the cuts."""

    most: int = 256
    overlap: int = 20
    extra: int = 2
    paragraph: float = 0.0
    line: float = 1.0
    sentence: float = 1.5
    clause: float = 6.0
    blank: float = 12.0
    inside: float = 60.0
    each: float = 8.0
    imbalance: float = 10.0

    def __post_init__(self) -> None:
        if self.overlap < 0 or self.most - self.extra <= self.overlap:
            raise ValueError("a piece has to hold more than the overlap")


def _penalties(text: str, starts: np.ndarray, ends: np.ndarray, at: Limits) -> np.ndarray:
    """Of a cut after each token."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    breaks = np.concatenate([[0], np.cumsum(codes == 10)])
    lines = breaks[starts[1:]] - breaks[ends[:-1]]
    last = codes[ends[:-1] - 1]
    among = lambda marks: np.isin(last, [ord(c) for c in marks])
    out = np.full(len(starts), at.blank)
    inner = np.select(
        [starts[1:] == ends[:-1], lines > 1, (lines == 1) & among(".!?…;:。"), lines == 1, among(".!?…。！？।៕។"), among(",;:)]”»")],
        [at.inside, at.paragraph, at.line, at.clause, at.sentence, at.clause], at.blank,
    )
    out[:-1] = inner
    out[-1] = 0
    return out


#: cells of the tables of one run of the programme
CELLS = 4_000_000


def cuts(text: str, at: Limits = Limits()) -> list[tuple[int, int, int]]:
    """start, end and token count (with the extra ones) of each piece of a text; a text within the limit is one piece."""
    return cuts_of([text], at)[0]


def cuts_of(texts: list[str], at: Limits = Limits()) -> list[list[tuple[int, int, int]]]:
    """``cuts`` of several texts; the long ones go through the programme side by side, token by token."""
    out: list[list[tuple[int, int, int]]] = []
    long: list[tuple[int, np.ndarray]] = []
    for row, text in enumerate(texts):
        n = len(TOKEN.findall(text))
        out.append([(0, len(text), n + at.extra)])
        if n + at.extra > at.most:
            long.append((row, np.array([m.span() for m in TOKEN.finditer(text)], dtype=np.int64)))
    long.sort(key=lambda x: -len(x[1]))
    low = 0
    while low < len(long):
        high = low + max(1, CELLS // len(long[low][1]))
        for (row, spans), ends in zip(long[low:high], _programme([(texts[r], spans) for r, spans in long[low:high]], at)):
            pieces, previous = [], 0
            for end in ends:
                begin = max(0, previous - at.overlap) if previous else 0
                pieces.append((int(spans[begin, 0]), int(spans[end - 1, 1]), end - begin + at.extra))
                previous = end
            out[row] = pieces
        low = high
    return out


def _programme(texts: list[tuple[str, np.ndarray]], at: Limits) -> list[list[int]]:
    """The token counts at which each text is cut best, its own last; texts with more tokens come first."""
    sizes = np.array([len(spans) for _, spans in texts])
    room = at.most - at.extra
    step = room - at.overlap
    count = 1 + -(-(sizes - room) // step)
    fair = np.maximum(1.0, (sizes + (count - 1) * at.overlap) / count)[:, None]
    penalty = np.zeros((len(texts), sizes[0]))
    for i, (text, spans) in enumerate(texts):
        penalty[i, : len(spans)] = _penalties(text, spans[:, 0], spans[:, 1], at) + at.each
    first = at.imbalance * ((np.arange(room + 1) - fair) / fair) ** 2
    # the last column is the longest piece: cost of a piece that begins so many tokens before its end
    later = (at.imbalance * ((np.arange(step + 1) + at.overlap - fair) / fair) ** 2)[:, :0:-1]
    best = np.full((len(texts), step + sizes[0] + 1), np.inf)  # ``step`` columns of padding, then one a token count
    back = np.zeros((len(texts), sizes[0] + 1), dtype=np.int64)
    alive = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), side="right")  # texts with at least so many tokens
    for j in range(1, sizes[0] + 1):
        n = alive[j]
        costs = best[:n, j : j + step] + later[:n]
        where = costs.argmin(axis=1)
        least = costs[np.arange(n), where]
        where += j - step
        if j <= room:
            whole = first[:n, j] <= least
            least, where = np.where(whole, first[:n, j], least), np.where(whole, 0, where)
        best[:n, step + j] = least + penalty[:n, j - 1]
        back[:n, j] = where
    out = []
    for i, size in enumerate(sizes.tolist()):
        ends = [size]
        while back[i, ends[-1]]:
            ends.append(int(back[i, ends[-1]]))
        out.append(ends[::-1])
    return out


def split(df: DataFrame, key: str = "chunk_key", text: str = "raw_text", path: str = "section_path", limits: Limits = Limits()) -> DataFrame:
    """The pieces of every text: key, piece_index, start_pos, end_pos, n_tokens, piece, section_path.

    A null text gives no piece; an empty or blank one gives one piece, so no row
    is lost. Each piece after the first begins with the last ``overlap`` tokens
    of the one before. Rows sent again give their pieces once; a null or empty
    section_path is kept; other columns are dropped. Texts are taken whole.
    """
    kind = df.select(F.col(key)).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            made: list[list] = [[], [], [], [], []]
            texts = batch.column(1).to_pylist()
            there = [row for row, whole in enumerate(texts) if whole is not None]
            for row, found in zip(there, cuts_of([texts[row] for row in there], limits)):
                for index, (start, end, n) in enumerate(found):
                    rows.append(row)
                    for column, item in zip(made, (index, start, end, n, texts[row][start:end])):
                        column.append(item)
            taken = pa.array(rows, pa.int64())
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), *(pa.array(c, t) for c, t in zip(made, types)), batch.column(2).take(taken)],
                names=["key", "piece_index", "start_pos", "end_pos", "n_tokens", "piece", "section_path"],
            )

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"), F.col(path).cast("array<string>").alias("p"))
    schema = f"key {kind}, piece_index int, start_pos int, end_pos int, n_tokens int, piece string, section_path array<string>"
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)
