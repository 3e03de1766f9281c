"""Problem 4: noise in text from scanned pages, and the paragraphs without it.

The lines of a page are labelled by a linear-chain CRF over layout features:
running head or foot, page number, end of a paragraph, body. It is trained on
made-up pages whose labels are known. Lines of running heads are recognised
across the pages of a document, misread characters notwithstanding. Words
broken over lines and misread words are told by ``misread``'s lexicon.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import crf, misread
from docloom.llm.lookalike import canonical
from docloom.session import cut

LABELS = ["O", "break", "running", "pageno"]
MOTTO = "conghoaxahoi"
#: pages of a document that go to one task; heads are compared over the whole document, all else within a page
PAGES_TOGETHER = 64
#: lines held at a time, cut between pages; a single page of more is read through a window that overlaps by ``MARGIN`` lines
FLUSH, MARGIN = 60_000, 256
#: head keys of a document beyond which they are compared in cells
KEYS_TOGETHER = 4000
_PAGENO = re.compile(r"[\s.\-–—\[(|]*(?:(?:trang|page|tr\.?|p\.?)\s*)?(\d{1,4})(?:\s*(?:/|of|trên)\s*(\d{1,4}))?[\s.\-–—\])|]*", re.IGNORECASE)
_SUFFIX = re.compile(r"(?:\s*[-–|•/]\s*|\s+)(?:(?:trang|page)\s*)?(\d{1,4})(?:\s*(?:/|of)\s*\d{1,4})?[\s.'~\-–]*$", re.IGNORECASE)
_HYPHENS = "-‐‑¬"
_BROKEN = re.compile(rf"([^\W\d_]+)(\s?)[{_HYPHENS}]\s*$")
_GOES_ON = re.compile(r"\s*([^\W\d_]+)")


@dataclass
class Line:
    """One line; ``top`` is its place on the page from 0 to 1, None where unknown."""

    key: int
    pos: int
    page: int
    index: int
    text: str
    top: float | None
    block: int
    plain: str = ""
    heads: tuple[str, ...] = ()
    recurs: bool = False
    label: str = "O"
    kinds: list[str] = field(default_factory=list)
    fixed: str = ""


def head_keys(plain: str, page: int) -> tuple[str, ...]:
    """What stays of a head or foot line if case, accents and misread letters are put aside; also without the page's number at its end."""
    m = _SUFFIX.search(plain)
    out = []
    for text in [plain, plain[: m.start()]] if m and int(m.group(1)) == page else [plain]:
        text = misread.fold(text.lower())
        for seen, meant in misread.CONFUSED:
            text = text.replace(seen, meant)
        text = re.sub(r"[^\w?]", "", text)
        if len(text) >= 4:
            out.append(text)
    return tuple(out)


def _near(a: str, b: str, most: int) -> bool:
    """Whether two keys differ in at most ``most`` edits; ``?`` fits any letter."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    width = len(b) + 1
    row = list(range(width))
    for i, x in enumerate(a, 1):
        last, row[0], low = row[0], i, i
        for j in range(1, width):
            y = b[j - 1]
            here = min(row[j] + 1, row[j - 1] + 1, last + (x != y and x != "?" and y != "?"))
            last, row[j] = row[j], here
            low = min(low, here)
        if low > most:
            return False
    return row[-1] <= most


def _edges(lines: list[Line]) -> list[Line]:
    """The lines at the edges of pages, in which heads and feet are looked for."""
    pages: dict[int, list[Line]] = defaultdict(list)
    for line in lines:
        pages[line.page].append(line)
    out: list[Line] = []
    for page in pages.values():
        chosen = {id(x): x for x in page[:4] + page[-4:]} | {id(x): x for x in page if x.top is None or x.top < 0.1 or x.top > 0.9}
        out += chosen.values()
    return out


def _set_heads(line: Line) -> None:
    line.heads = () if _PAGENO.fullmatch(line.plain) else head_keys(line.plain, line.page)


def near_keys(keys: list[str], spans: list[tuple[int, int]], asked: list[bool]) -> list[str]:
    """The asked keys that stand on one page only and are near to a key of another page. ``spans``: least and greatest page of each key."""
    if len({x for span in spans for x in span}) < 2:
        return []
    bags = np.zeros((len(keys), 28), dtype=np.int16)
    for i, key in enumerate(keys):
        for char in key:
            bags[i, ord(char) - 97 if "a" <= char <= "z" else 26 if char.isdigit() else 27] += 1
    lengths = bags.sum(axis=1)
    out = []
    for i, a in enumerate(keys):
        low, high = spans[i]
        if low != high or not asked[i]:
            continue
        # an edit changes two of the letter counts at most, a question mark stands for any letter
        most = edits_of(len(a))
        apart = np.abs(bags - bags[i]).sum(axis=1) <= 2 * (most + bags[i, 27] + bags[:, 27])
        for j in np.flatnonzero(apart & (np.abs(lengths - lengths[i]) <= most) & (bags[:, 26] == bags[i, 26])).tolist():
            if j != i and spans[j] != (low, high) and _near(a, keys[j], most):
                out.append(a)
                break
    return out


def edits_of(length: int) -> int:
    """In how many edits a key of this length may differ from one it is near to."""
    return max(1, length // 8)


def _is_motto(line: Line) -> bool:
    return MOTTO in misread.fold(line.plain.lower()).replace(" ", "")


def observe(page: list[Line], total: int, after: bool = False) -> list[str]:
    """What the model sees of each line of a page, as one token a line. ``after``: the letterhead stands before these lines."""
    out, n = [], len(page)
    mottos = [_is_motto(x) for x in page]
    tops = [x.top for x in page]
    gaps = [b - a for a, b in zip(tops, tops[1:]) if a is not None and b is not None and b > a]
    usual = sorted(gaps)[len(gaps) // 2] if gaps else 0
    for i, line in enumerate(page):
        zone = "?" if line.top is None else "T" if line.top < 0.048 else "t" if line.top < 0.11 else "B" if line.top > 0.945 else "b" if line.top > 0.89 else "M"
        number = "-"
        m = _PAGENO.fullmatch(line.plain)
        if m:
            first, second = int(m.group(1)), m.group(2)
            bare = line.plain.strip().isdigit()
            number = "other" if first != line.page else "total" if second and int(second) == total else "of" if second else "bare" if bare else "page"
        letterhead = mottos[i] or i + 1 < n and mottos[i + 1]
        next_top = page[i + 1].top if i + 1 < n else None
        gap = "e" if i + 1 == n else "n" if page[i + 1].block != line.block else "s" if line.top is None or next_top is None or not usual else "g" if next_top - line.top > 1.35 * usual else "s"
        stop = "." if line.plain.rstrip()[-1:] in ".!?:;" else ","
        out.append(f"{zone}|{int(line.recurs)}|{number}|{int(letterhead)}{int(after)}|{min(i, 2)}|{min(n - 1 - i, 2)}|{int(line.page == 1)}|{gap}{stop}")
        after = after or mottos[i]
    return out


def line_features(token: str) -> list[str]:
    if token == crf.PAD:
        return ["pad"]
    zone, back, number, letter, top, bottom, first, gap = token.split("|")
    return [
        f"z{zone}r{back}l{letter}", f"z{zone}n{number}", f"n{number}b{bottom}t{top}", f"r{back}", f"n{number}", f"z{zone}", f"g{gap}", f"r{back}f{first}l{letter}t{top}", f"z{zone}n{number}b{bottom}", f"l{letter}f{first}r{back}",
        f"z{zone}r{back}", f"b{bottom}r{back}z{zone}",
    ]


def made_up_pages(size: int = 700, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The labelled table: ``size`` pages as observations with their labels."""
    r = random.Random(seed)
    out = []
    while len(out) < size:
        total, head, foot, as_lines = r.randint(1, 6), r.random() < 0.55, r.random() < 0.45, r.random() < 0.4
        title_head = head and r.random() < 0.5
        for number in range(1, total + 1):
            page: list[tuple[float | None, str, str, bool, int, str]] = []  # top, text, label, recurs, block, -
            block = 0

            def put(top: float, text: str, label: str, recurs: bool = False, new: bool = True) -> None:
                nonlocal block
                block += new
                page.append((None if r.random() < 0.06 else top, text, label, recurs, block))

            several = total > 1
            if head and (number > 1 or not title_head) and r.random() < 0.93:
                for k in range(r.choice([1, 1, 2])):
                    put(0.026 + r.random() * 0.015, "Thư viện / Hộp 16", "running" if several else "break", several, k == 0)
            if number == 1:
                back = several and r.random() < 0.3
                for k, text in enumerate(["SỞ GIÁO DỤC MỘC KHÊ", "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "Độc lập - Tự do"][: 2 if as_lines else 3]):
                    put(0.051 + r.random() * 0.02, text, "break", back and k == 0, as_lines or k == 0)
                put(0.108 + r.random() * 0.03, "Quyết định về việc", "break", title_head and several)
            top = 0.2
            for _ in range(r.randint(1, 5)):
                size_of = r.randint(1, 5)
                for k in range(size_of):
                    last, again = k == size_of - 1, several and r.random() < 0.08  # body text may come back too
                    if as_lines:
                        put(top, "dòng văn bản" + ("." if last or r.random() < 0.1 else ""), "break" if last else "O", again)
                        top += 0.036 if last else 0.021
                    else:
                        put(top, "dòng văn bản" + ("." if last or r.random() < 0.1 else ""), "break" if last else "O", again, k == 0)
                top += 0.0 if as_lines else 0.12
            if r.random() < 0.2:
                put(0.6 + r.random() * 0.01, r.choice([f"{r.randint(1, 9)}/{r.randint(9, 12)}", f"[{r.randint(1, 9)}]", str(r.randint(1, 40))]), "break")
            if number == total:
                for k, text in enumerate(["Nơi nhận:", "- Như Điều 3;", "- Lưu VT."][: r.randint(0, 3)]):
                    put(0.8 + r.random() * 0.01, text, "break" if k == 2 else "O", False, k == 0)
                put(0.82 + r.random() * 0.01, "GIÁM ĐỐC", "break")
                put(0.9 + r.random() * 0.011, "TS. Trần An", "break")
            if foot and r.random() < 0.93:
                put(0.942 + r.random() * 0.017, "Mã hồ sơ", "running" if several else "break", several)
            if r.random() < 0.6:
                text = r.choice([f"{number}", f"- {number} -", f"[{number}]", f"Trang {number}/{total}", f"{number}/{total}", f"Page {number} of {total}", f". {number}"])
                if r.random() < 0.35:
                    place = 0.011 + r.random() * 0.009
                    where = len(page) if r.random() < 0.5 else r.choice([0, 0, 1, 1, 2])
                    page.insert(where, (None if r.random() < 0.06 else place, text, "pageno", False, 99 if where else -1))
                else:
                    put(0.97 + r.random() * 0.01, text, "pageno")
            lines = [Line(0, 0, number, i, text, at, b, plain=text, recurs=back) for i, (at, text, _, back, b) in enumerate(page)]
            out.append((observe(lines, total if r.random() < 0.85 else total + 1), [x[2] for x in page]))
    return out[:size]


@cache
def model(size: int = 700) -> crf.Model:
    return crf.train(made_up_pages(size), line_features, LABELS, lambda a, b: True, epochs=8, least=1)


_DECODERS: list[tuple[float, crf.Decoder]] = []


def _decoder(made: crf.Model) -> crf.Decoder:
    key = float(made.weights.sum())
    if not _DECODERS or _DECODERS[0][0] != key:
        _DECODERS[:] = [(key, crf.Decoder(made, line_features))]
    return _DECODERS[0][1]


def _case(word: str, model_of: str) -> str:
    letters = [c for c in model_of if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if model_of[:1].isupper() else word


def _words(lines: list[Line], lexicon: misread.Lexicon) -> None:
    """Finds broken and misread words in the body lines of one block, in order, and mends them in ``fixed``."""
    tokens: list[tuple[int, int, int, str]] = []  # line, start, end, raw
    broken_ends, broken_starts = set(), set()
    for i, line in enumerate(lines):
        line.fixed = line.plain
        if i + 1 < len(lines):
            m, n = _BROKEN.search(line.plain), _GOES_ON.match(lines[i + 1].plain)
            if m and n and _is_broken(m.group(1), bool(m.group(2)), n.group(1), line.plain[: m.start()], lexicon):
                line.kinds.append("hyphen")
                broken_ends.add((i, m.start(1)))
                broken_starts.add((i + 1, n.start(1)))
    for i, line in enumerate(lines):
        for m in misread.WORD.finditer(misread._TAG.sub(lambda t: " " * len(t.group()), line.plain)):
            tokens.append((i, m.start(), m.end(), m.group()))
    lower = [t[3].strip(misread._EDGE).lower() for t in tokens]
    real = [k for k, w in enumerate(lower) if w]
    place = {k: p for p, k in enumerate(real)}
    fixes: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
    for k, (i, start, end, raw) in enumerate(tokens):
        kind, found = lexicon.verdict(raw)
        if not kind:
            continue
        if _skip(i, start, end, broken_ends, broken_starts):
            continue
        p = place.get(k)
        before = lower[real[p - 1]] if p else ""
        after = lower[real[p + 1]] if p is not None and p + 1 < len(real) else ""
        if lines[i].plain[max(0, start - 1) : start] == "@" or lines[i].plain[end : end + 1] == "@":
            continue
        capital = raw[:1].isupper() and not raw.isupper() and bool(start) and _capital_beside(tokens, k)
        word = lexicon.fits(before, lower[k], after, kind, found, capital)
        if word is not None:
            if "glyph" not in lines[i].kinds:
                lines[i].kinds.append("glyph")
            fixes[i].append((start, end, _case(word, raw)))
    for i, marks in fixes.items():
        text = lines[i].plain
        for start, end, word in sorted(marks, reverse=True):
            tail = re.search(r"[;'’?!]*$", text[start:end]).group() if text[start:end][-1:] in ";?!" and word[-1:].isalpha() and not word.endswith(text[start:end][-2:-1]) else ""
            text = text[:start] + word + (tail if tail == ";" else "") + text[end:]
        lines[i].fixed = text


def _skip(i: int, start: int, end: int, ends: set, starts: set) -> bool:
    return any(a == i and start <= s < end for a, s in ends) or any(a == i and start <= s < end for a, s in starts)


def _capital_beside(tokens: list, k: int) -> bool:
    return any(0 <= j < len(tokens) and tokens[j][3][:1].isupper() for j in (k - 1, k + 1))


def _is_broken(left: str, blank: bool, right: str, before: str, lexicon: misread.Lexicon) -> bool:
    """Whether a line that ends in ``left`` and a hyphen goes on within the word in ``right``."""
    upper = left.isupper() and len(left) > 1 and right.isupper()
    if right[:1].isupper() and not upper:
        return False
    if before[-1:] in "/-_@.0123456789":
        return False
    joined = (left + right).lower()
    if lexicon.known(joined):
        return True
    a, b = lexicon.known(left.lower()), lexicon.known(right.lower())
    if a and b and lexicon.pairs.get((left.lower(), right.lower()), 0) >= lexicon.least:
        return False
    if lexicon.verdict(joined)[0]:
        return True
    return not (a and b) and not upper


def work(lines: list[Line], back: set[str], total: int, lexicon: misread.Lexicon, made: crf.Model, one_block: bool, after: bool = False) -> None:
    """Labels lines of a document, ordered by page, index and place. ``back``, ``total``: the heads that come back in the whole document, its last page. ``one_block``: the lines of a page run on. ``after``: the first page's letterhead stands before its lines."""
    for line in lines:
        line.plain, line.kinds, line.label, line.recurs = canonical(line.text), [], "O", False
    for line in _edges(lines):
        _set_heads(line)
        line.recurs = any(h in back for h in line.heads)
    pages: list[list[Line]] = []
    for line in lines:
        if line.plain.strip():
            if not pages or pages[-1][0].page != line.page:
                pages.append([])
            pages[-1].append(line)
    if not pages:
        return
    labels, begins = _decoder(made).decode([observe(p, total, after and not i) for i, p in enumerate(pages)])
    for page, at in zip(pages, begins):
        for k, line in enumerate(page):
            line.label = LABELS[labels[at + k]]
            m = _PAGENO.fullmatch(line.plain)
            if line.label == "running" and not line.recurs or line.label == "pageno" and (not m or int(m.group(1)) != line.page):
                line.label = "break"  # an exact check: a head comes back, a page number is that of its page
            if line.label in ("running", "pageno"):
                line.kinds.append(line.label)
        runs: dict[int, list[Line]] = defaultdict(list)
        for line in page:
            if line.label not in ("running", "pageno"):
                runs[0 if one_block else line.block].append(line)
        for run in runs.values():
            _words(run, lexicon)


def label(part: Part, lexicon: misread.Lexicon, made: crf.Model) -> None:
    work(part.lines, part.back, part.total, lexicon, made, part.src != "ocr_block", part.after)


def paragraphs(lines: list[Line]) -> list[tuple[int, str]]:
    """page and text of each paragraph: noise lines left out, broken words joined, misread words mended."""
    out: list[tuple[int, str]] = []
    text, page, last = "", 0, None
    for line in lines:
        if line.label in ("running", "pageno") or not line.plain.strip():
            continue
        piece = line.fixed.strip()
        if last is not None and (last.label != "break" or "hyphen" in last.kinds) and line.page == last.page:
            text = re.sub(rf"\s?[{_HYPHENS}]\s*$", "", text) + piece if "hyphen" in last.kinds else f"{text} {piece}"
        else:
            if text:
                out.append((page, text))
            text, page = piece, line.page
        last = line
    if text:
        out.append((page, text))
    return out


# --- Spark ----------------------------------------------------------------------------------------------

ROWS = "src_table string, doc string, page int, idx int, row_key long, text string, top double"


def block_rows(blocks: DataFrame) -> DataFrame:
    """OCR blocks as rows of ``ROWS``; a block without page or document stands alone."""
    return blocks.select(
        F.lit("ocr_block").alias("src_table"), F.coalesce(F.upper("document_id"), F.concat(F.lit("row "), F.col("block_key").cast("string")), F.lit("")).alias("doc"), F.coalesce(F.col("page_number"), F.lit(0)).alias("page"),
        F.coalesce(F.col("block_index"), F.lit(0)).alias("idx"), F.col("block_key").alias("row_key"), F.col("content_raw").alias("text"), F.when(F.size("bbox") >= 4, F.get("bbox", F.lit(1))).alias("top"),
    ).where("text is not null")


def line_rows(lines: DataFrame, height: float = 3508.0) -> DataFrame:
    """Recognised lines as rows of ``ROWS``; ``height`` is that of a page in the pixels of ``poly``."""
    top = F.array_min(F.transform("poly", lambda p: F.get(p, F.lit(1)))) / F.lit(height)
    return lines.select(
        F.lit("page_vietocr_results").alias("src_table"), F.coalesce(F.upper("document_id"), F.concat(F.lit("row "), F.col("line_key").cast("string")), F.lit("")).alias("doc"), F.coalesce(F.col("page_number"), F.lit(0)).alias("page"),
        F.coalesce(F.col("line_id"), F.lit(0)).alias("idx"), F.col("line_key").alias("row_key"), F.col("text"), top.alias("top"),
    ).where("text is not null")


@dataclass
class Part:
    """Whole pages of a document, or a window of one page: lines before ``low`` were given out with the window before; ``more``: the page goes on."""

    src: str
    doc: str
    lines: list[Line]
    back: set[str]
    total: int
    low: int = 0
    more: bool = False
    after: bool = False

    @property
    def high(self) -> int:
        """Where to cut: after the last line that ends a paragraph and has ``MARGIN`` lines of its page behind it."""
        if not self.more:
            return len(self.lines)
        last = len(self.lines) - MARGIN
        return next((i + 1 for i in range(last - 1, self.low, -1) if self.lines[i].label == "break"), last)


def _documents(batches: Iterator[pa.RecordBatch], label: Callable[[Part], None], flush: int = FLUSH) -> Iterator[tuple[Part, list[Line]]]:
    """Parts of documents from sorted rows with their lines, each line once, after ``label`` has seen it amid its neighbours.

    Each part has the heads that come back in its document and the document's
    last page. At most some ``flush`` lines are held, unless one row has more.
    """
    part: Part | None = None
    last = None
    for batch in batches:
        for src, doc, page, idx, key, text, top, told, where in zip(*(batch.column(i).to_pylist() for i in range(9))):
            if part is None or (src, doc, where) != here:
                if part and part.lines:
                    label(part)
                    yield part, part.lines[part.low :]
                here, last = (src, doc, where), None
                part = Part(src, doc, [], set(), 0)
            if told:  # stands before the lines of its part
                part.total = max(part.total, page)
                part.back.add(text)
                continue
            if (page, idx, key, text) == last:
                continue  # sent again
            last = (page, idx, key, text)
            if len(part.lines) > flush:
                if page != part.lines[-1].page:
                    label(part)
                    yield part, part.lines[part.low :]
                    part = Part(src, doc, [], part.back, part.total)
                elif len(part.lines) > max(2 * flush, 4 * MARGIN):
                    begin = next((i + 1 for i in range(len(part.lines) - 1, -1, -1) if part.lines[i].page != page), 0)
                    if begin:
                        rest = part.lines[begin:]
                        del part.lines[begin:]
                        label(part)
                        yield part, part.lines[part.low :]
                        part = Part(src, doc, rest, part.back, part.total)
                    else:
                        part.more = True
                        label(part)
                        high = part.high
                        yield part, part.lines[part.low : high]
                        keep = max(0, high - MARGIN)
                        part = Part(src, doc, part.lines[keep:], part.back, part.total, high - keep, False, part.after or any(map(_is_motto, part.lines[part.low : high])))
            if src == "ocr_block":
                part.lines += [Line(key, i, page, idx, piece, top, idx) for i, piece in enumerate(text.split("\n"))]
            else:
                part.lines.append(Line(key, 0, page, idx, text, top, idx))
    if part and part.lines:
        label(part)
        yield part, part.lines[part.low :]


_PART = ["pages"]


def _width(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _parts(rows: DataFrame) -> DataFrame:
    return rows.select("src_table", "doc", "page", "idx", "row_key", "text", "top", F.lit(False).alias("told"), F.floor(F.col("page") / PAGES_TOGETHER).alias("pages"))


def _sorted(parts: DataFrame) -> DataFrame:
    return parts.repartition(_width(parts), "src_table", "doc", *_PART).sortWithinPartitions("src_table", "doc", *_PART, F.col("told").desc(), "page", "idx", "row_key", "text")


def _heads(parts: DataFrame) -> DataFrame:
    """src_table, doc, pages, page, key: each head key at the edges of the pages of each part; for each part also an empty key with its last page."""
    schema = pa.schema([("src_table", pa.string()), ("doc", pa.string()), ("pages", pa.int64()), ("page", pa.int32()), ("key", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple] = set()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [[] for _ in schema]
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)
            found.clear()
            return out

        for part, lines in _documents(batches, lambda part: None):
            where = (part.src, part.doc, lines[0].page // PAGES_TOGETHER)
            inside = set(map(id, lines))
            for line in _edges(part.lines):
                if id(line) in inside:
                    line.plain = canonical(line.text)
                    _set_heads(line)
                    found.update((*where, line.page, key) for key in line.heads)
            found.add((*where, max(x.page for x in lines), ""))
            if len(found) > 20_000:
                yield batch()
        yield batch()

    return _sorted(parts).mapInArrow(run, "src_table string, doc string, pages long, page int, key string")


def recurring(heads: DataFrame, together: int = KEYS_TOGETHER) -> DataFrame:
    """src_table, doc, key: the head keys that come back on another page of the whole document, exactly or nearly.

    The keys of a document are compared with each other at once; where there are
    more than ``together``, by length and number of digits, a key going to all
    lengths that may be near to it. That spreads the work and changes no result.
    """
    keys = cut(heads.where("key != ''").groupBy("src_table", "doc", "key").agg(F.min("page").alias("low"), F.max("page").alias("high")))
    large = keys.groupBy("src_table", "doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > together).select("src_table", "doc", F.lit(True).alias("large"))
    size = F.length("key")
    # lengths L with |L - size| <= edits_of(L)
    lengths = F.filter(F.sequence(size - F.floor(size / 8).cast("int") - 2, size + F.floor(size / 6).cast("int") + 2), lambda x: F.abs(x - size) <= F.greatest(F.lit(1), F.floor(x / 8)))
    digits = F.length(F.regexp_replace("key", r"\D", ""))
    marked = keys.join(large, ["src_table", "doc"], "left")
    cells = marked.select("src_table", "doc", "key", "low", "high", F.when(F.col("large"), digits).otherwise(-1).alias("digits"), F.explode(F.when(F.col("large"), lengths).otherwise(F.array(F.lit(-1)))).alias("length"))
    spreaded = cells.repartition(_width(cells), "src_table", "doc", "digits", "length").sortWithinPartitions("src_table", "doc", "digits", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(cell: tuple, group: list[tuple[str, int, int]]) -> list[tuple[str, str, str]]:
            names = [x[0] for x in group]
            return [(cell[0], cell[1], key) for key in near_keys(names, [x[1:] for x in group], [cell[3] in (-1, len(x)) for x in names])]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["src_table", "doc", "key"])

        current, group, found = None, [], []
        for batch in batches:
            for src, doc, key, low, high, digits, length in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (src, doc, digits, length) != current:
                    if len(group) > 1:
                        found += close(current, group)
                    current, group = (src, doc, digits, length), []
                    if len(found) > 20_000:
                        yield out(found)
                        found = []
                group.append((key, low, high))
        if len(group) > 1:
            found += close(current, group)
        yield out(found)

    near = spreaded.mapInArrow(run, "src_table string, doc string, key string")
    return keys.where("low != high").select("src_table", "doc", "key").unionByName(near)


def _told(rows: DataFrame) -> DataFrame:
    """The rows in parts, each part led by what the whole document tells it: the heads that come back and the last page."""
    parts = _parts(rows)
    heads = cut(_heads(parts).distinct())
    back = recurring(heads).join(heads.select("src_table", "doc", *_PART, "key").distinct(), ["src_table", "doc", "key"]).select("src_table", "doc", *_PART, F.lit(0).alias("page"), F.col("key").alias("text"))
    last = heads.where("key = ''")
    total = last.groupBy("src_table", "doc").agg(F.max("page").alias("page"))
    total = last.select("src_table", "doc", *_PART).distinct().join(total, ["src_table", "doc"]).select("src_table", "doc", *_PART, "page", F.lit("").alias("text"))
    told = back.unionByName(total).select("src_table", "doc", "page", F.lit(0).alias("idx"), F.lit(None).cast("long").alias("row_key"), "text", F.lit(None).cast("double").alias("top"), F.lit(True).alias("told"), *_PART)
    return _sorted(parts.unionByName(told))


def find(rows: DataFrame, lexicon: misread.Lexicon | None = None) -> DataFrame:
    """Every noisy line: src_table, row_key, line_pos, noise_kind (running, pageno, hyphen, glyph).

    ``rows`` is as from ``block_rows`` and ``line_rows``. Null texts are left
    out, empty ones have no noise; a null page or place counts as 0, a null
    document as one of its own; rows sent again count once. Heads and the last
    page are settled over the whole document; its lines are then labelled in
    parts of 64 whole pages, so a document of a third of all rows is spread. The
    lexicon is counted from all rows if none is given.
    """
    known = rows.sparkSession.sparkContext.broadcast(lexicon or misread.count(rows))
    made = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, int, int, str]] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [[], [], [], []]
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()))], names=["src_table", "row_key", "line_pos", "noise_kind"])
            found.clear()
            return out

        for part, lines in _documents(batches, lambda part: label(part, known.value, made)):
            found += [(part.src, x.key, x.pos, kind) for x in lines for kind in x.kinds]
            if len(found) > 20_000:
                yield batch()
        yield batch()

    return _told(rows).mapInArrow(run, "src_table string, row_key long, line_pos int, noise_kind string").distinct()


def repair(rows: DataFrame, lexicon: misread.Lexicon | None = None) -> DataFrame:
    """The continuous paragraphs of each document: src_table, document_id, page_number, para_index (on the page), paragraph."""
    known = rows.sparkSession.sparkContext.broadcast(lexicon or misread.count(rows))
    made = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part, lines in _documents(batches, lambda part: label(part, known.value, made)):
            if not part.low:
                counts.clear()  # only a window goes on with a page
            found = []
            for page, text in paragraphs(lines):
                found.append((part.src, part.doc, page, counts[page], text))
                counts[page] += 1
            columns = list(zip(*found)) if found else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["src_table", "document_id", "page_number", "para_index", "paragraph"])

    return _told(rows).mapInArrow(run, "src_table string, document_id string, page_number int, para_index int, paragraph string")
