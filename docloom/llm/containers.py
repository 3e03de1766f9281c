"""Problem 7: documents into containers of one token capacity.

Lexical retrieval packing. The documents of a scan partition are taken in
shards; each shard gets a BM25 inverted index. The longest unused document
seeds a container, its unused lexical neighbours fill the window in order of
score, and what room they leave is filled best-fit. Document frequencies and
the mean length are those of the whole corpus. Nothing is shuffled but counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import tokens
from docloom.session import cut

_UNSPACED = "฀-๿ក-៿぀-ヿ㐀-鿿가-힣"
_UNSPACED_TEXT = re.compile(f"[{_UNSPACED}]")
WORD = re.compile(rf"[^\W\d_{_UNSPACED}]+|[฀-๿ក-៿]{{1,4}}|[぀-ヿ㐀-鿿가-힣]{{1,2}}")


class Terms(dict):
    """The index term of each blank-separated word: its letters without the marks around them, ``""`` if it has none."""

    def __missing__(self, word: str) -> str:
        found = WORD.search(word)
        term = "" if found is None else word[found.start() :].rstrip(".,;:!?…)]}”»\"'/-%0123456789")
        if len(self) > 1_000_000:
            self.clear()
        self[word] = term
        return term


def words_of(text: str) -> list[str]:
    """Lower-case words; a text with scripts that don't space words is cut into short runs of these."""
    low = text.lower()
    return low.split() if _UNSPACED_TEXT.search(low) is None else WORD.findall(low)


@dataclass(frozen=True)
class Packing:
    """capacity in tokens; documents and characters of an index shard; seeds scored at once; BM25 constants. A seed is queried by all its terms.

    Terms in less than ``share`` of the documents count as just so frequent; of
    the others the ``table`` most frequent are kept, so the table that is sent
    along has a bound, and the rest count as frequent as the last of these.
    """

    capacity: int = 2048
    shard: int = 4096
    shard_chars: int = 32_000_000
    seeds: int = 48
    k1: float = 1.2
    b: float = 0.75
    share: float = 1e-4
    table: int = 300_000
    vocabulary: str = tokens.VOCABULARY


@dataclass
class Corpus:
    documents: int
    mean_words: float
    frequency: dict[str, int]
    least: int = 2


def statistics(df: DataFrame, text: str, at: Packing) -> Corpus:
    """Document frequencies and mean length over all documents; partial counts are made in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        terms = Terms()
        n = words = 0

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
            seen.clear()
            return made

        for batch in batches:
            for whole in batch.column(0).to_pylist():
                found = words_of(whole)
                n += 1
                words += len(found)
                seen.update(set(map(terms.__getitem__, set(found))))
            if len(seen) > 1_000_000:
                yield flush()
        seen["\0documents"], seen["\0words"] = n, words
        yield flush()

    counted = df.select(F.col(text).cast("string").alias("t")).where("t is not null").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    total = counted.where(F.col("term") == "\0documents").agg(F.sum("n")).first()[0] or 0
    least = max(2, math.ceil(total * at.share))
    words = counted.where(F.col("term") == "\0words").agg(F.sum("n")).first()[0] or 0
    rows = counted.where((F.col("n") >= least) & (F.col("term") != "") & ~F.col("term").startswith("\0")).orderBy(F.col("n").desc(), "term").limit(at.table).collect()
    frequency = {r.term: r.n for r in rows}
    return Corpus(total, words / total if total else 1.0, frequency, rows[-1].n if len(rows) == at.table else least)


class Index:
    """BM25 postings of one shard."""

    def __init__(self, texts: list[str], corpus: Corpus, at: Packing):
        terms_of = Terms()
        lists = [words_of(t) for t in texts]
        raw = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(lists)))}
        ids: dict[str, int] = {}
        to_term = np.fromiter((ids.setdefault(t, len(ids)) if (t := terms_of[w]) else -1 for w in raw), dtype=np.int64, count=len(raw))
        flat = np.fromiter(map(raw.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=sum(map(len, lists)))
        flat = to_term[flat] if len(raw) else flat
        lengths = np.array([len(w) for w in lists], dtype=np.int64)
        n, size = len(texts), max(1, len(ids))
        keys, tf = np.unique((np.repeat(np.arange(n), lengths) + flat * n)[flat >= 0], return_counts=True)
        self.n = n
        self.docs, terms = (keys % n).astype(np.int64), keys // n
        df = np.fromiter((corpus.frequency.get(w, corpus.least) for w in ids), dtype=np.float64, count=len(ids)) if ids else np.ones(1)
        idf = np.log1p((corpus.documents - df + 0.5).clip(0) / (df + 0.5))
        norm = at.k1 * (1 - at.b + at.b * lengths / max(corpus.mean_words, 1))
        self.weight = idf[terms] * tf * (at.k1 + 1) / (tf + norm[self.docs])
        self.begin = np.searchsorted(terms, np.arange(size + 1))
        by_doc = np.lexsort((-self.weight, self.docs))
        self.of_doc = np.searchsorted(self.docs[by_doc], np.arange(n + 1))
        self.terms_by_weight = terms[by_doc]
        # terms of many documents lie in rows of a matrix, those of few stay lists of postings
        sizes = np.diff(self.begin)
        heavy = np.flatnonzero(sizes > max(32, n // 50))
        self.row = np.full(size, -1, dtype=np.int64)
        self.row[heavy] = np.arange(len(heavy))
        self.dense = np.zeros((len(heavy), n), dtype=np.float32)
        mine = self.row[terms] >= 0
        self.dense[self.row[terms[mine]], self.docs[mine]] = self.weight[mine]

    def scores(self, doc: int, most: int) -> np.ndarray:
        """Of all documents of the shard for the terms that weigh most in ``doc``."""
        query = self.terms_by_weight[self.of_doc[doc] : self.of_doc[doc + 1]][:most]
        if not len(query):
            return np.zeros(self.n)
        parts = [slice(self.begin[t], self.begin[t + 1]) for t in query]
        return np.bincount(np.concatenate([self.docs[p] for p in parts]), np.concatenate([self.weight[p] for p in parts]), self.n)


    def score_all(self, seeds: list[int]) -> np.ndarray:
        """Of all documents of the shard for all terms of each of several seeds."""
        out = np.zeros((len(seeds), self.n), dtype=np.float32)
        asked = np.zeros((len(seeds), len(self.dense)), dtype=np.float32)
        starts, sizes, owners = [], [], []
        for i, doc in enumerate(seeds):
            terms = self.terms_by_weight[self.of_doc[doc] : self.of_doc[doc + 1]]
            rows = self.row[terms]
            asked[i, rows[rows >= 0]] = 1
            few = terms[rows < 0]
            starts.append(self.begin[few])
            sizes.append(self.begin[few + 1] - starts[-1])
            owners.append(np.full(len(few), i))
        start, size, owner = np.concatenate(starts), np.concatenate(sizes), np.concatenate(owners)
        ends = np.cumsum(size)
        taken = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
        if len(taken):
            out += np.bincount(np.repeat(owner, size) * self.n + self.docs[taken], self.weight[taken], out.size).reshape(out.shape).astype(np.float32)
        return out + asked @ self.dense if len(self.dense) else out


def pack(sizes: list[int], index: Index, at: Packing) -> list[list[tuple[int, int, int]]]:
    """Containers of (document, first token, end token); only a document longer than the capacity is cut."""
    out: list[list[tuple[int, int, int]]] = []
    rest = np.zeros(len(sizes), dtype=np.int64)
    for doc, size in enumerate(sizes):
        whole = size // at.capacity if size > at.capacity else 0
        out += [[(doc, i * at.capacity, (i + 1) * at.capacity)] for i in range(whole)]
        rest[doc] = size - whole * at.capacity
    free = np.array([r > 0 or s == 0 for r, s in zip(rest, sizes)], dtype=bool)
    stacks: dict[int, list[int]] = {}
    for doc in np.flatnonzero(free)[::-1].tolist():
        stacks.setdefault(int(rest[doc]), []).append(doc)
    there = np.zeros(at.capacity + 1, dtype=np.int64)
    for size, docs in stacks.items():
        there[size] = len(docs)

    def take(doc: int, window: list[tuple[int, int, int]]) -> int:
        free[doc] = False
        there[rest[doc]] -= 1
        window.append((doc, sizes[doc] - int(rest[doc]), sizes[doc]))
        return int(rest[doc])

    order = np.argsort(-rest, kind="stable").tolist()
    scored: dict[int, np.ndarray] = {}
    for place, seed in enumerate(order):
        if not free[seed]:
            continue
        window: list[tuple[int, int, int]] = []
        room = at.capacity - take(seed, window)
        least = int(np.flatnonzero(there)[0]) if there.any() else at.capacity + 1
        if room >= least:
            if seed not in scored:
                block = [seed]
                for doc in order[place + 1 :]:
                    if len(block) == at.seeds:
                        break
                    if free[doc]:
                        block.append(doc)
                scored = dict(zip(block, index.score_all(block)))
            score = scored[seed]
            near = np.flatnonzero(free & (score > 0) & (rest <= room))
            for doc in near[np.argsort(-score[near], kind="stable")].tolist():
                if rest[doc] <= room:
                    room -= take(doc, window)
                    if room < least:
                        break
        while room >= 0:
            fits = np.flatnonzero(there[: room + 1])
            if not len(fits):
                break
            docs = stacks[int(fits[-1])]
            while not free[docs[-1]]:
                docs.pop()
            room -= take(docs.pop(), window)
        out.append(window)
    return out


def fill(df: DataFrame, key: str = "doc_id", text: str = "text", at: Packing = Packing()) -> DataFrame:
    """Places of all documents: key, container_no, position, part, first_token, end_token, n_tokens, capacity.

    container_no is unique over the whole result, not dense; which documents come
    together follows the partitions of the scan, so another cluster may pack the
    same documents otherwise. A document within
    the capacity has one row (part 0); a longer one has a row for each part. A
    null text has no row; an empty one takes a place of no tokens. Documents
    with equal texts are documents of their own. Other columns are dropped. A
    scan partition's last container may stay partly empty; no container holds
    more than the capacity.
    """
    kind = df.select(F.col(key)).dtypes[0][1]
    corpus = df.sparkSession.sparkContext.broadcast(statistics(df, text, at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        made, keys, texts, chars = 0, [], [], 0
        encode = tokens.encoding(at.vocabulary).encode_ordinary

        def close() -> pa.RecordBatch:
            nonlocal made, chars
            chars = 0
            packed = pack([len(encode(t)) for t in texts], Index(texts, corpus.value, at), at)
            rows = [(d, made + c, p, a, b) for c, window in enumerate(packed) for p, (d, a, b) in enumerate(window)]
            made += len(packed)
            doc, box, place, first, end = (np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else ([],) * 5))
            out = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys).take(pa.array(doc)), pa.array(box + base), pa.array(place.astype(np.int32)), pa.array((first // at.capacity).astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array((end - first).astype(np.int32))],
                names=["key", "container_no", "position", "part", "first_token", "end_token", "n_tokens"],
            )
            keys.clear()
            texts.clear()
            return out

        for batch in batches:
            found, start = batch.column(1).to_pylist(), 0
            for i, whole in enumerate(found):
                if texts and (len(texts) >= at.shard or chars + len(whole) > at.shard_chars):
                    keys.append(batch.column(0).slice(start, i - start))
                    yield close()
                    start = i
                texts.append(whole)
                chars += len(whole)
            keys.append(batch.column(0).slice(start))
        if texts:
            yield close()

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).where("t is not null")
    schema = f"key {kind}, container_no long, position int, part int, first_token int, end_token int, n_tokens int"
    return source.mapInArrow(run, schema).withColumn("capacity", F.lit(at.capacity)).withColumnRenamed("key", key)


def report(packed: DataFrame) -> DataFrame:
    """containers, documents, tokens, mean fill and the share of room left, of a result of ``fill``."""
    boxes = packed.groupBy("container_no").agg(F.sum("n_tokens").alias("held"), F.max("capacity").alias("capacity"), F.count(F.lit(1)).alias("parts"))
    return boxes.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("parts").alias("parts"), F.sum("held").alias("tokens"), F.round(F.avg(F.col("held") / F.col("capacity")), 6).alias("mean_fill"), F.max(F.col("held") / F.col("capacity")).alias("most_fill"),
    )
