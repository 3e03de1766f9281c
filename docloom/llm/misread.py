"""Words with misread characters, told by the words and word pairs of the whole corpus.

A word is misread if undoing one or two usual confusions of a recogniser gives
a word that is far more frequent and that fits its neighbours. Word and pair
counts cover all texts; only words and pairs above a share of all of them are
kept, so the tables are bounded by the inverse of that share.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.lookalike import canonical
from docloom.session import cut

# What a recogniser makes of a letter, and the letters it may have been.
CONFUSED = (("ri", "n"), ("rn", "m"), ("li", "h"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("1", "i"), ("1", "l"), ("0", "o"), ("9", "g"), ("5", "s"), ("6", "b"), ("8", "b"), ("3", "e"))
STRAY = "|~^`;'"
#: shares of all words and of all pairs below which a word or pair isn't kept: at most 500 000 words and 250 000 pairs
WORD_SHARE, PAIR_SHARE = 2e-6, 4e-6
WORD = re.compile(r"[^\s.,:()\[\]{}<>/\"“”«»…!+*=&%$#\\-]+")
_TAG = re.compile(r"</?\w+>")
_EDGE = ";'’‘`?!"


def words(text: str) -> list[str]:
    """The words of a canonical text, in lower case, outer marks off."""
    return [w for w in (t.strip(_EDGE).lower() for t in WORD.findall(_TAG.sub(" . ", text))) if w]


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    marks = unicodedata.normalize("NFD", word.replace("đ", "d"))
    return "".join(c for c in marks if not unicodedata.combining(c))


def _marks(word: str) -> list[tuple[str, frozenset]]:
    """Each base letter with its marks."""
    out: list[tuple[str, frozenset]] = []
    for char in unicodedata.normalize("NFD", word.replace("đ", "d̵")):
        if unicodedata.combining(char) and out:
            out[-1] = (out[-1][0], out[-1][1] | {char})
        else:
            out.append((char, frozenset()))
    return out


def one_mark_less(word: str, whole: str) -> bool:
    """Whether ``word`` is ``whole`` with the marks of one letter lost or changed."""
    a, b = _marks(word), _marks(whole)
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 and all(x[0] == y[0] for x, y in zip(a, b))


class Lexicon:
    """Kept words and pairs with their counts, and an index for the undoing of confusions."""

    def __init__(self, total: int, counts: dict[str, int], pairs: dict[tuple[str, str], int]):
        self.total, self.counts, self.pairs = total, counts, pairs
        self.least = max(3, int(total * 1e-5))
        self.by_fold: dict[str, list[str]] = defaultdict(list)
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for word, n in counts.items():
            if n >= self.least and word.isalpha():
                self.by_fold[fold(word)].append(word)
                self.by_length[len(word)].append(word)
        self.longest = max(map(len, counts), default=0)
        self.verdicts: dict[str, tuple] = {}

    def __getstate__(self) -> dict:
        return {"total": self.total, "counts": self.counts, "pairs": self.pairs}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def known(self, word: str) -> bool:
        return self.counts.get(word, 0) >= self.least

    def _undone(self, word: str) -> list[str]:
        """Kept words from undoing one or two confusions of letters, wherever they are in the word."""
        if len(word) > self.longest + 2:
            return []  # each undoing takes one letter away at most
        places = []
        for seen, meant in CONFUSED:
            at = word.find(seen)
            while at >= 0:
                places.append((at, at + len(seen), meant))
                at = word.find(seen, at + 1)
        out = []
        for size in (1, 2):
            for chosen in combinations(sorted(places), size):
                if size == 2 and chosen[0][1] > chosen[1][0]:
                    continue
                made, at = [], 0
                for start, end, meant in chosen:
                    made += [word[at:start], meant]
                    at = end
                out.append("".join([*made, word[at:]]))
        return [w for w in out if w in self.counts]

    def verdict(self, raw: str) -> tuple[str, tuple[str, ...]]:
        """What the form of a word says: ("", ()) clean, ("sure", words) misread, ("maybe", words) if the neighbours agree."""
        got = self.verdicts.get(raw)
        if got is None:
            if len(self.verdicts) > 300_000:
                self.verdicts.clear()
            got = self.verdicts[raw] = self._verdict(raw)
        return got

    def _verdict(self, raw: str) -> tuple[str, tuple[str, ...]]:
        word = raw.lower()
        letters = sum(c.isalpha() for c in word)
        if letters < 1 or len(word) < 2:
            return "", ()
        if re.search(r"[^\W\d_][|~^`]|[|~^`][^\W\d_]", word):
            bare = re.sub(r"[|~^`]", "", word)
            return "sure", (bare.strip(_EDGE),)
        if "@" in word or "_" in word or "(at)" in word:
            return "", ()
        inner = word.rstrip("?!'’;") if word.rstrip("?!'’;") in self.counts else word
        inner = inner.strip("'’‘;")
        if re.search(r"\?[^\W\d_]", inner):
            return "sure", self._filled(inner)
        if inner.endswith("?") and letters > 1 and not self.known(inner.rstrip("?!")):
            filled = self._filled(inner.rstrip("!"))
            if filled:
                return "sure", filled
        if m := re.search(r"[^\W\d_]([;'])[^\W\d_]", inner):
            bare = inner.replace(m.group(1), "")
            return ("sure", (bare,)) if self.known(bare) or self._best(bare, self._undone(bare)) else ("", ())
        inner = inner.strip(_EDGE)
        count = self.counts.get(inner, 0)
        if any(c.isdigit() for c in inner):
            if sum(c.isdigit() for c in inner) > 2 or letters < 2:
                return "", ()
            fits = self._best(inner, [w for w in self._undone(inner) if w.isalpha() and self.known(w)])
            return ("sure", fits) if fits else ("", ())
        if not inner.isalpha():
            return "", ()
        fits = self._best(inner, self._undone(inner), 12)
        if fits and count < max(self.least, self.counts[fits[0]] // 12):
            return "sure", fits
        near = tuple(w for w in self.by_fold.get(fold(inner), ()) if w != inner and self.counts[w] > 8 * count and one_mark_less(inner, w))
        if near:
            near = tuple(sorted(near, key=lambda w: (-self.counts[w], w)))
            return ("likely" if count * 50 < self.counts[near[0]] else "maybe"), near
        return "", ()

    def _best(self, word: str, found: list[str], times: int = 5) -> tuple[str, ...]:
        mine = self.counts.get(word, 0)
        good = [w for w in dict.fromkeys(found) if self.counts[w] >= max(self.least, times * mine)]
        return tuple(sorted(good, key=lambda w: (-self.counts[w], w)))

    def _filled(self, word: str) -> tuple[str, ...]:
        """Known words that fit with any letter in place of each question mark."""
        rule = re.compile("".join("." if c == "?" else re.escape(c) for c in word))
        found = [w for w in self.by_length.get(len(word), ()) if rule.fullmatch(w)]
        return tuple(sorted(found, key=lambda w: (-self.counts[w], w)))

    def fits(self, before: str, word: str, after: str, kind: str, found: tuple[str, ...], capital: bool) -> str | None:
        """The word meant, if the neighbours (empty where there is none) support it, else None."""
        pairs = self.pairs
        if kind == "sure":
            if len(found) > 1:
                return max(found, key=lambda w: (pairs.get((before, w), 0) + pairs.get((w, after), 0), self.counts.get(w, 0)))
            return found[0] if found else word
        for other in found:
            left, right = pairs.get((before, other), 0) if before else -1, pairs.get((other, after), 0) if after else -1
            mine_left, mine_right = pairs.get((before, word), 0), pairs.get((word, after), 0)
            least = self.least * (3 if capital else 1)
            good_left = left >= least and left > 8 * mine_left
            good_right = right >= least and right > 8 * mine_right
            if kind == "likely" and not capital:
                if (good_left or good_right) and mine_left <= max(left, 0) and mine_right <= max(right, 0):
                    return other
            elif (good_left or left < 0) and (good_right or right < 0) and (good_left or good_right):
                return other
        return None


def count(texts: DataFrame, text: str = "text") -> Lexicon:
    """Counts the words and pairs of all texts; keeps those above the shares. Partial counts are made before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(pairs)
            made = pa.RecordBatch.from_arrays([pa.array([a for a, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.string()), pa.array([pairs[k] for k in keys], pa.int64())], names=["a", "b", "n"])
            pairs.clear()
            return made

        for batch in batches:
            for whole in batch.column(0).to_pylist():
                got = words(canonical(whole))
                pairs.update(zip(got, [*got[1:], ""]))
            if len(pairs) > 500_000:
                yield flush()
        yield flush()

    source = texts.select(F.col(text).cast("string").alias("t")).where("t is not null")
    pairs = source.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = cut(pairs)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    singles = pairs.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, total * WORD_SHARE))
    kept = pairs.where((F.col("n") >= max(2, total * PAIR_SHARE)) & (F.col("b") != ""))
    return Lexicon(total, {r.a: r.n for r in singles.collect()}, {(r.a, r.b): r.n for r in kept.collect()})
