"""Problem 5: one form for text that looks alike but is encoded differently.

A skeleton in the manner of Unicode's confusables: decompose, replace every
character by the prototype of its shape, decompose again. Two texts look alike
exactly if their skeletons are equal. The table of prototypes is the public
confusables list, asked of the ICU library that Spark ships (``prototypes``),
and the fixed letters below, which come first. Of the list the cased letters
whose prototype is one Latin letter are taken; digits, and letters of scripts
without case, stay what they are. ``canonical`` is the readable form: the
same replacements, but line breaks are kept and look-alike letters of a foreign
script are replaced only in words that hold no other letter of that script.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters of the same shape.
_CYRILLIC = ("авекмнорстухіјѕһԁԛԝѵӏАВЕКМНОРСТУХІЈЅԚԜѴӀ", "aвeкмнopcтyxijshdqwvlABEKMHOPCTYXIJSQWVl")
_GREEK = ("αινορυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "aivopucjABEZHIKMNOPTYXCJ")
_OTHER = ("օսոհｪɑɡɩʋᴏᴄᴠᴡᴢꞮƖÐƉð", "ounhｪagivocvwzIlĐĐđ")
HYPHENS = "‐‑‒–−⁃˗﹘﹣－"
_D = {"Đ": "D̵", "đ": "d̵"}
_SAME = ("<wide>", "<narrow>", "<font>")
_INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ"


@cache
def _tables() -> tuple[dict[int, str], dict[int, str], dict[str, str]]:
    """Replacements of single characters for the skeleton and for the canonical form, and the foreign look-alikes."""
    letters = {}
    for theirs, ours in (_CYRILLIC, _GREEK, _OTHER):
        letters |= {a: b for a, b in zip(theirs, ours) if a != b and b.isascii() or b in "Đđ"}
    plain: dict[int, str] = {}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Cf" and not 0x600 <= code <= 0x605 or char in _INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            plain[code] = ""
        elif char.isspace():
            plain[code] = char if char in "\n\r" else " "
        elif char in HYPHENS:
            plain[code] = "-"
        elif code > 0x7F:
            parts = unicodedata.decomposition(char)
            if parts.startswith(_SAME) or parts.startswith("<compat>") and (0x2160 <= code <= 0x217F or 0xFB00 <= code <= 0xFB06 or code == 0x2026):
                plain[code] = unicodedata.normalize("NFKC", char)
    for code, text in list(plain.items()):
        if text in letters:
            plain[code] = letters[text]
    shape = plain | {ord(a): _D.get(b, b) for a, b in letters.items()} | {ord(a): b for a, b in _D.items()}
    return shape, plain, letters


def prototypes(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    """Cased letters beyond ASCII with the one Latin letter of their shape, by the public confusables list of the ICU library in Spark's JVM.

    Raises where there is no such library or no JVM at hand, or the list can't be
    read whole: with the fixed letters alone pairs would be missed, and nothing would tell.
    """
    asked = [c for c in map(chr, range(0x80, 0x1F000)) if unicodedata.category(c) in ("Lu", "Ll") and not unicodedata.decomposition(c)]
    try:
        checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        found = checker.getSkeleton("\n".join(asked)).split("\n")
    except Exception as why:  # no JVM, or one without the library
        raise RuntimeError("the public confusables list can't be read: Spark's JVM with ICU's SpoofChecker is needed") from why
    if len(found) != len(asked):
        raise RuntimeError(f"the public confusables list can't be read: {len(found)} prototypes for {len(asked)} letters")
    pairs = ((c, "I" if p == "l" and unicodedata.category(c) == "Lu" else p) for c, p in zip(asked, found))
    letters = tuple((c, p) for c, p in pairs if len(p) == 1 and p.isascii() and p.isalpha())
    if not letters:
        raise RuntimeError("the public confusables list can't be read: no letter has a Latin prototype")
    return letters


@lru_cache(maxsize=4)
def shape_of(more: tuple[tuple[str, str], ...] = ()) -> dict[int, str]:
    """The replacements of ``skeleton``: the fixed ones, and ``more`` letters that these don't settle."""
    shape = _tables()[0]
    return {ord(a): b for a, b in more if ord(a) not in shape} | shape


_BLANKS = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")


def skeleton(text: str, shape: dict[int, str] | None = None) -> str:
    """The prototype of a text's look; equal for texts that look alike. Blanks of any kind and number are one blank. ``shape``: a table of ``shape_of``."""
    if text.isascii():
        return _BLANKS.sub(" ", text).strip()
    shape = _tables()[0] if shape is None else shape
    once = unicodedata.normalize("NFD", text.translate(shape))
    again = unicodedata.normalize("NFD", once.translate(shape))
    return _BLANKS.sub(" ", again).strip()


def canonical(text: str) -> str:
    """The text in one readable form: composed, ordinary widths, plain hyphens and blanks, no invisible characters.

    A word is rewritten with Latin letters if each of its foreign letters has a
    Latin look-alike; a word really written in another script stays as it is.
    """
    if text.isascii():
        return text
    _, plain, letters = _tables()

    def latin(match: re.Match) -> str:
        word = match.group()
        if word.isascii():
            return word
        foreign = [c for c in word if c in letters or not unicodedata.name(c, "LATIN").startswith("LATIN")]
        if foreign and all(c in letters for c in foreign):
            return "".join(letters.get(c, c) for c in word)
        return word

    return unicodedata.normalize("NFC", _WORD.sub(latin, unicodedata.normalize("NFC", text.translate(plain))))


def canonical_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The key and each field in its canonical form, in columns of the same names.

    A null stays null, an empty text empty, a text of any length is taken whole.
    Rows sent again (same key and texts) count once; other columns are dropped.
    """
    kind = df.select(F.col(key)).dtypes[0][1]
    source = df.select(F.col(key), *(F.col(f).cast("string") for f in fields)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array([None if t is None else canonical(t) for t in batch.column(i).to_pylist()], pa.string()) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=batch.schema.names)

    return source.mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"`{f}` string" for f in fields)]))


def skeletons(df: DataFrame, key: str, field: str) -> DataFrame:
    """key, text and its skeleton, for every text that isn't null."""
    kind = df.select(F.col(key)).dtypes[0][1]
    more = prototypes(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = shape_of(more)
        for batch in batches:
            made = pa.array([skeleton(t, shape) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["key", "text", "skeleton"])

    source = df.select(F.col(key).alias("key"), F.col(field).cast("string").alias("text")).where(F.col("text").isNotNull())
    return source.mapInArrow(run, f"key {kind}, text string, skeleton string")


def groups(df: DataFrame, key: str, field: str) -> DataFrame:
    """Classes of texts of equal skeleton that are written in more than one way.

    Rows: skeleton_hash, forms (different texts), rows (keys), first_key. Keys
    are counted once. Aggregated in two steps, first by text, so a text that
    stands in a third of all rows is one row before the second shuffle.
    """
    hashed = skeletons(df, key, field).select("key", F.sha2("text", 256).alias("form"), F.sha2("skeleton", 256).alias("skeleton_hash")).distinct()
    forms = hashed.groupBy("skeleton_hash", "form").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("k"))
    whole = forms.groupBy("skeleton_hash").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("rows"), F.min("k").alias("first_key"))
    return whole.where("forms > 1")


def alike(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Keys whose two fields aren't the same string but have the same skeleton. A null field looks like nothing; each key comes once."""
    kind = df.select(F.col(key)).dtypes[0][1]
    more = prototypes(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = shape_of(more)
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            same = pa.array([skeleton(a, shape) == skeleton(b, shape) for a, b in pairs], pa.bool_())
            yield batch.select([0]).filter(same)

    a, b = F.col(left).cast("string"), F.col(right).cast("string")
    source = df.select(F.col(key), a.alias("a"), b.alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    return source.mapInArrow(run, f"`{key}` {kind}").distinct()
