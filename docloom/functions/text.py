"""Text functions as JVM expressions; Python only where Unicode normal forms are asked for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: a run of letters, digits and underscores, or one other character that isn't blank
TOKEN = WORD + r"|[^\p{L}\p{N}_\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _form(name: str):
    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(name, t))

    return normal


def nfc(text: Column | str) -> Column:
    return _form("NFC")(_c(text))


def nfkc(text: Column | str) -> Column:
    return _form("NFKC")(_c(text))


def strip(text: Column | str) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(_c(text), r"^[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+$", "")


def tidy(text: Column | str) -> Column:
    """Composed text with plain blanks: one blank in a row, none around a line end, two line ends in a row at most. Null as empty."""
    out = F.translate(nfc(F.coalesce(_c(text), F.lit(""))), " ", " ")
    for pattern, to in ((r"\r\n|\r", "\n"), (r"[ \t\f\x0B]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def tidy_plain(text: Column | str) -> Column:
    """``tidy`` without composition, wholly in the JVM."""
    out = F.translate(F.coalesce(_c(text), F.lit("")), " ", " ")
    for pattern, to in ((r"\r\n|\r", "\n"), (r"[ \t\f\x0B]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def one_blank(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def clean_v1(text: Column | str) -> Column:
    """The first cleaner: hard blanks and question marks as blanks, blanks collapsed, two line ends in a row at most."""
    out = F.translate(_c(text), " ", " ")
    for pattern, to in ((r"[?]+", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def compare_form(text: Column | str) -> Column:
    """For the comparison of recognisers: NFKC, straight quotes, one blank in a row."""
    return one_blank(F.translate(nfkc(F.coalesce(_c(text), F.lit(""))), "“”‘’", "\"\"''"))


def words(text: Column | str) -> Column:
    """Words in lower case, everything but letters, digits, underscores and apostrophes as blanks."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}_']+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit("(" + TOKEN + ")"), F.lit(1))


def token_count(text: Column | str, extra: int = 2) -> Column:
    return F.regexp_count(_c(text), F.lit(TOKEN)) + F.lit(extra)


def quality(text: Column | str) -> Column:
    """Share of characters that a clean line holds."""
    good = F.regexp_count(_c(text), F.lit(r"[A-Za-zÀ-ỹĐđ0-9]"))
    return F.when(F.length(_c(text)) > 0, good / F.length(_c(text))).otherwise(F.lit(0.0))


def compact(text: Column | str, most: int = 900) -> Column:
    """One line of at most ``most`` characters, cut at a blank, with dots where it was cut."""
    flat = one_blank(text)
    cut = F.regexp_extract(F.substring(flat, 1, most), r"^(.*) ", 1)
    cut = F.when(cut == "", F.substring(flat, 1, most)).otherwise(cut)
    return F.when(F.length(flat) > most, F.concat(F.rtrim(cut), F.lit("..."))).otherwise(flat)


def content_lines(text: Column | str, least: int = 5, noise: str = r"(?iu)CỘNG HÒA XÃ HỘI| TRƯỜNG ĐẠI HỌC") -> Column:
    """The lines that carry content: not short, no letterhead or page mark, no bare code."""
    lines = F.transform(F.split(_c(text), "\n"), lambda y: F.trim(y))
    kept = F.filter(lines, lambda x: (F.length(x) >= least) & ~x.rlike(noise) & ~x.rlike(r"^[A-Z0-9\s-]{1,12}$"))
    return F.array_join(kept, "\n")


def first_filled(*values: Column | str) -> Column:
    """The first value that isn't null or blank, blanks around it off, else empty."""
    return F.coalesce(*(F.nullif(F.trim(_c(v).cast("string")), F.lit("")) for v in values), F.lit(""))


def match_key(text: Column | str) -> Column:
    """For matching: compatibility form, no marks, d for đ, lower case."""

    @F.pandas_udf("string")
    def bare(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            flat = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", t))
            return "".join(c for c in flat if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D").lower()

        return texts.map(one)

    return bare(_c(text))


def block_type(label: Column | str) -> Column:
    """One vocabulary for the labels of layout models."""
    flat = F.regexp_replace(F.lower(F.trim(F.coalesce(_c(label), F.lit("")))), "[- ]", "_")
    # Spellings of the same type.
    same = {"plain_text": "text", "plaintext": "text", "heading": "title", "tablefootnote": "table_footnote", "figurecaption": "figure_caption", "discard": "abandon", "": "text"}
    out = flat
    for spelling, name in same.items():
        out = F.when(flat == spelling, F.lit(name)).otherwise(out)
    return out


def json_object(text: Column | str) -> Column:
    """The outermost JSON object in an answer, from the first to the last brace; null if there is none."""
    return F.nullif(F.regexp_extract(_c(text), r"(?s)\{.*\}", 0), F.lit(""))


def clean_answer(text: Column | str) -> Column:
    """An answer up to the first stop marker, without role words, evidence marks, field lines and lines that repeat an earlier one."""
    # What a model repeats of its prompt.
    out = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?ius)\n(?:CONTEXT|QUESTION|CÂU HỎI|YÊU CẦU TRẢ LỜI):.*$", "")
    for pattern, to in ((r"(?ium)^\s*(?:assistant|user|system)\s*:\s*", ""), (r"(?ium)^\s*câu trả lời(?: cuối cùng)?\s*:\s*", ""), (r"\s*\[E\d+\]\s*", " "), (r"(?ium)^\s*(?:doc_id|doc_no|chunk_index|file_url|nguồn)\s*:.*$", "")):
        out = F.regexp_replace(out, pattern, to)
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: one_blank(x)), lambda x: x != "")
    low = F.transform(lines, lambda x: F.lower(x))
    first = F.filter(F.transform(lines, lambda x, i: F.when(F.array_position(low, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
    return F.regexp_replace(F.array_join(first, "\n"), r"^[ :\-\n\t]+|[ :\-\n\t]+$", "")


def after_prompt(decoded: Column | str, prompt: Column | str) -> Column:
    """What a model wrote after the last repetition of its prompt; without one, its text less the lines of system and user."""
    whole, asked = F.trim(_c(decoded)), F.trim(_c(prompt))
    parts = F.split(F.replace(whole, asked, F.lit("\x00")), "\x00")
    answer = F.regexp_replace(F.element_at(parts, -1), r"^[\s:]+|\s+$", "")
    others = F.array_join(F.filter(F.split(whole, "\n"), lambda x: ~F.lower(F.trim(x)).rlike("^(?:system|user):")), "\n")
    return F.when((asked != "") & F.contains(whole, asked), answer).otherwise(F.when(F.trim(others) == "", whole).otherwise(F.trim(others)))


