"""Stable identifiers as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: the namespace of URLs in the UUID standard
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def uuid5(namespace_hex: Column | str, name: Column | str) -> Column:
    """UUID version 5 of a name; the namespace is 32 hex digits. Null if either is null."""
    digest = F.sha1(F.concat(F.unhex(_c(namespace_hex)), _c(name).cast("binary")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12)
    )


def namespace_of(document_id: Column | str) -> Column:
    """The namespace of a document: its id if that is a UUID in any spelling, else the URL UUID of the id."""
    bare = F.lower(F.regexp_replace(_c(document_id), r"(?i)urn:|uuid:|[{}-]", ""))
    made = F.regexp_replace(uuid5(F.lit(URL_NAMESPACE), document_id), "-", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare).otherwise(made)


def stable_id(document_id: Column | str, name: Column | str) -> Column:
    """UUID version 5 of a name within a document."""
    return uuid5(namespace_of(document_id), name)


def block_id(page: Column | str, index: Column | str) -> Column:
    return F.format_string("page_%03d_block_%04d", _c(page), _c(index))


def slug(prefix: str, value: Column | str) -> Column:
    """Prefix and value in lower case, anything but ASCII letters and digits as one underscore."""
    return F.concat(F.lit(prefix + "_"), F.regexp_replace(F.lower(F.trim(_c(value))), "[^a-z0-9]+", "_"))


def fingerprint(*parts: Column | str) -> Column:
    """SHA-256 of the parts, nulls counting as empty and kept apart from each other."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(_c(p).cast("string"), F.lit("\x00")) for p in parts)), 256)


def experiment_id(*parts: Column | str) -> Column:
    return F.concat_ws("__", *(_c(p).cast("string") for p in parts))
