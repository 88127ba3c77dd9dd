"""Deterministic row ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # RFC 4122, name space of URLs


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def chunk_id(paper: Column, index: Column) -> Column:
    return uuid5(F.concat(paper.cast("string"), F.lit(":"), index.cast("string")))


def table_id(paper: Column, index: Column) -> Column:
    return uuid5(F.concat(paper.cast("string"), F.lit(":table:"), index.cast("string")))
