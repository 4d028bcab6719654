"""Content digests: canonical JSON, sha-256 and the short base-36 element id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(c: Column) -> Column:
    """A string as a JSON literal, `null` for null."""
    quoted = F.regexp_replace(F.to_json(F.array(c), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", "$1")
    return F.coalesce(quoted, F.lit("null"))


def canonical_json(**fields: Column) -> Column:
    """Object with its keys in sorted order and no spaces. Values are already JSON text."""
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "") + f'"{key}":'), F.coalesce(fields[key], F.lit("null"))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def djb2_base36(c: Column) -> Column:
    """djb2 over UTF-16 code units, modulo 2^32, in base 36."""
    units = F.encode(c, "UTF-16BE")
    n = (F.length(units) / 2).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    hexed = F.hex(units)
    code = lambda i: F.conv(F.substring(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    h = F.aggregate(
        steps, F.lit(5381).cast("long"), lambda acc, i: (acc * 33 + code(i)) % F.lit(4294967296)
    )
    return F.lower(F.conv(h.cast("string"), 10, 36))
