"""Record hashes and name-based identifiers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the DNS namespace of name-based UUIDs.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def _sorted_value(column: Column, kind: T.DataType) -> Column:
    """The value with its struct fields and map keys in name order, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        inner = F.struct(*[_sorted_value(column[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(column.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda item: _sorted_value(item, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(column)))
    return column


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON that does not depend on the order of its keys."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(
        F.struct(*[_sorted_value(F.col(f.name), f.dataType).alias(f.name) for f in fields]),
        {"ignoreNullFields": "false"},
    )


def record_hash(df: DataFrame) -> Column:
    return F.sha2(canonical_json(df), 256)


def json_hash(text: str | Column) -> Column:
    """Hash of a JSON text, whatever its key order (variants keep their keys sorted)."""
    return F.sha2(F.to_json(F.parse_json(F.col(text) if isinstance(text, str) else text)), 256)


def url_safe_hash(text: str | Column) -> Column:
    """Base64 SHA-256 with URL-safe characters and no padding."""
    return F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/=", "-_")


def url_safe_hmac(text: str | Column, key: str) -> Column:
    """Base64 HMAC-SHA-256 under a literal key, with URL-safe characters and no padding."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in secret).hex())) for pad in (0x36, 0x5C))
    data = (F.col(text) if isinstance(text, str) else text).cast("binary")
    digest = F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data), 256))), 256))
    return F.translate(F.base64(digest), "+/=", "-_")


def uuid5(schema: str, value: str | Column) -> Column:
    """The version 5 UUID of ``schema:value`` in the DNS namespace."""
    value = F.col(value) if isinstance(value, str) else value
    name = F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(F.concat(F.lit(schema + ":"), value), "UTF-8"))
    digest = F.sha1(name)
    # Version 5, then the variant: two fixed bits over the lower two.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
