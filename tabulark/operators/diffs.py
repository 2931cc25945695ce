"""Set operations and differences between two states of a table or catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merged(parts: Sequence[DataFrame]) -> DataFrame:
    """Lists one after the other, duplicates kept."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def distinct_union(parts: Sequence[DataFrame]) -> DataFrame:
    return merged(parts).distinct()


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of every leaf of nested structs."""
    found = []
    for field in schema.fields:
        path = f"{prefix}.{field.name}" if prefix else field.name
        if isinstance(field.dataType, T.StructType):
            found += leaves(field.dataType, path)
        else:
            found.append((path, field.dataType.simpleString()))
    return found


def _as_text(path: str, kind: str) -> Column:
    """Lists and maps as JSON, so that their items stay apart; plain values as text."""
    return F.to_json(F.col(path)) if kind.startswith(("array", "map")) else F.col(path).cast("string")


def flattened(df: DataFrame, key: str) -> DataFrame:
    """(key, path, type, value) rows of nested records; the type keeps the comparison strict."""
    entries = [
        F.struct(F.lit(path).alias("path"), F.lit(kind).alias("type"), _as_text(path, kind).alias("value"))
        for path, kind in leaves(df.schema)
        if path != key
    ]
    return df.select(key, F.explode(F.array(*entries)).alias("entry")).select(key, "entry.*")


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Leaves of the left records that are absent from, or different in, the right ones."""
    a, b = flattened(left, key).alias("a"), flattened(right, key).alias("b")
    same = F.lit(True)
    for name in (key, "path", "type", "value"):
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    return a.join(b, same, "left_anti").select(key, "path", "value")


def replacement(source: DataFrame, target: DataFrame, keys: Sequence[str], data: str) -> DataFrame:
    """What makes the target equal the source: INSERT, UPDATE, DELETE or KEEP per key."""
    new = source.select(*keys, F.struct(data).alias("_new"))
    old = target.select(*keys, F.struct(data).alias("_old"))
    action = (
        F.when(F.col("_new").isNull(), "DELETE")
        .when(F.col("_old").isNull(), "INSERT")
        .when(F.col("_new").eqNullSafe(F.col("_old")), "KEEP")
        .otherwise("UPDATE")
    )
    both = new.join(old, list(keys), "full_outer")
    return both.select(*keys, action.alias("action"), F.col(f"_new.{data}").alias(data))


def replaced(plan: DataFrame) -> DataFrame:
    """The target after the plan: everything but the deleted."""
    return plan.filter(F.col("action") != "DELETE").drop("action")


def harvested(feed: DataFrame, known: DataFrame, key: str, digest: Column) -> DataFrame:
    """Harvest status per id from record hashes: NEW, UPDATED, UNCHANGED or REMOVED.

    ``known`` has the key and the ``hash`` kept from the last run.
    """
    new = feed.select(key, digest.alias("hash"))
    old = known.select(key, F.col("hash").alias("_old"))
    status = (
        F.when(F.col("hash").isNull(), "REMOVED")
        .when(F.col("_old").isNull(), "NEW")
        .when(F.col("hash") == F.col("_old"), "UNCHANGED")
        .otherwise("UPDATED")
    )
    return new.join(old, key, "full_outer").select(key, status.alias("status"), F.coalesce("hash", "_old").alias("hash"))
