"""Skew-proof building blocks: numbering, folding and joining without a hot task.

Any key may hold a third of all rows, so nothing here puts an unbounded key group into
one task. A fixed-size sketch finds out whether the groups are small; if that cannot be
shown, sorting is by range on a total order, which splits a hot key over many partitions, and
what crosses a partition border is carried over in a table of at most one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulark.scratch import cut

# monotonically_increasing_id: partition number above, row number below this bit.
_ROW_BITS = 33

# Keys a sketch keeps, the largest group one task sorts, and the smallest key worth salting.
TRACKED = 10_000
GROUP_LIMIT = 1_000_000
HOT_ROWS = 100_000


def _column(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item


def _sorted_slots(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """Sorted rows with ``_part`` (partition) and ``_slot`` (place, rising with the sort), written once."""
    placed = df.orderBy(*order_by).withColumn("_slot", F.monotonically_increasing_id())
    return cut(placed, "sorted").withColumn("_part", F.shiftright("_slot", _ROW_BITS))


def _sketch(df: DataFrame, keys: Sequence[str | Column], most: int) -> tuple[list[tuple[int, int]], int]:
    """(key hash, estimated rows) of the largest groups, and the number of rows: one pass, fixed memory."""
    hashed = df.select(F.xxhash64(*[_column(k) for k in keys]).alias("h"))
    found = hashed.agg(
        F.expr(f"approx_top_k(h, {most}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    return [(entry["item"], entry["count"]) for entry in found["top"] or []], found["n"]


def groups_fit(df: DataFrame, keys: Sequence[str | Column], limit: int = GROUP_LIMIT) -> bool:
    """Whether every key group is shown to have at most ``limit`` rows.

    The sketch never underestimates a tracked key, and an untracked one has at most its error.
    """
    top, rows = _sketch(df, keys, 1)
    error = 3.5 * rows / TRACKED
    return rows <= limit or (error <= limit and all(count <= limit for _, count in top))


def numbered(df: DataFrame, *order_by: str | Column, name: str = "position", start: int = 1) -> DataFrame:
    """Number all rows by a total order, in parallel.

    A range sort, then the row's place in its partition plus the sizes of the
    partitions before. The size table has one row per partition.
    """
    slots = _sorted_slots(df, order_by)
    sizes = slots.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        slots.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_before") + place + F.lit(start))
        .select(*df.columns, name)
    )


def numbered_within(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str | Column],
    name: str = "position",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Number rows inside each key group by a total order, splitting large groups.

    Groups that are shown to be small take a plain window. Else the local number counts inside (partition, key), so no task sees more than one
    sort partition; ``carried`` adds the rows of the same key in earlier partitions.
    Only the first key of a partition can be carried, hence its broadcast.
    """
    if groups_fit(df, keys, limit):
        whole = Window.partitionBy(*keys).orderBy(*order_by)
        return df.withColumn(name, F.row_number().over(whole).cast("bigint"))
    slots = _sorted_slots(df, [*keys, *order_by])
    pieces = slots.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.withColumn("_carried", F.sum("_rows").over(earlier)).filter(F.col("_carried").isNotNull())
    carried = carried.select("_part", "_carried", *[F.col(k).alias(f"_k_{k}") for k in keys])
    local = Window.partitionBy("_part", *keys).orderBy("_slot")
    rows = slots.withColumn("_local", F.row_number().over(local)).withColumnRenamed("_part", "_home")
    same = F.col("_home") == F.col("_part")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return (
        rows.join(F.broadcast(carried), same, "left")
        .withColumn(name, F.col("_local") + F.coalesce("_carried", F.lit(0)))
        .select(*df.columns, name)
    )


def folded(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str | Column],
    item: Column,
    name: str,
    size: int = 1000,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Fold child rows into ordered arrays of at most ``size`` items, numbered by ``chunk``.

    A usual parent has the one chunk 0; a hot parent has many, and no row or task
    ever holds all of its children.
    """
    placed = numbered_within(df, keys, order_by, name="_place", limit=limit)
    chunk = F.floor((F.col("_place") - 1) / F.lit(size)).cast("int").alias("chunk")
    return (
        placed.groupBy(*keys, chunk)
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_place"), item.alias("_item")))).alias("_items"))
        .withColumn(name, F.transform("_items", lambda entry: entry["_item"]))
        .drop("_items")
    )


def hot_keys(df: DataFrame, keys: Sequence[str | Column], share: float = 0.02, min_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the keys that hold at least ``share`` of the rows (at most 1/share values).

    The estimate only decides which keys get salted, never which rows are kept.
    """
    top, rows = _sketch(df, keys, int(1 / share))
    return [item for item, count in top if count >= max(share * rows, min_rows)]


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salts: int = 32,
    share: float = 0.02,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join many ``rows`` per key to ``lookup`` with hot keys spread over ``salts`` tasks.

    Works for inner, left, left_semi and left_anti: each row meets the whole
    lookup side of its key. Without a hot key this is a plain join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    hot = hot_keys(rows, keys, share, min_rows)
    if not hot:
        return rows.join(lookup, list(keys), how)
    is_hot = F.xxhash64(*[F.col(k) for k in keys]).isin(hot)
    hashable = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    salt = F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int")
    salted = rows.withColumn("_salt", F.when(is_hot, salt).otherwise(F.lit(0)))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    copies = lookup.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def is_small(df: DataFrame, max_rows: int = 10_000, max_bytes: int = 8 << 20) -> bool:
    """Whether the rows are few and, written out, short; looks at no more than ``max_rows`` of them."""
    written = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(written).alias("bytes")).first()
    return seen["rows"] <= max_rows and (seen["bytes"] or 0) <= max_bytes


def small_or_plain(df: DataFrame) -> DataFrame:
    """Hint a broadcast only when the data is measured and small; else leave the choice to Spark."""
    return F.broadcast(df) if is_small(df) else df


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner", max_rows: int = 10_000
) -> DataFrame:
    """Join to a lookup that is cheap to read: broadcast if measured small, else with hot keys salted."""
    if is_small(lookup, max_rows):
        return rows.join(F.broadcast(lookup), list(keys), how)
    return salted_join(rows, lookup, keys, how)
