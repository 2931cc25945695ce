"""Orderings, pages and row counters.

A position over a whole table comes from ``scale.numbered`` (a range sort on all
executors). Only pages of bounded length use ``limit``, which Spark runs as
a top-k without a full sort.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.scale import numbered

# Patterns of the date buckets rows can be sorted by.
GRANULARITIES = {
    "minute": "yyyyMMddHHmm",
    "hour": "yyyyMMddHH",
    "day": "yyyyMMdd",
    "month": "yyyyMM",
    "year": "yyyy",
}


def direction(field: str | Column, way: str = "asc") -> Column:
    column = F.col(field) if isinstance(field, str) else field
    return column.desc() if way.lower() == "desc" else column.asc()


def by_header(df: DataFrame, header: str, way: str) -> Column:
    """The sort a clicked table header asks for; only known columns and ASC or DESC get through."""
    name = re.sub(r"[^A-Za-z0-9_.]", "", header)
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return direction(name, "desc" if way.lower() == "desc" else "asc")


def date_bucket(field: str, granularity: str = "second") -> Column:
    """Sort key by granularity; seconds sort by the raw value."""
    if granularity == "second":
        return F.col(field)
    return F.date_format(field, GRANULARITIES[granularity])


def thread_key(thread: str, way: str = "asc") -> Column:
    """Threads end in a slash; ascending order leaves it out so that parents come first."""
    if way.lower() == "desc":
        return F.col(thread).desc()
    return F.substring(F.col(thread), F.lit(1), F.length(thread) - 1).asc()


def shuffled(key: str, seed: int) -> Column:
    """A repeatable random order of rows by their key."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def natural_key(field: str) -> Column:
    """Text key that compares runs of digits as numbers, of any length, and letters without case."""
    chunks = F.regexp_extract_all(F.lower(field), F.lit(r"\d+|\D+"), 0)

    def comparable(chunk: Column) -> Column:
        # A longer number is a larger one, so its length comes first.
        digits = F.regexp_replace(chunk, r"^0++(?=\d)", "")
        return F.when(chunk.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(chunk)

    return F.array_join(F.transform(chunks, comparable), "")


def key_value_sorts(sorts: Sequence[tuple[str, str]]) -> list[Column]:
    """Sorts applied one after the other: the last one ends up the primary."""
    return [direction(field, way) for field, way in reversed(sorts)]


def by_relevance(df: DataFrame, way: str = "desc") -> list[Column]:
    """Sort on the score, where a search supplied one; else no sort."""
    return [direction("score", way)] if "score" in df.columns else []


def exposed_sorts(earlier: Sequence[Column], field: str, way: str, exposed: bool) -> list[Column]:
    """A sort the visitor chose takes the place of the earlier ones; a configured one follows them."""
    return [direction(field, way)] if exposed else [*earlier, direction(field, way)]


def capped(limit: int | None, default: int, maximum: int) -> int:
    return min(default if limit is None else max(limit, 0), maximum)


def page(df: DataFrame, sorts: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order."""
    ordered = df.orderBy(*sorts)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def all_after(df: DataFrame, sorts: Sequence[Column], offset: int, name: str = "position") -> DataFrame:
    """Every row past an offset, numbered from 1 there. No task holds the whole result."""
    rows = numbered(df, *sorts, name=name)
    return rows.filter(F.col(name) > offset).withColumn(name, F.col(name) - offset) if offset else rows


def counter(
    df: DataFrame, sorts: Sequence[Column], name: str, start: int = 1, size: int | None = None, number: int = 0, offset: int = 0
) -> DataFrame:
    """Row counter of a pager: it goes on over pages of ``size`` rows, after ``offset`` skipped rows."""
    base = start - 1
    if size is None:
        return numbered(df, *sorts, name=name, start=base + 1)
    first = size * number + offset
    return numbered(page(df, sorts, size, first), *sorts, name=name, start=base + first + 1)
