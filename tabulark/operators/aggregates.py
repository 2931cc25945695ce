"""Grouped results: counts, sums, conditions on aggregates, counters and glossaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.operators.predicates import condition, group

_FUNCTIONS = {
    "count": F.count,
    "count_distinct": F.count_distinct,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
}


def grouped(df: DataFrame, keys: Sequence[str], **aggregates: tuple[str, str]) -> DataFrame:
    """Aggregates by name: ``n=("count", "id")``."""
    return df.groupBy(*keys).agg(*[_FUNCTIONS[f](c).alias(n) for n, (f, c) in aggregates.items()])


def having(
    df: DataFrame,
    keys: Sequence[str],
    conditions: Sequence[tuple],
    conjunction: str = "AND",
) -> DataFrame:
    """Groups by conditions on their aggregates, each ``(field, function, value, op)``.

    ``exists`` and ``notExists`` ask whether the aggregate has a value. The aggregates
    are kept as ``<function>_<field>``.
    """
    names = {(field, function): f"{function}_{field}" for field, function, *_ in conditions}
    result = df.groupBy(*keys).agg(*[_FUNCTIONS[function](field).alias(n) for (field, function), n in names.items()])
    tests = []
    for field, function, value, *given in conditions:
        op = given[0] if given else "="
        column = F.col(names[field, function])
        if op == "exists":
            tests.append(column.isNotNull())
        elif op == "notExists":
            tests.append(column.isNull())
        else:
            tests.append(condition(column, value, op))
    return result.filter(group(conjunction, tests))


def outside(field: str | Column, low, high) -> Column:
    """Strictly outside both bounds."""
    column = F.col(field) if isinstance(field, str) else field
    return (column < low) | (column > high)


def value_counts(df: DataFrame, values: str, count_of: str, name: str) -> DataFrame:
    """Counts per value of a multi-valued field; an item without values counts under NULL."""
    each = df.select(F.col(count_of), F.explode_outer(values).alias(name))
    return each.groupBy(name).agg(F.count(count_of).alias("n"))


def space_used(df: DataFrame, size: str, **equal: object) -> DataFrame:
    """Sum of sizes, NULL when nothing matches."""
    for field, value in equal.items():
        df = df.filter(condition(field, value))
    return df.agg(F.sum(size).alias("space"))


def glossary(df: DataFrame, field: str, letters: int = 1, per_page: int = 25, page: int = 0) -> DataFrame:
    """Counts per leading letters, one page of them in order."""
    counts = df.groupBy(F.substring(field, 1, letters).alias("glossary")).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy("glossary")
    return (ordered.offset(page * per_page) if page else ordered).limit(per_page)


def run_counters(load: DataFrame, transform: DataFrame, run: str | None = None) -> DataFrame:
    """Harvest counters: created, updated, failed (load and transform) and processed ids.

    Both inputs have (id, status), the transform one a row per transformer and id.
    """
    stages = load.withColumn("stage", F.lit("load")).unionByName(transform.withColumn("stage", F.lit("transform")))
    loaded = F.col("stage") == "load"
    return stages.agg(
        F.count_if(loaded & (F.col("status") == "NEW")).alias("created"),
        F.count_if(loaded & (F.col("status") == "UPDATED")).alias("updated"),
        F.count_if(F.col("status") == "FAILURE").alias("failed"),
        F.count_distinct("id").alias("processed"),
    )


def view_counters(views: DataFrame, item: str, at: str, today: Column) -> DataFrame:
    """Per item: all views, views of the day, last view."""
    return views.groupBy(item).agg(
        F.count(F.lit(1)).alias("totalcount"), F.count_if(today).alias("daycount"), F.max(at).alias("timestamp")
    )


def top_items(counters: DataFrame, item: str, order: str, limit: int = 5) -> DataFrame:
    """The first items by a counter; a top-k, not a sort."""
    if order not in ("totalcount", "daycount", "timestamp"):
        raise ValueError(f"cannot order by {order}")
    return counters.orderBy(F.col(order).desc(), F.col(item)).limit(limit).select(item, F.lit(order).alias("order"))


def latest_or_published(items: DataFrame, latest: DataFrame, published: DataFrame, key: str, value: str) -> DataFrame:
    """The value of the latest revision where there is one, else of the published one."""
    newest = latest.select(key, F.col(value).alias("_latest"))
    public = published.select(key, F.col(value).alias("_published"))
    both = items.join(newest, key, "left").join(public, key, "left")
    return both.withColumn(value, F.coalesce("_latest", "_published")).drop("_latest", "_published")


def smallest(columns: Sequence[str | Column]) -> Column:
    """Least of the values; NULLs are skipped."""
    return F.least(*columns)


def greatest(*columns: str | Column) -> Column:
    """Greatest of the values; NULLs are skipped."""
    return F.greatest(*columns)

