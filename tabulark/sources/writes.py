"""Table writes as DataFrames: each returns the new content, to be written to a new path.

Plain files have no row-level update, so a change is the old rows transformed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.scale import salted_join


def insert_rows(target: DataFrame, rows: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Append rows; columns they lack take the default, else NULL."""
    for name, value in (defaults or {}).items():
        given = F.col(name) if name in rows.columns else F.lit(None)
        rows = rows.withColumn(name, F.coalesce(given, F.lit(value)))
    types = dict(target.dtypes)
    rows = rows.select(*[F.col(c).cast(types[c]) for c in rows.columns])
    return target.unionByName(rows, allowMissingColumns=True)


def one_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key: the largest in the order of the columns."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*rows.columns)).alias("_row")).select("_row.*")


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Insert by a unique key; on conflict every supplied column takes the new value, NULL included.

    Of several new rows with one key the largest in the order of their columns counts.
    """
    rows = one_per_key(rows, [key])
    old, new = target.alias("old"), rows.withColumn("_new", F.lit(True)).alias("new")
    both = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    columns = [F.coalesce(f"new.{key}", f"old.{key}").alias(key)]
    for name in target.columns:
        if name == key:
            continue
        if name in rows.columns:
            columns.append(F.when(F.col("new._new"), F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name))
        else:
            columns.append(F.col(f"old.{name}").alias(name))
    return both.select(*columns)


def merge_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert only the rows whose key is not there yet, and of several with one key the largest in column order."""
    rows = one_per_key(rows, keys)
    return target.unionByName(rows.join(target.select(*keys), list(keys), "left_anti"))


def update_where(target: DataFrame, values: Mapping[str, Column], condition: Column) -> DataFrame:
    """Set columns where the condition holds; a NULL condition leaves the row as it is."""
    return target.select(
        *[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns]
    )


def affected(target: DataFrame, condition: Column) -> DataFrame:
    """How many rows an update or delete with this condition touches."""
    return target.agg(F.count(F.when(condition, 1)).alias("affected"))


def delete_where(target: DataFrame, condition: Column | None = None) -> DataFrame:
    """Rows that stay: those where the condition is false or NULL; none without a condition."""
    if condition is None:
        return truncate(target)
    return target.filter(~F.coalesce(condition, F.lit(False)))


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


def purge_prior(
    versions: DataFrame,
    id_column: str,
    version: Sequence[str],
    purged_ids: DataFrame,
) -> DataFrame:
    """Keep only the newest version of the purged resources, all versions of the others.

    The newest comes from a partial aggregate, so a resource with very many versions
    is reduced before the shuffle.
    """
    ids = purged_ids.select(id_column)
    others = salted_join(versions, ids, [id_column], "left_anti")
    purged = salted_join(versions, ids, [id_column], "left_semi")
    newest = (
        purged.groupBy(id_column)
        .agg(F.max_by(F.struct(*versions.columns), F.struct(*version)).alias("_row"))
        .select("_row.*")
    )
    return others.unionByName(newest)
