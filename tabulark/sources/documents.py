"""JSON catalogs: read dataset entries, guard the extract, write JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _entries(spark: SparkSession, path: str, item_schema: str, whole_files: bool) -> DataFrame:
    pages = spark.read.schema(f"page bigint, dataset array<struct<{item_schema}>>").json(path, multiLine=whole_files)
    listed = F.coalesce("dataset", F.raise_error(F.lit("a catalog document has no dataset list")))
    return pages.select("page", F.posexplode(listed).alias("place", "item"))


def last_segment(identifier: Column) -> Column:
    """An identifier that is a URL counts by its last path segment; others stay."""
    return F.regexp_replace(identifier.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^?#]*/)?([^/?#]+)/*(?:[?#].*)?$", "$1")


def read_catalog(
    spark: SparkSession, path: str, item_schema: str, id_column: str = "identifier", whole_files: bool = False
) -> DataFrame:
    """Dataset entries of catalog documents, the last entry winning for each identifier.

    Each document is ``{"page": n, "dataset": [...]}``, one per line so that files
    split, or with ``whole_files`` one per file in any layout; order is page, then place in the array.
    Identifiers that are URLs count by their last segment. A document without a dataset list is an error;
    entries without an identifier are left to ``entries_without_id``.
    """
    entries = _entries(spark, path, item_schema, whole_files)
    return (
        entries.groupBy(last_segment(F.col(f"item.{id_column}")).alias("_id"))
        .agg(F.max_by("item", F.struct("page", "place")).alias("item"))
        .filter("_id is not null")
        .select("item.*")
    )


def entries_without_id(
    spark: SparkSession, path: str, item_schema: str, id_column: str = "identifier", whole_files: bool = False
) -> DataFrame:
    """The entries that ``read_catalog`` refuses, with their page and place."""
    entries = _entries(spark, path, item_schema, whole_files)
    return entries.filter(F.col(f"item.{id_column}").isNull()).select("page", "place", "item.*")


def guard_items(items: DataFrame, column: str) -> DataFrame:
    """Fail when there are no items or the first is not a JSON object; else pass them on."""
    first = items.limit(1).select(F.schema_of_variant(F.try_parse_json(column)).alias("shape")).collect()
    if not first:
        raise ValueError("no items were extracted")
    if not (first[0]["shape"] or "").startswith("OBJECT"):
        raise ValueError("the extracted items are not objects")
    return items


def json_lines(df: DataFrame, path: str) -> None:
    """Write one JSON object per row, NULL members kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
