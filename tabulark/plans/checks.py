"""Data checks: schema validation, required fields, value ranges. Rows are split, never dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the limit of a stored timestamp in seconds, either way.
TIMESTAMP_LIMIT = 2147483648


def validated(df: DataFrame, text: str, schema: str, required: Sequence[str] = (), into: str = "record") -> DataFrame:
    """Parse JSON records by a schema. ``valid`` is false for broken text, wrong types and missing members."""
    corrupt = "_corrupt"
    parsed = F.from_json(text, f"{schema}, {corrupt} string", {"columnNameOfCorruptRecord": corrupt})
    rows = df.withColumn(into, parsed)
    valid = F.col(into).isNotNull() & F.col(f"{into}.{corrupt}").isNull()
    for name in required:
        valid = valid & F.col(f"{into}.{name}").isNotNull()
    return rows.withColumn("valid", valid).withColumn(into, F.col(into).dropFields(corrupt))


def split(df: DataFrame, passed: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that do not; an unknown outcome does not pass."""
    known = F.coalesce(passed, F.lit(False))
    return df.filter(known), df.filter(~known)


def missing_member(text: str, member: str) -> Column:
    """Whether a JSON item lacks a member."""
    return F.get_json_object(text, f"$.{member}").isNull()


def in_range(field: str | Column, limit: int = TIMESTAMP_LIMIT) -> Column:
    column = F.col(field) if isinstance(field, str) else field
    return column.between(-limit, limit)


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """How many rows break each rule (a rule holds the rows that pass), in one pass."""
    counted = df.agg(
        *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    )
    return counted.unpivot([], list(rules), "rule", "violations")
