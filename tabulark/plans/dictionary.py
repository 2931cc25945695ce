"""Data dictionaries: typed columns from text, with titles as comments and failed casts reported."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strptime directives and the datetime patterns they stand for.
DIRECTIVES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%e": "d",
    "%b": "MMM",
    "%B": "MMMM",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%p": "a",
}

TYPES = {"string": "string", "integer": "bigint", "boolean": "boolean", "date": "date", "datetime": "timestamp", "year": "int"}


def pattern(directives: str) -> str:
    """A datetime pattern from a strptime-style format, other letters quoted."""

    def one(found: re.Match) -> str:
        piece = found[0]
        return DIRECTIVES[piece] if piece in DIRECTIVES else f"'{piece}'"

    return re.sub(r"%[A-Za-z]|[A-Za-z]+", one, directives)


def cast(field: Mapping) -> Column:
    """The column of one dictionary field; text that does not fit becomes NULL."""
    column, kind = F.col(field["name"]), field["type"]
    if kind in ("date", "datetime") and field.get("format", "default") not in ("default", "any"):
        moment = F.try_to_timestamp(column, F.lit(pattern(field["format"])))
        return moment.cast("date") if kind == "date" else moment
    if kind == "number":
        return column.try_cast(f"decimal({field.get('precision', 38)},{field.get('scale', 18)})")
    return column.try_cast(TYPES[kind])


def apply(df: DataFrame, fields: Sequence[Mapping], report: str = "_rejected") -> DataFrame:
    """Cast columns by name match. ``report`` lists the fields whose text did not fit."""
    named = {f["name"]: f for f in fields}
    columns, failures = [], []
    for name in df.columns:
        if name not in named:
            columns.append(F.col(name))
            continue
        typed = cast(named[name])
        title = named[name].get("title")
        columns.append(typed.alias(name, metadata={"comment": title}) if title else typed.alias(name))
        given = F.coalesce(F.trim(F.col(name)), F.lit("")) != ""
        failures.append(F.when(given & typed.isNull(), F.lit(name)))
    return df.select(*columns, F.array_compact(F.array(*failures)).alias(report))
