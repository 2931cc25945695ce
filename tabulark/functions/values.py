"""Single values: coercions, defaults, labels, decoded members."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulark.operators.predicates import is_numeric_text


def _column(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item


def to_boolean(text: str | Column) -> Column:
    """Empty and ``0`` are false, all other text is true; NULL is false."""
    return F.coalesce(~_column(text).isin("", "0"), F.lit(False))


def to_integer(text: str | Column) -> Column:
    """The leading whole number of a text, else 0."""
    digits = F.regexp_extract(_column(text), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0)).cast("bigint")


def to_decimal(text: str | Column) -> Column:
    """The leading number of a text, whole unless it has a point, else 0."""
    column = _column(text)
    number = F.regexp_extract(column, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    fraction = F.coalesce(number.try_cast("double"), F.lit(0.0))
    return F.when(column.contains("."), fraction).otherwise(to_integer(column).cast("double"))


def to_date_seconds(text: str | Column) -> Column:
    """Epoch seconds of a date text; numbers are seconds already, date-only text is taken at noon.

    NULL for empty text and for text that is no date. Zone offsets are honoured.
    """
    column = _column(text)
    moment = F.unix_seconds(column.try_cast("timestamp"))
    noon = F.when(column.contains(":"), moment).otherwise(moment + 43200)
    number = F.floor(column.try_cast("double")).cast("bigint")
    is_date = column.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}")
    return F.when(is_numeric_text(column), number).when(is_date, noon)


def default_value(value: str | Column, default, strict: bool = False, kind: str = "string") -> Column:
    """The default for NULL; unless strict also for the falsy values of the type."""
    column = _column(value)
    falsy = column.isNull()
    if not strict:
        if kind == "string":
            falsy = falsy | column.isin("", "0")
        elif kind == "number":
            falsy = falsy | (column == 0)
        elif kind == "boolean":
            falsy = falsy | ~column
        elif kind == "array":
            falsy = falsy | (F.size(column) == 0)
    return F.when(falsy, F.lit(default)).otherwise(column)


def null_coalesce(*values: str | Column, default=None) -> Column:
    return F.coalesce(*[_column(v) for v in values], F.lit(default))


def yes_no(value: str | Column, true: str = "Yes", false: str = "No", negate: bool = False) -> Column:
    """A boolean as one of two texts, reversed on request."""
    flag = _column(value).cast("boolean")
    flag = F.coalesce(~flag if negate else flag, F.lit(negate))
    return F.when(flag, F.lit(true)).otherwise(F.lit(false))


def label_of(value: str | Column, labels: Mapping[str, str], raw: bool = False) -> Column:
    """The label of a machine value, or the value itself when it has none or is wanted raw."""
    column = _column(value)
    if raw:
        return column
    entries = [F.lit(item) for pair in labels.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), column), column)


def code_map(value: str | Column, codes: Mapping, otherwise: Column | None = None) -> Column:
    """A fixed value for each known code; other codes stay."""
    column = _column(value)
    mapped = F.when(F.lit(False), F.lit(None))
    for code, result in codes.items():
        mapped = mapped.when(column == F.lit(code), F.lit(result))
    return mapped.otherwise(column.cast("string") if otherwise is None else otherwise)


def decoded(text: str | Column, key: str | None = None) -> Column:
    """A JSON text re-serialised, or one member of it."""
    column = _column(text)
    return F.to_json(F.try_parse_json(column)) if key is None else F.get_json_object(column, f"$.{key}")


def member(text: str | Column, path: list[str], default: str | None = None) -> Column:
    """A nested member of a JSON text; NULL marks a missing one unless a default is given."""
    found = F.get_json_object(_column(text), "$" + "".join(f"['{p}']" for p in path))
    return found if default is None else F.coalesce(found, F.lit(default))


def shown_with_comments(at: str | Column, comments: str | Column) -> Column:
    """A timestamp, hidden while nothing has been said."""
    return F.when(_column(comments) > 0, _column(at))


def language_or_default(code: str | Column, known: list[str], site_default: str, to_site_default: bool = True) -> Column:
    """An empty language is the default (or English), an unknown one the default."""
    column = _column(code)
    empty = F.coalesce(column, F.lit("")) == ""
    return (
        F.when(empty, F.lit(site_default if to_site_default else "en"))
        .when(~column.isin(*known), F.lit(site_default))
        .otherwise(column)
    )
