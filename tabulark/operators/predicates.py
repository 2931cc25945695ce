"""Row predicates: comparison conditions, nested groups, multi-value and access filters."""

from __future__ import annotations

import functools
import operator
import html
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARISONS: dict[str, Callable] = {
    "=": operator.eq,
    "<>": operator.ne,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}


def _column(field: str | Column) -> Column:
    return F.col(field) if isinstance(field, str) else field


def condition(field: str | Column, value=None, op: str = "=") -> Column:
    """One condition. ``= NULL`` asks for no value, ``<> NULL`` for some value."""
    column, op = _column(field), op.upper()
    if op == "IS NULL" or (value is None and op == "="):
        return column.isNull()
    if op == "IS NOT NULL" or (value is None and op in ("<>", "!=")):
        return column.isNotNull()
    if op in _COMPARISONS:
        return _COMPARISONS[op](column, value)
    if op in ("IN", "NOT IN"):
        if isinstance(value, (str, bytes)) or not isinstance(value, Sequence):
            raise TypeError(f"{op} needs a list")
        # SQL semantics: a NULL in the list makes NOT IN match nothing.
        inside = column.isin(*value)
        return inside if op == "IN" else ~inside
    if op in ("BETWEEN", "NOT BETWEEN"):
        inside = column.between(*value)
        return inside if op == "BETWEEN" else ~inside
    if op in ("LIKE", "NOT LIKE"):
        return column.like(value) if op == "LIKE" else ~column.like(value)
    if op == "CONTAINS":
        return column.contains(value)
    if op == "STARTS_WITH":
        return column.startswith(value)
    raise ValueError(f"unknown operator {op}")


def group(conjunction: str, conditions: Sequence[Column]) -> Column:
    """AND or OR over conditions; groups nest because the result is a condition."""
    if conjunction not in ("AND", "OR"):
        raise ValueError("a condition group is AND or OR")
    if not conditions:
        return F.lit(True)
    return functools.reduce(operator.and_ if conjunction == "AND" else operator.or_, conditions)


def from_tree(tree: Mapping) -> Column:
    """A condition from nested dicts: ``{field, value, op}`` or ``{group, conditions}``."""
    if "conditions" in tree:
        return group(tree.get("group", "AND"), [from_tree(t) for t in tree["conditions"]])
    return condition(tree["field"], tree.get("value"), tree.get("op", "="))


def always_false() -> Column:
    return F.lit(False)


def contains_text(field: str | Column, text: str, case_sensitive: bool = True) -> Column:
    column = _column(field)
    return column.contains(text) if case_sensitive else F.lower(column).contains(text.lower())


def text_range(field: str | Column, low: str = "", high: str = "", negate: bool = False) -> Column:
    """A range with optional bounds; without any bound everything passes."""
    column = _column(field)
    if low != "" and high != "":
        return ~column.between(low, high) if negate else column.between(low, high)
    if low != "":
        return column < low if negate else column >= low
    if high != "":
        return column > high if negate else column <= high
    return F.lit(True)


def text_flag(field: str | Column, wanted: bool, accept_null: bool = False) -> Column:
    """A boolean kept as text: empty is false; NULL may count as false too."""
    column = _column(field)
    if wanted:
        return column != ""
    return (column == "") | column.isNull() if accept_null else column == ""


def is_current(field: str | Column, current, wanted: bool = True, accept_null: bool = False) -> Column:
    """Equal, or not equal, to a value taken from the request context."""
    column = _column(field)
    if wanted:
        return column == current
    return (column != current) | column.isNull() if accept_null else column != current


def optional_equals(df: DataFrame, field: str, value) -> DataFrame:
    """Filter by equality; an empty value is no filter at all."""
    return df if value == "" else df.filter(condition(field, value))


def published_or_own(status: Column, owner: Column, user: int, may_view_own: bool, bypass: bool) -> Column:
    own = (owner == user) & F.lit(user != 0 and may_view_own)
    return (status == 1) | own | F.lit(bypass)


def granted(items: DataFrame, grants: DataFrame, item_id: str, pairs: Sequence[tuple[int, str]], bypass: bool) -> DataFrame:
    """Items some view grant opens to one of the account's (gid, realm) pairs."""
    if bypass:
        return items
    held = group("OR", [(F.col("gid") == gid) & (F.col("realm") == realm) for gid, realm in pairs])
    open_ids = grants.filter(held & (F.col("grant_view") >= 1)).select(item_id).distinct()
    return items.join(open_ids, item_id, "left_semi")


def in_languages(df: DataFrame, field: str, wanted: Sequence[str], site_languages: Sequence[str]) -> DataFrame:
    """Language filter; a site with one language has nothing to filter."""
    return df if len(site_languages) < 2 else df.filter(F.col(field).isin(*wanted))


def checked(values: Mapping[str, object] | Sequence) -> list:
    """Values of a checkbox form: unchecked ones arrive as zero and are dropped."""
    if isinstance(values, Mapping):
        return [key for key, mark in values.items() if mark not in (0, "0", "", None, False)]
    return list(values)


def multi_value(df: DataFrame, item: str, field: str, values, op: str) -> DataFrame:
    """Items by a multi-valued field: ``and`` all values, ``or`` any of them, ``not`` none.

    ``df`` has one row per (item, value). Flags are combined before the shuffle, so
    no item's values are ever listed in one place.
    """
    wanted = checked(values)
    items = df.groupBy(item)
    if not wanted:
        return items.agg(F.lit(True).alias("_any")).select(item)
    flags = [F.bool_or(F.col(field).eqNullSafe(F.lit(v))).alias(f"_has{i}") for i, v in enumerate(wanted)]
    has = [F.col(f"_has{i}") for i in range(len(wanted))]
    keep = {
        "and": group("AND", has),
        "or": group("OR", has),
        "not": ~group("OR", has),
    }[op]
    return items.agg(*flags).filter(keep).select(item)


def words(text: str | Column) -> Column:
    """Lower-case words of a text."""
    return F.regexp_extract_all(F.lower(_column(text)), F.lit(r"[\p{L}\p{N}]+"), 0)


def words_of(key: str) -> list[str]:
    """A search key cut as texts are: lower-case words, entities decoded. Several words are a phrase."""
    return re.findall(r"[^\W_]+", html.unescape(key).lower())


def phrase(field: str | Column, text: str) -> Column:
    """The text's words one after the other as whole words, without regard to case.

    A text without a word is found nowhere.
    """
    parts = re.findall(r"[^\W_]+", text.lower())
    if not parts:
        return F.lit(False)
    pattern = r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(parts) + r"(?![\p{L}\p{N}])"
    lowered = F.lower(_column(field))
    # Looking for the longest word is cheaper than the pattern, and settles most texts.
    return lowered.contains(max(parts, key=len)) & lowered.rlike(pattern)


def full_text(field: str | Column, op: str, term: str | None = None) -> Column:
    """Full-text fields know four operators: contains, does not contain, empty, not empty."""
    if op in ("=", "!="):
        return phrase(field, term) if op == "=" else ~phrase(field, term)
    blank = F.coalesce(F.trim(_column(field)), F.lit("")) == ""
    return {"empty": blank, "not empty": ~blank}[op]


def exclude_items(items: DataFrame, status: DataFrame, key: str, hidden: Column, published: Column) -> DataFrame:
    """Drop hidden items and keep only published ones, by a status table."""
    gone = status.filter(hidden).select(key).distinct()
    live = status.filter(published).select(key).distinct()
    return items.join(live, key, "left_semi").join(gone, key, "left_anti")


def slider_bounds(item: str) -> tuple[float, float] | None:
    """Bounds of an active slider item such as ``(min:10,max:20)``."""
    found = re.search(r"\(min:(-?[\d.]+),max:(-?[\d.]+)\)", item, re.IGNORECASE)
    return (float(found[1]), float(found[2])) if found else None


def facet_ranges(field: str, active: Sequence[tuple[float, float]], conjunction: str = "OR", exclude: bool = False) -> Column:
    """One (NOT) BETWEEN per active range, joined by the facet's operator."""
    op = "NOT BETWEEN" if exclude else "BETWEEN"
    return group(conjunction, [condition(field, bounds, op) for bounds in active])


def is_numeric_text(field: str | Column) -> Column:
    """Decimal numbers with optional sign, point, exponent and surrounding blanks."""
    return _column(field).rlike(r"^[ \t\n\r\x0B\f]*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?[ \t\n\r\x0B\f]*$")


def by_formula(df: DataFrame, formula: str, argument, table_alias: str = "t") -> DataFrame:
    """Rows where an SQL formula equals the argument; ``***table***`` stands for the table."""
    return df.alias(table_alias).filter(F.expr(formula.replace("***table***", table_alias)) == F.lit(argument))
