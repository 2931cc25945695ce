"""Declarative datastore queries: a dict in, a DataFrame out.

The keys mirror what a catalog API takes: ``resource``, ``alias``, ``joins``, ``relations``, ``fields``,
``conditions``, ``group_by``, ``aggregates``, ``having``, ``sorts``, ``limit``,
``offset``. Catalyst plans the result; nothing is decided here but the shape.

Every table goes by its alias, or else by its resource name, so ``alias.column`` names a column where tables share its name
or one table is joined twice. ``joins`` are always made. ``relations`` (alias: join) are made when the query
names the alias, together with the relations their own conditions name, each once and in the order they need each other.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.operators.predicates import from_tree
from tabulark.operators.sorts import capped, direction

DEFAULT_LIMIT = 500
MAX_LIMIT = 20_000

Rule = Callable[[DataFrame], DataFrame]


def matching(tables: Mapping[str, DataFrame], query: Mapping) -> DataFrame:
    """All rows of a query, unordered."""
    df = tables[query["resource"]].alias(query.get("alias", query["resource"]))
    for join in joins_of(query):
        df = df.join(tables[join["resource"]].alias(alias_of(join)), F.expr(join["on"]), join.get("how", "inner"))
    if "conditions" in query:
        df = df.filter(from_tree(query["conditions"]))
    if "aggregates" in query:
        aggregates = [F.expr(text).alias(name) for name, text in query["aggregates"].items()]
        df = df.groupBy(*query.get("group_by", [])).agg(*aggregates)
        if "having" in query:
            df = df.filter(from_tree(query["having"]))
    elif "fields" in query:
        df = df.select(*[F.expr(text).alias(name) for name, text in query["fields"].items()])
    return df


def count(tables: Mapping[str, DataFrame], query: Mapping) -> DataFrame:
    """The number of rows behind all pages of a query."""
    return matching(tables, query).agg(F.count(F.lit(1)).alias("count"))


def granted(limit: int | None, default: int = DEFAULT_LIMIT, maximum: int = MAX_LIMIT, strict: bool = False) -> int:
    """The number of rows a request gets; one beyond the maximum is refused if ``strict``, else cut with a warning."""
    given = capped(limit, default, maximum)
    if limit is not None and limit > maximum:
        said = f"{limit} rows asked, {maximum} is the maximum"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=3)
    return given


def run(
    tables: Mapping[str, DataFrame],
    query: Mapping,
    maximum: int = MAX_LIMIT,
    rows_limit: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """The rows of one query, limited unless ``all_rows`` is set.

    ``rows_limit`` is the one setting for both the default and the maximum. A request beyond the maximum is refused
    if ``strict``, else cut with a warning.
    """
    default = DEFAULT_LIMIT if rows_limit is None else rows_limit
    maximum = maximum if rows_limit is None else rows_limit
    limit = None if query.get("all_rows") else granted(query.get("limit"), default, maximum, strict)
    df = matching(tables, query)
    if query.get("sorts"):
        df = df.orderBy(*[direction(field, way) for field, way in query["sorts"]])
    if limit is None:
        return df
    if query.get("offset"):
        df = df.offset(query["offset"])
    return df.limit(limit)


def alias_of(join: Mapping) -> str:
    return join.get("alias", join["resource"])


def _texts(part) -> list[str]:
    """Every text of a nested query part that may name a column."""
    if isinstance(part, str):
        return [part]
    if isinstance(part, Mapping):
        return [text for name, value in part.items() if name != "value" for text in _texts(value)]
    if isinstance(part, Sequence):
        return [text for value in part for text in _texts(value)]
    return []


def _named(texts: Sequence[str], aliases: Sequence[str]) -> list[str]:
    """The aliases that stand before a dot outside quoted text."""
    found = {name for text in texts for name in re.findall(r"`?(\w+)`?\s*\.", re.sub(r"'[^']*'", "''", text))}
    return [alias for alias in aliases if alias in found]


def joins_of(query: Mapping) -> list[Mapping]:
    """Joins the query needs, each alias once, however often fields name it, in an order that suits their conditions."""
    taken = {query.get("alias", query.get("resource"))}
    explicit: dict[str, Mapping] = {}
    for join in query.get("joins", []):
        if explicit.setdefault(alias_of(join), join) != join:
            raise ValueError(f"two different joins go by the name {alias_of(join)!r}")
    relations = {name: {**join, "alias": name} for name, join in query.get("relations", {}).items()}
    for name in [*explicit, *relations]:
        if name in taken:
            raise ValueError(f"two tables go by the name {name!r}")
    asked = [query.get(part, ()) for part in ("fields", "conditions", "group_by", "aggregates", "sorts")]
    asked += [join["on"] for join in explicit.values()]
    ordered: list[Mapping] = []

    def add(name: str, waiting: tuple[str, ...]) -> None:
        if name in taken:
            return
        if name in waiting:
            raise ValueError("relations need each other: " + ", ".join(waiting))
        join = explicit.get(name) or relations[name]
        for other in _named([join["on"]], [*explicit, *relations]):
            if other != name:
                add(other, (*waiting, name))
        taken.add(name)
        ordered.append(join)

    for name in [*explicit, *_named(_texts(asked), list(relations))]:
        add(name, ())
    return ordered


def altered(df: DataFrame, tags: Sequence[str], rules: Mapping[str, Rule]) -> DataFrame:
    """Apply the rewrite rule of each tag the query carries, in order."""
    for tag in tags:
        if tag in rules:
            df = df.transform(rules[tag])
    return df
