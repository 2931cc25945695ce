"""Facets: counts per value and the rules that show, hide and nest them.

Facet rows are (facet, value, count, active, parent). They are aggregates, so a group
of siblings is a set of distinct values, whatever the number of items behind it. A rule that
reads them more than once writes them first: the items are counted once.
"""

from __future__ import annotations

import math

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulark.scale import numbered
from tabulark.scratch import cut


def counts(df: DataFrame, fields: Mapping[str, str | Column]) -> DataFrame:
    """Counts of several facets in one pass and one shuffle, merged into one list."""
    pairs = [
        F.struct(F.lit(name).alias("facet"), (F.col(f) if isinstance(f, str) else f).cast("string").alias("value"))
        for name, f in fields.items()
    ]
    each = df.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.*")
    return each.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))


def counts_for(df: DataFrame, fields: Mapping[str, str | Column], known: DataFrame) -> DataFrame:
    """Counts for known values (facet, value); values without hits report 0."""
    found = counts(df, fields)
    return known.join(found, ["facet", "value"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def marked(facets: DataFrame, active: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add ``active`` from the request's selection per facet."""
    hit = F.lit(False)
    for facet, values in active.items():
        hit = hit | ((F.col("facet") == facet) & F.coalesce(F.col("value").isin(*values), F.lit(False)))
    return facets.withColumn("active", hit)


def with_options(
    facets: DataFrame, limit: int | None = None, min_count: int = 0, missing: bool = False
) -> DataFrame:
    """Facet options: least count, whether the NULL group shows, values per facet.

    The limit is a ranked group limit, which Spark applies before the shuffle too.
    """
    kept = facets.filter(F.col("count") >= min_count)
    if not missing:
        kept = kept.filter(F.col("value").isNotNull())
    if limit is None:
        return kept
    best = Window.partitionBy("facet").orderBy(F.col("count").desc(), F.col("value"))
    return kept.withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= limit).drop("_nth")


def without_empty(facets: DataFrame, operator: str = "and") -> DataFrame:
    """Range results: buckets with hits (all of them under ``or``), never the missing or empty value."""
    kept = facets.filter(F.col("value").isNotNull() & ~F.col("value").isin("", "NULL"))
    return kept if operator == "or" else kept.filter(F.col("count") > 0)


def slider(values: DataFrame, step: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts on the grid low, low+step, ... up to high; grid points without a value have 0.

    Without fixed bounds they come from the values, high rounded up to a multiple of the step. Bounds and steps may
    be fractions. ``values`` has (value, count). Values off the grid do not show.
    """
    values = cut(values, "values")
    if low is None or high is None:
        bounds = values.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
        low, high = bounds["low"] or 0, bounds["high"] or 0
        high = math.ceil(float(high) / step - 1e-9) * step
    # Grid points are numbered, so that fractions meet in spite of rounding.
    low, points = float(low), max(0, math.floor((float(high) - float(low)) / step + 1e-9) + 1)
    grid = values.sparkSession.range(points).select("id", (F.lit(low) + F.col("id") * F.lit(float(step))).alias("value"))
    off = (F.col("value").cast("double") - F.lit(low)) / F.lit(float(step))
    found = values.select(F.round(off).cast("bigint").alias("id"), (F.abs(off - F.round(off)) < 1e-6).alias("on"), "count")
    found = found.filter("on").groupBy("id").agg(F.sum("count").alias("count"))
    return grid.join(found, "id", "left").select("value", F.coalesce("count", F.lit(0)).alias("count"))


def hide_only_item(facets: DataFrame) -> DataFrame:
    """Drop a facet's value when it is the only one and not selected."""
    facets = cut(facets, "facets")
    sizes = facets.groupBy("facet").agg(F.count(F.lit(1)).alias("_values"))
    return facets.join(sizes, "facet").filter((F.col("_values") > 1) | F.col("active")).drop("_values")


def hide_active(facets: DataFrame) -> DataFrame:
    return facets.filter(~F.col("active"))


def hide_non_narrowing(facets: DataFrame, total: int) -> DataFrame:
    """Drop inactive values that match nothing or everything, unless a kept or active child hangs on them.

    Rows carry ``level`` (1 at the top); the deepest level is settled first.
    """
    facets = cut(facets, "facets")
    narrowing = ~F.col("count").isin(0, total) | F.col("active")
    depth = facets.agg(F.max("level")).first()[0] or 0
    kept = facets.filter((F.col("level") == depth) & narrowing)
    below = kept
    for level in range(depth - 1, 0, -1):
        parents = below.select("facet", F.col("parent").alias("value")).distinct().withColumn("_holds", F.lit(True))
        here = facets.filter(F.col("level") == level).join(parents, ["facet", "value"], "left")
        below = here.filter(narrowing | F.col("_holds").isNotNull()).select(*facets.columns)
        kept = kept.unionByName(below)
    return kept


def deepest_only(facets: DataFrame) -> DataFrame:
    """Values that are nobody's parent."""
    facets = cut(facets, "facets")
    parents = facets.select("facet", F.col("parent").alias("value")).filter(F.col("value").isNotNull()).distinct()
    return facets.join(parents, ["facet", "value"], "left_anti")


def siblings(hierarchy: DataFrame, values: DataFrame) -> DataFrame:
    """Values of the same facet that share a parent (or the top level) with the given ones, without these.

    The hierarchy has (facet, value, parent).
    """
    given = values.select("facet", "value")
    parents = hierarchy.join(given, ["facet", "value"], "left_semi").select("facet", "parent").distinct()
    same = (F.col("h.facet") == F.col("p.facet")) & F.col("h.parent").eqNullSafe(F.col("p.parent"))
    beside = hierarchy.alias("h").join(parents.alias("p"), same, "left_semi")
    return beside.select("facet", "value", "parent").join(given, ["facet", "value"], "left_anti")


def show_siblings(facets: DataFrame, hierarchy: DataFrame, parents_too: bool = True) -> DataFrame:
    """Append missing siblings with count 0; only those of active values unless ``parents_too``."""
    facets, hierarchy = cut(facets, "facets"), cut(hierarchy, "hierarchy")
    around = facets if parents_too else facets.filter("active")
    new = siblings(hierarchy, around).join(facets.select("facet", "value"), ["facet", "value"], "left_anti")
    shown = new.withColumn("count", F.lit(0)).withColumn("active", F.lit(False))
    return facets.unionByName(shown, allowMissingColumns=True)


def hide_inactive_siblings(facets: DataFrame, hierarchy: DataFrame | None = None, keep_parents_active: bool = False) -> DataFrame:
    """Once something is selected in a facet, drop its inactive siblings and their children there.

    Parents of the selection count as selected. Without a hierarchy every inactive value of that facet goes.
    """
    facets = cut(facets, "facets")
    chosen = facets.filter("active").select("facet", "value")
    if hierarchy is None:
        used = chosen.select("facet").distinct().withColumn("_used", F.lit(True))
        return facets.join(used, "facet", "left").filter(F.col("active") | F.col("_used").isNull()).drop("_used")
    hierarchy = cut(hierarchy, "hierarchy")
    if not keep_parents_active:
        above = hierarchy.join(chosen, ["facet", "value"], "left_semi").select("facet", F.col("parent").alias("value"))
        chosen = chosen.unionByName(above.filter(F.col("value").isNotNull())).distinct()
    beside = siblings(hierarchy, chosen).select("facet", "value")
    below = hierarchy.join(beside.withColumnRenamed("value", "parent"), ["facet", "parent"], "left_semi").select("facet", "value")
    gone = beside.unionByName(below).distinct().withColumn("_gone", F.lit(True))
    return facets.join(gone, ["facet", "value"], "left").filter(F.col("active") | F.col("_gone").isNull()).drop("_gone")


def date_parent(value: str | Column) -> Column:
    """The value without its last date or time part; NULL at the top."""
    column = F.col(value) if isinstance(value, str) else value
    above = F.regexp_extract(column, r"^(.*)[-T:]\d+$", 1)
    return F.when(above != "", above)


def date_levels(df: DataFrame, value: str, levels: int) -> DataFrame:
    """Counts for each date value and its ancestors, with their parents.

    The finest level is counted from the rows; each coarser one from the level below.
    """
    finest = df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    steps = [F.col("value")]
    for _ in range(levels - 1):
        steps.append(date_parent(steps[-1]))
    every = finest.select(F.explode(F.array_compact(F.array(*steps))).alias("value"), "count")
    return every.groupBy("value").agg(F.sum("count").alias("count")).withColumn("parent", date_parent("value"))


def tree_rows(facets: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Facet rows numbered as a tree: the rows below one are those with ``left`` above its own and up to its ``right``.

    Added are ``depth`` (1 at the top), ``left`` (place in pre-order over all facets, from 1), ``right`` and ``subtree``
    (the counts of the row and all below it added up). Siblings follow the columns in ``order``, then the value. A value whose
    parent has no row, or that is its own parent, stands at the top with all that hangs on it. A value with two rows
    in a facet, and a circle of parents, are refused, as no place in a tree fits them. No rows give none.
    """
    facets = cut(facets, "facets")
    if not facets.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("a facet has two rows for one value")
    step = F.array(F.struct(*[F.col(c) for c in order], F.col("value")))
    parents = facets.where("value IS NOT NULL").select("facet", F.col("value").alias("parent"), F.lit(True).alias("_held"))
    hung = facets.join(parents, ["facet", "parent"], "left")
    on_top = F.col("_held").isNull() | (F.col("parent") == F.col("value"))
    hung = cut(hung.select(*facets.columns, on_top.alias("_top"), step.alias("_step")), "hung")
    level = hung.where("_top").withColumn("_path", F.col("_step"))
    levels = []
    while not level.isEmpty():
        levels.append(cut(level.select(*facets.columns, "_path"), "level"))
        above = levels[-1].select("facet", F.col("value").alias("parent"), F.col("_path").alias("_above"))
        level = hung.where("NOT _top").join(above, ["facet", "parent"]).withColumn("_path", F.concat("_above", "_step"))
    if not levels:
        return facets.select("*", *[F.lit(0).cast(t).alias(c) for c, t in TREE_COLUMNS.items()])
    placed = levels[0]
    for lower in levels[1:]:
        placed = placed.unionByName(lower)
    if placed.count() < facets.count():
        raise ValueError("parents form a circle")
    ways = F.transform(F.sequence(F.lit(1), F.size("_path")), lambda i: F.slice("_path", 1, i))
    sums = placed.select("facet", F.explode(ways).alias("_path"), "count").groupBy("facet", "_path").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("count").cast("bigint").alias("subtree")
    )
    rows = numbered(placed, "facet", "_path", name="left").join(sums, ["facet", "_path"])
    rows = rows.withColumn("depth", F.size("_path").cast("int")).withColumn("right", F.col("left") + F.col("_rows") - 1)
    return rows.select(*facets.columns, *TREE_COLUMNS)


TREE_COLUMNS = {"depth": "int", "left": "bigint", "right": "bigint", "subtree": "bigint"}


def below(rows: DataFrame, facet: str, values: Sequence[str]) -> DataFrame:
    """Of numbered tree rows, the given values of a facet and everything below them, each once. As many values as a request names."""
    chosen = rows.where((F.col("facet") == facet) & F.col("value").isin(*values))
    ranges = [(r["left"], r["right"]) for r in chosen.select("left", "right").collect()]
    inside = F.lit(False)
    for left, right in ranges:
        inside = inside | F.col("left").between(left, right)
    return rows.where(inside)


def tree(facets: DataFrame) -> DataFrame:
    """One JSON text per top value, children nested, one level folded per pass; for trees that fit a text (else ``tree_rows``).

    A pass collects the distinct children of a value, which the calendar or the vocabulary bounds.
    ``facets`` has (facet, value, label, count, active, parent).
    """

    def node(children: Column | None) -> Column:
        members = [
            F.col("label").alias("value"),
            F.col("count"),
            F.when(F.col("active"), "true").alias("active"),
        ]
        text = F.to_json(F.struct(*members))
        if children is None:
            return text
        inner = F.concat(F.expr("substring(_text, 1, length(_text) - 1)"), F.lit(',"children":['), children, F.lit("]}"))
        return F.when(children.isNull(), F.col("_text")).otherwise(inner)

    rows = cut(tree_rows(facets), "tree")
    depth = rows.agg(F.max("depth")).first()[0] or 1
    under = None
    for level in range(depth, 0, -1):
        here = rows.filter(F.col("depth") == level).withColumn("_text", node(None))
        if under is not None:
            folded = under.groupBy("facet", F.col("parent").alias("value")).agg(
                F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "_text"))), lambda c: c["_text"]), ",").alias("_children")
            )
            here = here.join(folded, ["facet", "value"], "left").withColumn("_text", node(F.col("_children")))
        under = here.select("facet", "value", "parent", "left", "_text")
    return under.select("value", F.col("_text").alias("tree"))


def summary(facets: DataFrame, total: int) -> DataFrame:
    """Total results and, per facet with a selection, the labels selected (as many as the request names)."""
    chosen = facets.filter("active").groupBy("facet").agg(
        F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("selected")
    )
    return chosen.withColumn("total", F.lit(total).cast("bigint"))
