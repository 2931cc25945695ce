"""Join shapes of catalog queries.

Row-preserving joins from a fact to its lookup go through ``lookup_join`` (or ``salted_join``
where the lookup is itself an aggregate) because one key may hold much of the fact side. Everything that only needs a count, a maximum
or one representative is aggregated first, so the join is one row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.scale import folded, lookup_join, salted_join
from tabulark.scratch import cut


def inner(rows: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lookup_join(rows, lookup, keys)


def with_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Left join from unique parents to many children; parents without any stay once.

    Written from the children's side, where hot keys can be salted.
    """
    matched = lookup_join(children, parents, [key])
    lonely = parents.join(children.select(key).distinct(), key, "left_anti")
    return matched.unionByName(lonely, allowMissingColumns=True)


def on_text_key(
    rows: DataFrame, text_key: str, lookup: DataFrame, number_key: str, as_text: bool = False, extra: Column | None = None
) -> DataFrame:
    """Join a text id to a number id, as numbers or, if ``as_text``, as texts.

    As numbers ``07`` matches 7, and text that is no whole number matches nothing.
    """
    if as_text:
        typed = rows.withColumn("_id", F.col(text_key))
        keyed = lookup.withColumn("_id", F.col(number_key).cast("string"))
    else:
        typed = rows.withColumn("_id", F.col(text_key).try_cast("bigint")).filter(F.col("_id").isNotNull())
        keyed = lookup.withColumn("_id", F.col(number_key).cast("bigint"))
    joined = lookup_join(typed, keyed, ["_id"]).drop("_id")
    return joined if extra is None else joined.filter(extra)


def other_revisions(revisions: DataFrame, current: DataFrame, key: str, revision: str) -> DataFrame:
    """Revisions of an item other than its current one (``current`` has one row per item)."""
    named = current.select(key, F.col(revision).alias("current_revision"))
    return salted_join(revisions, named, [key]).filter(F.col(revision) != F.col("current_revision"))


def latest(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The whole newest row of each key, by partial aggregation rather than a window."""
    others = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), F.struct(*order_by)).alias("_row"))
        .select(*keys, "_row.*")
    )


def with_maximum(rows: DataFrame, keys: Sequence[str], field: str, name: str) -> DataFrame:
    """Rows beside the maximum of their group."""
    top = rows.groupBy(*keys).agg(F.max(field).alias(name))
    return salted_join(rows, top, keys)


def on_override(
    base: DataFrame, overrides: DataFrame, key: str, revision: str, revisions: DataFrame, revision_key: str
) -> DataFrame:
    """Join each item to its overriding revision where there is one, else to its own."""
    chosen = overrides.select(key, F.col(revision).alias("_override"))
    picked = base.join(chosen, key, "left").withColumn("_revision", F.coalesce("_override", revision))
    return picked.join(revisions, F.col("_revision") == F.col(revision_key)).drop("_revision", "_override")


def exists_or(rows: DataFrame, others: DataFrame, key: str, local: Column) -> DataFrame:
    """Rows where a local predicate holds or a matching row exists: a left join to distinct keys."""
    known = others.select(key).distinct().withColumn("_exists", F.lit(True))
    return rows.join(known, key, "left").filter(local | F.col("_exists").isNotNull()).drop("_exists")


def not_exists(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others.select(key).distinct(), key, "left_anti")


def with_distinct_count(rows: DataFrame, others: DataFrame, key: str, field: str, more_than: int = 0) -> DataFrame:
    """Rows whose matching rows have more than so many distinct values."""
    counts = others.groupBy(key).agg(F.count_distinct(field).alias("_n")).filter(F.col("_n") > more_than)
    return rows.join(counts.select(key), key, "left_semi")


def representative(parents: DataFrame, children: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """Each parent with its one best child, or with none."""
    return parents.join(latest(children, [key], order_by), key, "left")


def looked_up(rows: DataFrame, maps: Sequence[DataFrame], source: str, destination: str) -> DataFrame:
    """Destination keys of source ids over several id maps; one id may have several."""
    together = maps[0]
    for other in maps[1:]:
        together = together.unionByName(other)
    return salted_join(rows, together.select(source, destination).distinct(), [source])


def existing(rows: DataFrame, field: str, known: DataFrame, key: str, name: str) -> DataFrame:
    """The id when the entity exists, else NULL."""
    ids = known.select(F.col(key).alias(field)).distinct().withColumn("_found", F.lit(True))
    found = salted_join(rows, ids, [field], "left")
    return found.withColumn(name, F.when(F.col("_found"), F.col(field))).drop("_found")


def referencers(references: DataFrame, wanted: DataFrame, reference: str, referencer: str) -> DataFrame:
    """Who refers to the wanted ids, one row per (reference, referencer)."""
    pairs = references.select(reference, referencer).distinct()
    return salted_join(pairs, wanted.select(reference), [reference], "left_semi")


def orphans(old: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """References that were there before and are nowhere now."""
    return old.select(*keys).distinct().join(current.select(*keys), list(keys), "left_anti")


def children_folded(
    parents: DataFrame, children: DataFrame, key: str, order_by: Sequence[str], item: Column, name: str, size: int
) -> DataFrame:
    """Parents beside their ordered children, in chunks; childless parents have chunk NULL."""
    return parents.join(folded(children, [key], order_by, item, name, size), key, "left")


def attributes_to_columns(
    values: DataFrame, item: str, name: str, value: str, order_by: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """One column per known attribute name, the last value of each."""
    last = [
        F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.struct(*order_by))).alias(n)
        for n in names
    ]
    return values.groupBy(item).agg(*last)


def inverted(rows: DataFrame, item: str, text: str, name: str, delimiter: str = ",") -> DataFrame:
    """(listed value, item) pairs from comma lists with stray commas at the ends."""
    bare = F.regexp_replace(text, f"^{delimiter}+|{delimiter}+$", "")
    return rows.select(item, F.explode(F.split(bare, delimiter)).alias(name))


def pointed_at_source(rows: DataFrame, set_key: str, member: str) -> DataFrame:
    """Members beside the smallest of their set; the smallest itself is the source."""
    first = rows.groupBy(set_key).agg(F.min(member).alias("source"))
    return salted_join(rows, first, [set_key]).withColumn("is_source", F.col(member) == F.col("source"))


def depth_clamped(depth: int) -> int:
    return max(-10, min(10, depth))


def terms_to_depth(hierarchy: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """The root terms and their descendants (or ancestors, if negative) to a depth of at most 10.

    ``hierarchy`` has (term, parent). One equi-join per level; each level is written out,
    so the plan does not grow, and the walk ends with the first empty level.
    """
    depth = depth_clamped(depth)
    step, key = ("term", "parent") if depth > 0 else ("parent", "term")
    frontier = found = roots.select("term")
    for _ in range(abs(depth)):
        links = hierarchy.select(F.col(key).alias("_from"), F.col(step).alias("_to"))
        frontier = cut(
            frontier.join(links, F.col("term") == F.col("_from"))
            .filter(F.col("_to").isNotNull())
            .select(F.col("_to").alias("term"))
            .distinct()
        )
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found.distinct()


def with_default(rows: DataFrame, settings: DataFrame, key: str, flag: str, default) -> DataFrame:
    """A flag from the settings row, or the default where there is none."""
    return rows.join(settings.select(key, flag), key, "left").withColumn(flag, F.coalesce(flag, F.lit(default)))


def map_rows(rows: DataFrame, keep: Sequence[str], field: str) -> DataFrame:
    """One row per entry of a map, the parent's columns repeated."""
    return rows.select(*keep, F.explode(field).alias("key", "value"))


def labelled(rows: DataFrame, key: str, labels: DataFrame, label: str, required: bool = False) -> DataFrame:
    """Labels for ids; a missing label shows the id, or drops the row if a label is required."""
    joined = lookup_join(rows, labels.select(key, label), [key], "inner" if required else "left")
    return joined.withColumn(label, F.coalesce(label, F.col(key).cast("string")))
