"""Key rules: uniqueness checks, unique suffixes, duplicate labels, autocomplete, hierarchy roots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulark.functions.lists import encode_tag
from tabulark.operators.predicates import condition
from tabulark.scale import numbered_within


def duplicate_aliases(rows: DataFrame, alias: str, language: str) -> DataFrame:
    """Aliases used more than once in a language, or once more in other capitals.

    Counts per exact spelling first, so the window only sees the spellings of one alias.
    """
    spelled = rows.groupBy(language, alias).agg(F.count(F.lit(1)).alias("uses"))
    folded = Window.partitionBy(language, F.lower(alias))
    other = F.sum("uses").over(folded) - F.col("uses")
    return (
        spelled.withColumn("other_spellings", other)
        .filter((F.col("uses") > 1) | (F.col("other_spellings") > 0))
        .withColumn("violation", F.when(F.col("uses") > 1, "in use").otherwise("differs in capitals"))
    )


def uniquify(rows: DataFrame, alias: str, language: str, order_by: Sequence[str]) -> DataFrame:
    """Give each row its own ``unique_alias``: the first keeps the alias, others get -0, -1, ...

    Suffixes that exist already are skipped. The k-th free number of an alias is k plus the
    taken numbers below it; sorting duplicates and taken numbers together counts those, with
    every group split over partitions.
    """
    keys = [language, alias]
    placed = numbered_within(rows, keys, order_by, name="_nth")
    repeats = placed.filter("_nth > 1").select(*keys, (F.col("_nth") - 2).alias("_at"), F.lit(1).alias("_kind"))
    base = F.regexp_extract(alias, r"^(.*)-(0|[1-9]\d{0,17})$", 1)
    number = F.regexp_extract(alias, r"^(.*)-(0|[1-9]\d{0,17})$", 2)
    taken = (
        rows.select(language, base.alias("_base"), number.alias("_number"))
        .filter("_number <> ''")
        .distinct()
        .select(language, F.col("_base").alias(alias), F.col("_number").cast("bigint").alias("_at"))
    )
    taken = taken.join(repeats.select(*keys).distinct(), keys, "left_semi")
    # A taken number counts against the free numbers from its own value minus its rank on.
    shifted = numbered_within(taken, keys, ["_at"], name="_rank").select(
        *keys, (F.col("_at") - F.col("_rank") + 1).alias("_at"), F.lit(0).alias("_kind")
    )
    together = numbered_within(repeats.unionByName(shifted), keys, ["_at", "_kind"], name="_seat")
    suffixes = together.filter("_kind = 1").select(
        *keys, (F.col("_at") + 2).alias("_nth"), (F.col("_seat") - 1).alias("_suffix")
    )
    named = F.when(F.col("_suffix").isNull(), F.col(alias)).otherwise(F.concat_ws("-", alias, "_suffix"))
    return (
        placed.join(suffixes, [*keys, "_nth"], "left")
        .withColumn("unique_alias", named)
        .select(*rows.columns, "unique_alias")
    )


def duplicate_labels(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")


def autocomplete(
    rows: DataFrame, label: str, key: str, text: str, op: str = "CONTAINS", limit: int = 10
) -> DataFrame:
    """The first matches as ``label (id)``, tags and extra blanks removed, quoted where needed."""
    matches = rows.filter(condition(label, text, op)).orderBy(label, key).limit(limit)
    shown: Column = F.concat(F.col(label), F.lit(" ("), F.col(key).cast("string"), F.lit(")"))
    shown = F.trim(F.regexp_replace(shown, "<[^>]*>", ""))
    shown = F.regexp_replace(F.regexp_replace(shown, "\n", ""), r"\s\s+", " ")
    return matches.select(encode_tag(shown).alias("value"), F.col(label).alias("label"))


def top_level_terms(terms: DataFrame, vocabularies: Sequence[str]) -> DataFrame:
    return terms.filter(F.col("vocabulary").isin(*vocabularies) & (F.col("parent") == 0))
