"""What the operators share: row keys, size-checked broadcasts, joins back to whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulark.session import prepare

# A side of a join is broadcast up to this many counted rows of a few numbers each.
BROADCAST_ROWS = 1_000_000

# Rows that go to a Python worker at a time, which bounds its memory where texts are long.
BATCH_ROWS = 256

# The columns that stand for one document: its id and a hash of its text.
KEYS = ["doc_id", "text_key"]


def settled(spark: SparkSession) -> SparkSession:
    """The library's runtime settings, and batches of bounded size for Python workers."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def text_key() -> Column:
    """Tells rows with one doc_id but different texts apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """Only what the operators read: doc_id, text (null: empty) and text_key. Extra columns are left behind."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key().alias("text_key"))


def bounded(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table of few counted rows; a larger one is left to a shuffled join."""
    return F.broadcast(table) if table.count() <= max_rows else table


def same_key(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of the named columns where two nulls are equal."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def with_decisions(docs: DataFrame, decisions: DataFrame, how: str = "left") -> DataFrame:
    """Join whole documents to a written table of at most one row per (doc_id, text_key).

    All columns of ``docs`` stay as they are; the columns of ``decisions`` that are no key are added.
    ``decisions`` must not share their names with ``docs``.
    """
    right = bounded(decisions)
    same = docs["doc_id"].eqNullSafe(right["doc_id"]) & (text_key_of(docs) == right["text_key"])
    joined = docs.join(right, same, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], *[right[c] for c in decisions.columns if c not in KEYS])


def text_key_of(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until neither they nor what begins with them is a column of ``docs``."""
    tail = "_"
    while any(column.startswith(f"{name}{tail}") for column in docs.columns for name in names):
        tail += "_"
    return [f"{name}{tail}" for name in names]
