"""Empty inputs and missing settings."""

import pytest
from pyspark.sql import functions as F

from tabulark import scale, scratch
from tabulark.operators import facets, search, sorts
from tabulark.sources import tables, writes


def test_empty_inputs(spark):
    empty = spark.range(0).select(F.col("id").alias("k"), F.col("id").alias("v"))
    assert scale.numbered(empty, "k").count() == 0
    assert scale.numbered_within(empty, ["k"], ["v"], limit=-1).count() == 0
    assert scale.folded(empty, ["k"], ["v"], F.col("v"), "vs").count() == 0
    assert scale.salted_join(empty, empty.withColumnRenamed("v", "w"), ["k"], "left").count() == 0
    assert sorts.all_after(empty, [F.asc("k")], 5).count() == 0
    assert facets.slider(empty.select(F.col("k").alias("value"), F.col("v").alias("count")), 5).collect() == [(0.0, 0)]


def test_search_without_hits(spark):
    docs = spark.createDataFrame([(1, "red"), (2, None), (3, "")], "id int, text string")
    assert search.search(docs, "id", "text", ["blue"]).count() == 0
    assert search.index(docs, "id", {"text": "text"}).count() == 1
    assert search.more_like_this(docs, "id", "text", 1).count() == 0


def test_summary_of_an_empty_table(spark):
    table = writes.truncate(spark.range(5))
    row = tables.table_summary(table, "t", indexes=["id"]).first()
    assert (row.num_of_columns, row.columns, row.indexes, row.num_of_rows) == (1, "id", "id", None)


def test_default_columns_and_missing_values_on_insert(spark):
    target = spark.createDataFrame([(1, "a", 2)], "id bigint, name string, n int")
    rows = spark.createDataFrame([(2, None)], "id int, name string")
    got = writes.insert_rows(target, rows, {"name": "none"}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", 2), (2, "none", None)]


def test_only_local_sessions_get_a_folder_of_their_own(spark):
    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app-1"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        scratch.shared_folder(Session())
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch.shared_folder(spark) == (named.rstrip("/") if named else scratch.shared_folder(spark))


def test_wide_rows_are_not_small(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1_000_000).alias("text"))
    assert scale.is_small(wide.select("id")) and not scale.is_small(wide)
