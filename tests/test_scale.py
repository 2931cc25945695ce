"""The distributed paths against plain Python, on data where one key holds most rows."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tabulark import scale
from tabulark.operators import keys


def skewed(spark, rows=3000):
    """Two thirds of the rows belong to key 0."""
    return spark.range(rows).select(
        F.when(F.col("id") < rows * 2 // 3, 0).otherwise(F.col("id") % 50).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"),
        "id",
    )


def test_numbered_is_the_sorted_place(spark):
    rows = scale.numbered(skewed(spark).repartition(7), F.desc("v"), "id").collect()
    wanted = sorted(rows, key=lambda r: (-r.v, r.id))
    assert [r.position for r in wanted] == list(range(1, 3001))


def test_numbered_within_splits_a_hot_group(spark):
    df = skewed(spark).repartition(7)
    split = scale.numbered_within(df, ["k"], ["v", "id"], limit=10)
    whole = scale.numbered_within(df, ["k"], ["v", "id"])
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))
    assert not scale.groups_fit(df, ["k"], 1500)
    assert scale.groups_fit(df, ["k"], 2500)


def test_numbered_within_keeps_null_keys(spark):
    df = skewed(spark, 300).withColumn("k", F.when(F.col("k") != 0, F.col("k")))
    split = scale.numbered_within(df, ["k"], ["id"], limit=1).collect()
    assert sorted(r.position for r in split if r.k is None) == list(range(1, 1 + sum(r.k is None for r in split)))


def test_folded_keeps_order_and_size(spark):
    for limit in (10, 10_000):
        rows = scale.folded(skewed(spark), ["k"], ["v", "id"], F.col("id"), "ids", size=100, limit=limit).collect()
        assert max(len(r.ids) for r in rows) == 100
        chunks = defaultdict(dict)
        for r in rows:
            chunks[r.k][r.chunk] = r.ids
        for k, parts in chunks.items():
            got = [i for c in sorted(parts) for i in parts[c]]
            assert got == [r.id for r in sorted(skewed(spark).filter(F.col("k") == k).collect(), key=lambda r: (r.v, r.id))]


def test_hot_keys_are_found_and_salted_joins_agree(spark):
    df = skewed(spark)
    lookup = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    assert len(scale.hot_keys(df, ["k"], share=0.2, min_rows=1)) == 1
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = scale.salted_join(df, lookup, ["k"], how, salts=4, share=0.2, min_rows=1)
        assert Counter(map(tuple, salted.collect())) == Counter(map(tuple, df.join(lookup, ["k"], how).collect()))


def test_lookup_join_agrees_either_way(spark):
    df = skewed(spark)
    lookup = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    small = scale.lookup_join(df, lookup, ["k"])
    large = scale.lookup_join(df, lookup, ["k"], max_rows=5)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_uniquify_skips_taken_suffixes(spark):
    aliases = ["a", "a", "a", "a", "a-1", "a-0x", "a-03", "b", "b", "b-0", "b-0", "c-7"]
    df = spark.createDataFrame(list(enumerate(aliases)), "id bigint, alias string").withColumn("lang", F.lit("en"))
    rows = keys.uniquify(df, "alias", "lang", ["id"]).orderBy("id").collect()
    # A free number is one no alias has yet.
    taken, wanted = set(aliases), []
    seen = set()
    for alias in aliases:
        name = alias
        if alias in seen:
            number = 0
            while f"{alias}-{number}" in taken:
                number += 1
            name = f"{alias}-{number}"
            taken.add(name)
        seen.add(alias)
        wanted.append(name)
    assert [r.unique_alias for r in rows] == wanted
    assert len({r.unique_alias for r in rows}) == len(aliases)
