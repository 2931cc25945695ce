"""Set operations and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark.functions import hashes
from tabulark.operators import diffs, facets
from workload import registered, table


@registered(
    "SELECT 'language' AS facet, lang AS value, count(*) AS count FROM documents GROUP BY 2 UNION ALL "
    "SELECT 'quality', cast(quality AS varchar), count(*) FROM labels GROUP BY 2"
)
def merge_facet_lists(spark, sf_dir):
    languages = facets.counts(table(spark, sf_dir, "documents"), {"language": "lang"})
    qualities = facets.counts(table(spark, sf_dir, "labels"), {"quality": "quality"})
    return diffs.merged([languages, qualities])


@registered("SELECT user_id AS id FROM events WHERE event_type = 'signup' UNION SELECT user_id FROM events WHERE event_type = 'error'")
def distinct_union_of_ids(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type")
    parts = [events.filter(F.col("event_type") == kind).select("id") for kind in ("signup", "error")]
    return diffs.distinct_union(parts)


NESTED_A = (
    "SELECT o_orderkey, unnest(['status.code', 'status.priority', 'customer']) AS path, "
    "unnest([o_orderstatus, o_orderpriority, cast(o_custkey AS varchar)]) AS value FROM orders"
)
NESTED_B = (
    "SELECT o_orderkey, unnest(['status.code', 'status.priority', 'customer']) AS path, "
    "unnest([CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END, "
    "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, cast(o_custkey AS varchar)]) AS value FROM orders "
    "WHERE o_totalprice < 400000"
)


@registered(
    f"WITH a AS ({NESTED_A}), b AS ({NESTED_B}) SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM b "
    "WHERE b.o_orderkey = a.o_orderkey AND b.path = a.path AND b.value IS NOT DISTINCT FROM a.value)"
)
def recursive_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")

    def nested(df, code, priority):
        status = F.struct(code.alias("code"), priority.alias("priority"))
        return df.select("o_orderkey", status.alias("status"), F.col("o_custkey").alias("customer"))

    left = nested(orders, F.col("o_orderstatus"), F.col("o_orderpriority"))
    code = F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus"))
    priority = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    right = nested(orders.filter("o_totalprice < 400000"), code, priority)
    return diffs.difference(left, right, "o_orderkey")


SOURCE = "(SELECT p_type AS collection, p_partkey AS name, p_brand AS data FROM part WHERE p_size <= 35 AND p_type <> 'PROMO')"
TARGET = (
    "(SELECT p_type AS collection, p_partkey AS name, CASE WHEN p_size < 20 THEN p_name ELSE p_brand END AS data "
    "FROM part WHERE p_size >= 10)"
)


@registered(
    f"SELECT coalesce(s.collection, t.collection) AS collection, coalesce(s.name, t.name) AS name, "
    "CASE WHEN s.name IS NULL THEN 'DELETE' WHEN t.name IS NULL THEN 'INSERT' WHEN s.data = t.data THEN 'KEEP' ELSE 'UPDATE' END AS action, "
    f"s.data AS data FROM {SOURCE} s FULL JOIN {TARGET} t ON s.collection = t.collection AND s.name = t.name"
)
def replace_target_with_source(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnsRenamed({"p_type": "collection", "p_partkey": "name"})
    source = part.filter("p_size <= 35 AND collection <> 'PROMO'").withColumn("data", F.col("p_brand"))
    data = F.when(F.col("p_size") < 20, F.col("p_name")).otherwise(F.col("p_brand"))
    target = part.filter("p_size >= 10").withColumn("data", data)
    return diffs.replacement(source, target, ["collection", "name"], "data")


@registered(
    "SELECT doc_id, CASE WHEN n_chars < 500 THEN 'NEW' WHEN lang = 'de' THEN 'REMOVED' WHEN lang = 'fr' THEN 'UPDATED' "
    "ELSE 'UNCHANGED' END AS status FROM documents WHERE NOT (n_chars < 500 AND lang = 'de')"
)
def harvest_classification(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", "n_chars")
    feed = docs.filter("lang <> 'de'")
    # The last run saw the same records with their keys in another order, and other French sources.
    source = F.when(F.col("lang") == "fr", F.concat("source", F.lit("-old"))).otherwise(F.col("source"))
    known = docs.filter("n_chars >= 500").select("text", source.alias("source"), "n_chars", "lang", "doc_id")
    kept = known.select("doc_id", hashes.record_hash(known).alias("hash"))
    return diffs.harvested(feed, kept, "doc_id", hashes.record_hash(feed)).drop("hash")
