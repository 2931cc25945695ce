"""Row counters, orderings, pages and top-k.

A result has no order of its own when compared, so ordered results carry a position.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark.operators import search, sorts as s
from tabulark.plans import spec
from tabulark.scale import numbered
from workload import registered, table


@registered(
    "SELECT o_orderkey, 'all' AS pager, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 100 AS counter FROM orders "
    "UNION ALL (SELECT o_orderkey, 'third page', row_number() OVER (ORDER BY o_orderdate, o_orderkey) FROM orders "
    "ORDER BY o_orderdate, o_orderkey LIMIT 40 OFFSET 85)"
)
def row_counter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    by = [F.asc("o_orderdate"), F.asc("o_orderkey")]
    every = s.counter(orders, by, "counter", start=101).withColumn("pager", F.lit("all"))
    third = s.counter(orders, by, "counter", size=40, number=2, offset=5).withColumn("pager", F.lit("third page"))
    return every.unionByName(third).drop("o_orderdate")


@registered(
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS position FROM orders"
)
def order_by(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    ways = [("o_orderpriority", "asc"), ("o_orderdate", "desc"), ("o_orderkey", "asc")]
    return numbered(orders, *[s.direction(*way) for way in ways]).select("o_orderkey", "position")


@registered("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders")
def sort_by_header(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    clicked = s.by_header(orders, "o_totalprice; --", "DESC")
    return numbered(orders, clicked, F.asc("o_orderkey")).select("o_orderkey", "position")


@registered(
    "SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS position FROM orders GROUP BY o_custkey"
)
def sort_on_aggregate(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, F.desc("n"), F.asc("o_custkey"))


@registered(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS month, "
    "row_number() OVER (ORDER BY strftime(o_orderdate, '%Y%m') DESC, o_orderkey) AS position FROM orders"
)
def sort_by_granularity(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", s.date_bucket("o_orderdate", "month").alias("month"))
    return numbered(orders, F.desc("month"), F.asc("o_orderkey"))


@registered(
    "SELECT c_custkey, row_number() OVER (ORDER BY lower(coalesce(CASE WHEN c_nationkey < 12 THEN c_mktsegment END, c_name)), c_custkey) "
    "AS position FROM customer"
)
def sort_on_folded_name(spark, sf_dir):
    own = F.when(F.col("c_nationkey") < 12, F.col("c_mktsegment"))
    people = table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.coalesce(own, "c_name")).alias("name"))
    return numbered(people, F.asc("name"), F.asc("c_custkey")).drop("name")


@registered(
    "SELECT o_orderkey, row_number() OVER (ORDER BY greatest(o_orderdate, CASE WHEN o_orderstatus = 'F' "
    "THEN o_orderdate + INTERVAL 30 DAY END) DESC, o_orderkey) AS position FROM orders"
)
def sort_on_greatest(spark, sf_dir):
    later = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.greatest("o_orderdate", later).alias("updated"))
    return numbered(orders, F.desc("updated"), F.asc("o_orderkey")).drop("updated")


THREADS = "(SELECT conv_id, turn, lpad(cast(conv_id AS varchar), 8, '0') || '.' || lpad(cast(turn AS varchar), 2, '0') || '/' AS thread FROM conversations)"


@registered(
    f"SELECT conv_id, turn, row_number() OVER (ORDER BY substring(thread, 1, length(thread) - 1)) AS ascending, "
    f"row_number() OVER (ORDER BY thread DESC) AS descending FROM {THREADS}"
)
def thread_order(spark, sf_dir):
    path = F.concat(F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("."), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("/"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", path.alias("thread"))
    up = numbered(turns, s.thread_key("thread"), name="ascending")
    return numbered(up, s.thread_key("thread", "desc"), name="descending").drop("thread")


@registered(
    "SELECT c_custkey, row_number() OVER (ORDER BY n_regionkey, n_nationkey, c_custkey) AS position FROM customer "
    "JOIN nation ON c_nationkey = n_nationkey"
)
def materialised_path_order(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS p2", "n_regionkey AS p1")
    people = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey AS p2", "c_custkey AS p3")
    return numbered(people.join(nation, "p2"), "p1", "p2", "p3").select("c_custkey", "position")


@registered("SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS position FROM orders")
def random_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return numbered(orders, s.shuffled("o_orderkey", 42), F.asc("o_orderkey"))


WORDS = "(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents)"


def search_sql(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return (
        f"(WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM {WORDS} WHERE term IN ({listed}) GROUP BY ALL), "
        "idf AS (SELECT term, ln((SELECT count(*) FROM documents)::double / count(*)) AS idf FROM tf GROUP BY term) "
        "SELECT doc_id, round(sum(tf * idf), 4) AS score, count(*) AS terms FROM tf JOIN idf USING (term) GROUP BY doc_id)"
    )


@registered(f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS position FROM {search_sql(['for', 'with'])}")
def sort_on_relevance(spark, sf_dir):
    found = search.search(table(spark, sf_dir, "documents"), "doc_id", "text", ["with", "for"])
    return numbered(found.drop("terms"), *s.by_relevance(found), F.asc("doc_id"))


@registered("SELECT doc_id, n_chars, row_number() OVER (ORDER BY source DESC, n_chars DESC, doc_id) AS position FROM documents")
def search_sort(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    chosen = s.exposed_sorts([F.asc("n_chars")], "source", "desc", exposed=True)
    chosen = s.exposed_sorts(chosen, "n_chars", "desc", exposed=False)
    return numbered(docs, *chosen, F.asc("doc_id")).drop("source")


@registered(
    "SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS position FROM orders GROUP BY 1"
)
def facet_order_by_count(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, F.desc("n"), F.asc("o_orderpriority"))


@registered(
    "SELECT o_orderpriority, o_orderpriority IN ('3-MEDIUM', '5-LOW') AS active, "
    "row_number() OVER (ORDER BY o_orderpriority IN ('3-MEDIUM', '5-LOW') DESC, o_orderpriority) AS position FROM orders GROUP BY 1"
)
def facet_order_by_active(spark, sf_dir):
    values = table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    active = values.withColumn("active", F.col("o_orderpriority").isin("3-MEDIUM", "5-LOW"))
    return numbered(active, F.desc("active"), F.asc("o_orderpriority"))


@registered(
    "SELECT p_partkey, label, row_number() OVER (ORDER BY array_to_string(list_transform(regexp_extract_all(lower(label), '[0-9]+|[^0-9]+'), "
    "lambda c: CASE WHEN c[1] BETWEEN '0' AND '9' THEN lpad(ltrim(c, '0'), 20, '0') ELSE c END), ''), p_partkey) AS position "
    "FROM (SELECT p_partkey, p_brand || ' ' || p_name || ' ' || p_size AS label FROM part)"
)
def natural_order(spark, sf_dir):
    label = F.concat_ws(" ", "p_brand", "p_name", "p_size")
    parts = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
    return numbered(parts, s.natural_key("label"), F.asc("p_partkey"))


@registered("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS position FROM customer")
def key_value_sort(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    sorts = s.key_value_sorts([("c_custkey", "asc"), ("c_acctbal", "desc"), ("c_mktsegment", "asc")])
    return numbered(people, *sorts).select("c_custkey", "position")


@registered("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 20")
def limit_and_offset(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return s.page(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 30, 20)


@registered(
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM "
    "(SELECT * FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 1000)"
)
def pager_all(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return s.all_after(orders, [F.asc("o_orderdate"), F.asc("o_orderkey")], 1000).drop("o_orderdate")


@registered("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 3")
def pager_first(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return s.page(people, [F.asc("c_acctbal"), F.asc("c_custkey")], 10, 3).drop("c_acctbal")


@registered("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_cap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return s.page(orders, [F.asc("o_orderkey")], s.capped(5000, 50, 50), 100)


@registered("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 500")
def row_limit_cap(spark, sf_dir):
    query = {
        "resource": "orders",
        "fields": {"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"},
        "sorts": [("o_totalprice", "asc"), ("o_orderkey", "asc")],
        "limit": 1_000_000,
    }
    return spec.run({"orders": table(spark, sf_dir, "orders")}, query, maximum=500).drop("o_totalprice")


@registered("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def newest_first(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return s.page(events, [F.desc("ts"), F.desc("event_id")], 5)
