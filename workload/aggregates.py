"""Aggregations and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark import scale
from tabulark.operators import aggregates as a, facets as f, joins as j
from tabulark.scratch import cut
from workload import registered, table


@registered(
    "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O'"
)
def count_rows(spark, sf_dir):
    counted = table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open")
    )
    return counted.unpivot([], ["orders", "open"], "name", "n")


@registered("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_by(spark, sf_dir):
    return a.grouped(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], n=("count", "o_orderkey"))


@registered(
    "WITH v AS (SELECT l_orderkey, l_returnflag AS flag FROM lineitem WHERE l_quantity > 25 UNION ALL "
    "SELECT l_orderkey, l_linestatus FROM lineitem WHERE l_quantity > 25 UNION ALL "
    "SELECT l_orderkey, NULL FROM lineitem WHERE l_quantity <= 25), "
    "c AS (SELECT flag, count(l_orderkey) AS n FROM v GROUP BY flag) "
    "SELECT flag, n, row_number() OVER (ORDER BY n DESC, flag) AS position FROM c"
)
def multi_value_group_count(spark, sf_dir):
    flags = F.when(F.col("l_quantity") > 25, F.array("l_returnflag", "l_linestatus"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", flags.alias("flags"))
    return scale.numbered(a.value_counts(lines, "flags", "l_orderkey", "flag"), F.desc("n"), F.asc("flag"))


@registered(
    "SELECT 'all' AS scope, cast(sum(n_chars) AS bigint) AS space FROM documents UNION ALL "
    "SELECT 'fr', cast(sum(n_chars) AS bigint) FROM documents WHERE lang = 'fr' UNION ALL SELECT 'none', NULL"
)
def sum_of_sizes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("n_chars", "lang")
    parts = [
        a.space_used(docs, "n_chars", **equal).withColumn("scope", F.lit(scope))
        for scope, equal in (("all", {}), ("fr", {"lang": "fr"}), ("none", {"lang": "xx"}))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@registered("SELECT o_custkey, o_orderstatus, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey, o_orderstatus")
def max_per_group(spark, sf_dir):
    return a.grouped(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], last_order=("max", "o_orderkey"))


@registered("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority")
def count_distinct(spark, sf_dir):
    return a.grouped(table(spark, sf_dir, "orders"), ["o_orderpriority"], customers=("count_distinct", "o_custkey"))


@registered("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@registered(
    "SELECT l_orderkey, l_linenumber, least(l_quantity, l_discount * 100, CASE WHEN l_returnflag = 'R' THEN l_tax * 100 END) "
    "AS least_value FROM lineitem"
)
def least_of_list(spark, sf_dir):
    tax = F.when(F.col("l_returnflag") == "R", F.col("l_tax") * 100)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", a.smallest(["l_quantity", F.col("l_discount") * 100, tax]).alias("least_value")
    )


@registered(
    "SELECT o_orderkey, greatest(o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END) AS updated FROM orders"
)
def greatest_of_columns(spark, sf_dir):
    later = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return table(spark, sf_dir, "orders").select("o_orderkey", a.greatest("o_orderdate", later).alias("updated"))


@registered("SELECT o_custkey, count(o_orderkey) AS count_o_orderkey FROM orders GROUP BY o_custkey HAVING count(o_orderkey) > 12")
def having_comparison(spark, sf_dir):
    return a.having(table(spark, sf_dir, "orders"), ["o_custkey"], [("o_orderkey", "count", 12, ">")])


@registered(
    "WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) "
    "SELECT o_custkey, n, 'between' AS kind FROM n WHERE n >= 8 AND n <= 10 UNION ALL "
    "SELECT o_custkey, n, 'not between' FROM n WHERE n < 8 OR n > 10"
)
def having_between(spark, sf_dir):
    n = a.grouped(table(spark, sf_dir, "orders"), ["o_custkey"], n=("count", "o_orderkey"))
    kind = F.when(F.col("n").between(8, 10), "between").when(a.outside("n", 8, 10), "not between")
    return n.withColumn("kind", kind)


@registered(
    "WITH n AS (SELECT user_id, date_trunc('day', ts) AS day, max(CASE WHEN event_type = 'error' THEN value END) AS worst "
    "FROM events GROUP BY ALL) SELECT user_id, day, 'empty' AS kind FROM n WHERE worst IS NULL "
    "UNION ALL SELECT user_id, day, 'not empty' FROM n WHERE worst IS NOT NULL"
)
def having_null_test(spark, sf_dir):
    errors = table(spark, sf_dir, "events").select(
        "user_id",
        F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day"),
        F.when(F.col("event_type") == "error", F.col("value")).alias("value"),
    )
    empty = a.having(errors, ["user_id", "day"], [("value", "max", None, "notExists")])
    full = a.having(errors, ["user_id", "day"], [("value", "max", None, "exists")])
    return empty.withColumn("kind", F.lit("empty")).unionByName(full.withColumn("kind", F.lit("not empty"))).drop("max_value")


@registered("SELECT o_custkey, count(o_orderkey) AS count_o_orderkey FROM orders GROUP BY o_custkey HAVING count(o_orderkey) = 10")
def having_equality(spark, sf_dir):
    return a.having(table(spark, sf_dir, "orders"), ["o_custkey"], [("o_orderkey", "count", 10)])


@registered(
    "SELECT o_custkey, count(o_orderkey) AS count_o_orderkey, min(o_orderpriority) AS min_o_orderpriority FROM orders "
    "GROUP BY o_custkey HAVING count(o_orderkey) >= 14 OR min(o_orderpriority) IN ('3-MEDIUM', '4-NOT SPECIFIED')"
)
def aggregate_conditions(spark, sf_dir):
    conditions = [("o_orderkey", "count", 14, ">="), ("o_orderpriority", "min", ["3-MEDIUM", "4-NOT SPECIFIED"], "IN")]
    return a.having(table(spark, sf_dir, "orders"), ["o_custkey"], conditions, "OR")


@registered(
    "SELECT coalesce(o.revision, -1) AS association, p.p_partkey AS partkey, p.p_partkey AS revision, count(*) AS n FROM part p "
    "LEFT JOIN (SELECT p_partkey, p_partkey - p_size AS revision FROM part WHERE p_type = 'PROMO') o ON o.p_partkey = p.p_partkey "
    "JOIN lineitem ON l_partkey = p.p_partkey GROUP BY ALL"
)
def revision_group_by(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr("p_partkey AS partkey", "p_size", "p_type")
    overrides = part.filter("p_type = 'PROMO'").selectExpr("partkey", "partkey - p_size AS association")
    # Count the lines per part first: the join then is one row per part.
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("partkey")).agg(F.count(F.lit(1)).alias("lines"))
    joined = part.select("partkey", F.col("partkey").alias("revision")).join(overrides, "partkey", "left").join(lines, "partkey")
    keyed = joined.withColumn("association", F.coalesce("association", F.lit(-1)))
    return keyed.groupBy("association", "partkey", "revision").agg(F.sum("lines").alias("n"))


LONG_DOCS = "(SELECT * FROM documents WHERE n_chars > 9000)"


@registered(
    "WITH known AS (SELECT DISTINCT 'language' AS facet, lang AS value FROM documents UNION "
    "SELECT DISTINCT 'publisher__name', source FROM documents) SELECT facet, value, "
    f"(SELECT count(*) FROM {LONG_DOCS} d WHERE d.lang = value OR d.source = value) AS count FROM known"
)
def facet_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source", "n_chars")
    fields = {"language": "lang", "publisher__name": "source"}
    known = f.counts(docs, fields).select("facet", "value")
    return f.counts_for(docs.filter("n_chars > 9000"), fields, known)


SOME_PRIORITY = "(SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority FROM orders)"


@registered(
    f"WITH c AS (SELECT 'customer' AS facet, cast(o_custkey AS varchar) AS value, count(*) AS count FROM {SOME_PRIORITY} GROUP BY 2 "
    f"UNION ALL SELECT 'priority', priority, count(*) FROM {SOME_PRIORITY} GROUP BY 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY count DESC, value NULLS FIRST) AS nth FROM c WHERE count >= 2) "
    "SELECT facet, value, count FROM r WHERE nth <= 20"
)
def facet_options(spark, sf_dir):
    priority = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    counts = f.counts(table(spark, sf_dir, "orders"), {"customer": "o_custkey", "priority": priority})
    return f.with_options(counts, limit=20, min_count=2, missing=True)


@registered(
    "SELECT 'bucket' AS facet, value, count FROM (SELECT CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN '' "
    "ELSE json_extract_string(props, '$.k') END AS value, count(*) AS count FROM events GROUP BY 1) WHERE value <> ''"
)
def facet_without_empty(spark, sf_dir):
    bucket = F.when(F.col("event_type") == "view", "").when(
        F.col("event_type") != "error", F.get_json_object("props", "$.k")
    )
    return f.without_empty(f.counts(table(spark, sf_dir, "events"), {"bucket": bucket}))


@registered(
    "SELECT cast(v AS double) AS value, (SELECT count(*) FROM lineitem WHERE l_quantity = v) AS count "
    "FROM (SELECT unnest(generate_series(cast(min(l_quantity) AS bigint), "
    "cast(ceil(max(l_quantity) / 7) * 7 AS bigint), 7)) AS v FROM lineitem)"
)
def slider_histogram(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return f.slider(values, 7)


def order_facets(spark, sf_dir, active):
    """Status and priority counts of finished orders: status has one value left."""
    finished = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return f.marked(f.counts(finished, {"status": "o_orderstatus", "priority": "o_orderpriority"}), active)


@registered("SELECT 'priority' AS facet, o_orderpriority AS value, count(*) AS count, false AS active FROM orders WHERE o_orderstatus = 'F' GROUP BY 2")
def hide_only_item(spark, sf_dir):
    return f.hide_only_item(order_facets(spark, sf_dir, {}))


@registered(
    "SELECT 'priority' AS facet, o_orderpriority AS value, count(*) AS count, false AS active FROM orders "
    "WHERE o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH' GROUP BY 2"
)
def hide_active_items(spark, sf_dir):
    return f.hide_active(order_facets(spark, sf_dir, {"status": ["F"], "priority": ["2-HIGH"]}))


def place_hierarchy(spark, sf_dir):
    regions = table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) AS value", "cast(null AS string) AS parent")
    nations = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS value", "concat('r', n_regionkey) AS parent")
    return regions.unionByName(nations).withColumn("facet", F.lit("place"))


def place_facets(spark, sf_dir, condition, active):
    """Customer counts per nation and region, zero where the condition leaves none."""
    customer = table(spark, sf_dir, "customer").filter(condition)
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    per_nation = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    counted = nations.join(per_nation, "n_nationkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    leaves = counted.selectExpr("concat('n', n_nationkey) AS value", "concat('r', n_regionkey) AS parent", "n AS count", "2 AS level")
    tops = counted.groupBy(F.concat(F.lit("r"), "n_regionkey").alias("value")).agg(F.sum("n").alias("count"))
    tops = tops.withColumn("parent", F.lit(None).cast("string")).withColumn("level", F.lit(1))
    return f.marked(leaves.unionByName(tops).withColumn("facet", F.lit("place")), {"place": active})


def place_sql(condition: str, active: str = "''") -> str:
    chosen = f"(SELECT * FROM customer WHERE {condition})"
    return (
        "(SELECT 'n' || n_nationkey AS value, 'r' || n_regionkey AS parent, count(c_custkey) AS count, 2 AS level, "
        f"'n' || n_nationkey IN ({active}) AS active FROM nation LEFT JOIN {chosen} ON c_nationkey = n_nationkey "
        "GROUP BY n_nationkey, n_regionkey UNION ALL "
        f"SELECT 'r' || r_regionkey, NULL, count(c_custkey), 1, 'r' || r_regionkey IN ({active}) FROM region "
        f"JOIN nation ON n_regionkey = r_regionkey LEFT JOIN {chosen} ON c_nationkey = n_nationkey GROUP BY r_regionkey)"
    )


ASIA = "c_nationkey IN (2, 7, 12, 17, 22)"


@registered(
    f"SELECT value, parent, count FROM {place_sql(ASIA, chr(39) + 'n3' + chr(39))} WHERE value IN "
    "('n2', 'n7', 'n12', 'n17', 'n22', 'n3', 'r2', 'r3')"
)
def hide_non_narrowing(spark, sf_dir):
    asia = F.expr(ASIA)
    total = table(spark, sf_dir, "customer").filter(asia).count()
    facets = place_facets(spark, sf_dir, asia, ["n3"])
    return f.hide_non_narrowing(facets, total).select("value", "parent", "count")


@registered(f"SELECT value, parent, count FROM {place_sql('c_acctbal > 5000')} WHERE level = 2")
def deepest_level_only(spark, sf_dir):
    return f.deepest_only(place_facets(spark, sf_dir, "c_acctbal > 5000", [])).select("value", "parent", "count")


@registered(
    f"SELECT value, parent, count FROM {place_sql('c_nationkey IN (3, 4)')} WHERE count > 0 "
    f"OR parent IN ('r3', 'r4') OR parent IS NULL"
)
def show_siblings(spark, sf_dir):
    facets = place_facets(spark, sf_dir, "c_nationkey IN (3, 4)", ["n3"]).filter("count > 0")
    return f.show_siblings(facets, place_hierarchy(spark, sf_dir)).select("value", "parent", "count")


@registered(
    f"SELECT value, parent, count, active, 'tree' AS kind FROM {place_sql('c_acctbal > 0', chr(39) + 'n3' + chr(39))} "
    "WHERE value IN ('n3', 'r3') UNION ALL "
    f"SELECT value, parent, count, active, 'flat' FROM {place_sql('c_acctbal > 0', chr(39) + 'n3' + chr(39))} WHERE value = 'n3'"
)
def hide_inactive_siblings(spark, sf_dir):
    facets = place_facets(spark, sf_dir, "c_acctbal > 0", ["n3"])
    nested = f.hide_inactive_siblings(facets, place_hierarchy(spark, sf_dir)).withColumn("kind", F.lit("tree"))
    flat = f.hide_inactive_siblings(facets).withColumn("kind", F.lit("flat"))
    return nested.unionByName(flat).select("value", "parent", "count", "active", "kind")


DATE_LEVELS = " UNION ALL ".join(
    f"SELECT strftime(o_orderdate, '{pattern}') AS value, {parent} AS parent, count(*) AS count FROM orders GROUP BY ALL"
    for pattern, parent in (
        ("%Y-%m-%d", "strftime(o_orderdate, '%Y-%m')"),
        ("%Y-%m", "strftime(o_orderdate, '%Y')"),
        ("%Y", "NULL"),
    )
)


@registered(DATE_LEVELS)
def date_hierarchy(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return f.date_levels(days, "day", 3)


@registered(
    f"WITH v AS ({DATE_LEVELS}), "
    "m AS (SELECT parent, '\"children\":[' || string_agg('{\"value\":\"' || value || '\",\"count\":' || count || '}', ',' ORDER BY value) || ']' AS kids "
    "FROM v WHERE length(value) = 10 GROUP BY parent), "
    "y AS (SELECT v.parent, '\"children\":[' || string_agg('{\"value\":\"' || value || '\",\"count\":' || count || "
    "CASE WHEN value = '1997-03' THEN ',\"active\":\"true\"' ELSE '' END || ',' || kids || '}', ',' ORDER BY value) || ']' AS kids "
    "FROM v JOIN m ON m.parent = value WHERE length(value) = 7 GROUP BY v.parent) "
    "SELECT value, '{\"value\":\"' || value || '\",\"count\":' || count || ',' || kids || '}' AS tree FROM v JOIN y ON y.parent = value"
)
def facet_tree(spark, sf_dir):
    return f.tree(f.marked(order_days(spark, sf_dir), {"date": ["1997-03"]}).withColumn("label", F.col("value")))


def order_days(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return f.date_levels(days, "day", 3).withColumn("facet", F.lit("date"))


# The row of 1996 is left out, so that its months stand at the top.
@registered(
    f"WITH v AS (SELECT * FROM ({DATE_LEVELS}) WHERE value <> '1996'), "
    'n AS (SELECT *, row_number() OVER (ORDER BY value) AS "left" FROM v) '
    "SELECT n.value, n.parent, n.count, length(n.value) // 3 - CASE WHEN n.value LIKE '1996%' THEN 1 ELSE 0 END AS depth, "
    'n."left", n."left" + count(*) - 1 AS "right", cast(sum(d.count) AS bigint) AS subtree '
    "FROM n JOIN v d ON starts_with(d.value, n.value) GROUP BY n.value, n.parent, n.count, n.\"left\""
)
def facet_tree_rows(spark, sf_dir):
    return f.tree_rows(order_days(spark, sf_dir).filter("value <> '1996'")).drop("facet")


@registered(
    "SELECT 'priority' AS facet, '1-URGENT, 2-HIGH' AS selected, count(*) AS total FROM orders "
    "WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') "
    "UNION ALL SELECT 'status', 'F', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')"
)
def facet_summary(spark, sf_dir):
    active = {"status": ["F"], "priority": ["1-URGENT", "2-HIGH"]}
    total = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')").count()
    return f.summary(order_facets(spark, sf_dir, active), total)


@registered("SELECT substring(p_name, 1, 1) AS glossary, count(*) AS n FROM part GROUP BY 1 ORDER BY 1 LIMIT 25")
def argument_summary(spark, sf_dir):
    return a.glossary(table(spark, sf_dir, "part"), "p_name")


@registered(
    "SELECT count(*) FILTER (event_type = 'signup') AS created, count(*) FILTER (event_type = 'purchase') AS updated, "
    "count(*) FILTER (event_type IN ('error', 'click')) AS failed, count(*) AS processed FROM events"
)
def harvest_run_counters(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    status = F.when(F.col("event_type") == "signup", "NEW").when(F.col("event_type") == "purchase", "UPDATED")
    load = events.filter("event_type <> 'click'").select(
        "id", F.when(F.col("event_type") == "error", "FAILURE").otherwise(F.coalesce(status, F.lit("UNCHANGED"))).alias("status")
    )
    transform = events.select("id", F.when(F.col("event_type") == "click", "FAILURE").otherwise("OK").alias("status"))
    return a.run_counters(load, transform)


COUNTERS = (
    "(SELECT json_extract_string(props, '$.k') AS item, count(*) AS totalcount, "
    "count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS daycount, max(ts) AS \"timestamp\" FROM events GROUP BY 1)"
)


@registered(
    " UNION ALL ".join(
        f"(SELECT item, '{order}' AS \"order\", (SELECT max(totalcount) FROM {COUNTERS}) AS highest FROM {COUNTERS} "
        f"ORDER BY \"{order}\" DESC, item LIMIT 5)"
        for order in ("totalcount", "daycount", "timestamp")
    )
)
def view_counters(spark, sf_dir):
    views = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("item"), "ts")
    today = F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz")
    counters = cut(a.view_counters(views, "item", "ts", today), "counters")
    highest = counters.agg(F.max("totalcount")).first()[0]
    parts = [a.top_items(counters, "item", order) for order in ("totalcount", "daycount", "timestamp")]
    tops = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return tops.withColumn("highest", F.lit(highest).cast("bigint"))


@registered(
    "SELECT c_custkey AS custkey, coalesce((SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'), "
    "(SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')) AS revision FROM customer"
)
def latest_or_published(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey AS custkey", "o_orderkey AS revision", "o_orderstatus")
    latest = j.latest(orders.filter("o_orderstatus = 'P'"), ["custkey"], ["revision"])
    published = j.latest(orders.filter("o_orderstatus = 'F'"), ["custkey"], ["revision"])
    items = table(spark, sf_dir, "customer").selectExpr("c_custkey AS custkey")
    return a.latest_or_published(items, latest, published, "custkey", "revision")
