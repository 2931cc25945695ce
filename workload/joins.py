"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark import scale
from tabulark.operators import joins as j
from tabulark.plans import spec
from tabulark.scratch import cut
from workload import registered, table


def customers(spark, sf_dir, *columns):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), *columns)


def orders(spark, sf_dir, *columns):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", *columns)


@registered("SELECT o_custkey AS custkey, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_equi_join(spark, sf_dir):
    return j.inner(orders(spark, sf_dir), customers(spark, sf_dir, "c_name"), ["custkey"])


@registered("SELECT c_custkey AS custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def left_outer_join(spark, sf_dir):
    return j.with_children(customers(spark, sf_dir, "c_name"), orders(spark, sf_dir), "custkey")


@registered(
    "SELECT c_custkey AS custkey, o_orderkey AS orderkey, l_partkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey "
    "JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"
)
def left_join_then_inner(spark, sf_dir):
    listed = j.with_children(customers(spark, sf_dir), orders(spark, sf_dir), "custkey")
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    lines = lines.select(F.col("l_orderkey").alias("orderkey"), "l_partkey")
    return j.inner(lines, listed.withColumnRenamed("o_orderkey", "orderkey"), ["orderkey"])


@registered(
    "SELECT p_partkey AS partkey, p_name, l_orderkey FROM part LEFT JOIN lineitem ON l_partkey = p_partkey "
    "WHERE l_orderkey IS NOT NULL AND p_size < 25"
)
def left_join_not_null(spark, sf_dir):
    parts = table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("partkey"), "p_name")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("partkey"), "l_orderkey")
    return j.with_children(parts, lines, "partkey").filter(F.col("l_orderkey").isNotNull())


@registered(
    "WITH pairs AS (SELECT l_partkey, l_suppkey, count(*) AS n_lines FROM lineitem GROUP BY l_partkey, l_suppkey) "
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n_lines FROM lineitem JOIN pairs USING (l_partkey, l_suppkey)"
)
def composite_key_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    pairs = lines.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n_lines"))
    return j.inner(lines, pairs, ["l_partkey", "l_suppkey"])


@registered(
    "SELECT o_custkey AS custkey, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_nationkey = 7"
)
def join_with_extra_predicate(spark, sf_dir):
    seventh = customers(spark, sf_dir, "c_name", "c_nationkey").filter(F.col("c_nationkey") == 7)
    return j.inner(orders(spark, sf_dir), seventh.drop("c_nationkey"), ["custkey"])


EVENT_REF = (
    "(SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'none' WHEN 'click' THEN '0' || json_extract_string(props, '$.k') "
    "ELSE json_extract_string(props, '$.k') END AS ref FROM events)"
)


@registered(
    f"SELECT event_id, ref, c_custkey, c_name, 'number' AS cast_to FROM {EVENT_REF} JOIN customer ON try_cast(ref AS bigint) = c_custkey "
    f"WHERE event_type <> 'view' UNION ALL SELECT event_id, ref, c_custkey, c_name, 'text' FROM {EVENT_REF} "
    "JOIN customer ON ref = cast(c_custkey AS varchar)"
)
def cast_key_join(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    ref = F.when(F.col("event_type") == "error", "none").when(F.col("event_type") == "click", F.concat(F.lit("0"), k)).otherwise(k)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", ref.alias("ref"))
    lookup = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    numbers = j.on_text_key(events, "ref", lookup, "c_custkey", extra=F.col("event_type") != "view")
    texts = j.on_text_key(events, "ref", lookup, "c_custkey", as_text=True)
    both = numbers.withColumn("cast_to", F.lit("number")).unionByName(texts.withColumn("cast_to", F.lit("text")))
    return both.drop("event_type")


LATEST = (
    "(SELECT o_custkey AS custkey, o_orderkey, o_orderdate, row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)"
)


@registered(
    f"WITH r AS (SELECT * FROM {LATEST}) SELECT r.custkey, r.o_orderkey, c.o_orderkey AS current_revision "
    "FROM r JOIN r c ON c.custkey = r.custkey AND c.rn = 1 AND c.o_orderkey <> r.o_orderkey"
)
def theta_join(spark, sf_dir):
    revisions = orders(spark, sf_dir, "o_orderdate")
    current = j.latest(revisions, ["custkey"], ["o_orderdate", "o_orderkey"])
    return j.other_revisions(revisions, current, "custkey", "o_orderkey").drop("o_orderdate")


@registered(
    "SELECT o.o_custkey AS custkey, o_orderkey, last_order FROM orders o JOIN "
    "(SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey) m ON m.o_custkey = o.o_custkey"
)
def join_to_aggregate(spark, sf_dir):
    return j.with_maximum(orders(spark, sf_dir), ["custkey"], "o_orderkey", "last_order")


OVERRIDES = "(SELECT p_partkey, p_partkey - p_size AS revision FROM part WHERE p_partkey >= p_size AND p_type = 'PROMO')"


@registered(
    "SELECT b.p_partkey AS partkey, b.p_name AS name, r.p_partkey AS revision_key, r.p_retailprice AS price FROM part b "
    f"LEFT JOIN {OVERRIDES} o ON o.p_partkey = b.p_partkey JOIN part r ON r.p_partkey = coalesce(o.revision, b.p_partkey)"
)
def join_on_override(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    base = part.select(F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name"), F.col("p_partkey").alias("revision"))
    overrides = part.filter("p_partkey >= p_size AND p_type = 'PROMO'").selectExpr(
        "p_partkey AS partkey", "p_partkey - p_size AS revision"
    )
    revisions = part.selectExpr("p_partkey AS revision_key", "p_retailprice AS price")
    return j.on_override(base, overrides, "partkey", "revision", revisions, "revision_key").drop("revision")


@registered(
    "SELECT c_custkey AS custkey, c_name FROM customer WHERE c_nationkey = 3 OR EXISTS "
    "(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)"
)
def exists_or_local(spark, sf_dir):
    large = orders(spark, sf_dir, "o_totalprice").filter("o_totalprice > 450000")
    people = customers(spark, sf_dir, "c_name", "c_nationkey")
    return j.exists_or(people, large, "custkey", F.col("c_nationkey") == 3).drop("c_nationkey")


@registered(
    "SELECT c_custkey AS custkey, c_name FROM customer WHERE NOT EXISTS "
    "(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"
)
def not_exists_anti_join(spark, sf_dir):
    open_orders = orders(spark, sf_dir, "o_orderstatus").filter("o_orderstatus = 'P'")
    return j.not_exists(customers(spark, sf_dir, "c_name"), open_orders, "custkey")


@registered(
    "SELECT c_custkey AS custkey, c_name FROM customer WHERE "
    "(SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey) > 3"
)
def correlated_count(spark, sf_dir):
    named = orders(spark, sf_dir, "o_orderpriority")
    return j.with_distinct_count(customers(spark, sf_dir, "c_name"), named, "custkey", "o_orderpriority", 3)


@registered(
    "SELECT o_orderkey AS order_id, c_name AS customer, c_mktsegment AS segment FROM orders "
    "JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'FURNITURE'"
)
def implied_join(spark, sf_dir):
    join = {"resource": "customer", "alias": "customer", "on": "o_custkey = c_custkey"}
    return spec.run(
        {"orders": table(spark, sf_dir, "orders"), "customer": table(spark, sf_dir, "customer")},
        {
            "resource": "orders",
            "joins": [join, join],
            "conditions": {"field": "c_mktsegment", "value": "FURNITURE"},
            "fields": {"order_id": "o_orderkey", "customer": "c_name", "segment": "c_mktsegment"},
            "all_rows": True,
        },
    )


@registered(
    "SELECT c_name AS customer, home.n_name AS home, seat.n_name AS seat, count(*) AS n_lines FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation home ON c_nationkey = home.n_nationkey "
    "JOIN supplier ON l_suppkey = s_suppkey JOIN nation seat ON s_nationkey = seat.n_nationkey "
    "WHERE home.n_name <> seat.n_name AND c_mktsegment = 'FURNITURE' GROUP BY ALL"
)
def implied_joins_by_alias(spark, sf_dir):
    """One table by two aliases, and relations that only other relations name; the unnamed relation is not joined."""
    relations = {
        "home": {"resource": "nation", "on": "c.c_nationkey = home.n_nationkey"},
        "seat": {"resource": "nation", "on": "s.s_nationkey = seat.n_nationkey"},
        "s": {"resource": "supplier", "on": "l.l_suppkey = s.s_suppkey"},
        "c": {"resource": "customer", "on": "o.o_custkey = c.c_custkey"},
        "o": {"resource": "orders", "on": "l.l_orderkey = o.o_orderkey"},
        "p": {"resource": "part", "on": "l.l_partkey = p.p_partkey"},
    }
    rows = spec.run(
        {name: table(spark, sf_dir, name) for name in ("lineitem", "orders", "customer", "supplier", "nation", "part")},
        {
            "resource": "lineitem",
            "alias": "l",
            "relations": relations,
            "conditions": {"field": "c.c_mktsegment", "value": "FURNITURE"},
            "fields": {"customer": "c.c_name", "home": "home.n_name", "seat": "seat.n_name"},
            "all_rows": True,
        },
    )
    return rows.where("home <> seat").groupBy("customer", "home", "seat").agg(F.count(F.lit(1)).alias("n_lines"))


@registered(
    f"SELECT c_custkey AS custkey, c_name, o_orderkey, o_orderdate FROM customer LEFT JOIN {LATEST} l "
    "ON l.custkey = c_custkey AND rn = 1"
)
def representative_row(spark, sf_dir):
    people = customers(spark, sf_dir, "c_name")
    return j.representative(people, orders(spark, sf_dir, "o_orderdate"), "custkey", ["o_orderdate", "o_orderkey"])


@registered(
    "SELECT l_orderkey, l_linenumber, l_suppkey, destination FROM lineitem JOIN "
    "(SELECT s_suppkey AS source, 'node:' || s_suppkey AS destination FROM supplier WHERE s_nationkey < 15 "
    "UNION SELECT s_suppkey, 'user:' || s_suppkey FROM supplier WHERE s_nationkey > 10) ON l_suppkey = source"
)
def id_map_lookup(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    nodes = supplier.filter("s_nationkey < 15").selectExpr("s_suppkey AS l_suppkey", "concat('node:', s_suppkey) AS destination")
    users = supplier.filter("s_nationkey > 10").selectExpr("s_suppkey AS l_suppkey", "concat('user:', s_suppkey) AS destination")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return j.looked_up(lines, [nodes, users], "l_suppkey", "destination")


@registered(
    "SELECT l_orderkey, l_linenumber, l_partkey, (SELECT p_partkey FROM part WHERE p_partkey = l_partkey AND p_size > 20) "
    "AS existing FROM lineitem"
)
def existence_lookup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    large = table(spark, sf_dir, "part").filter("p_size > 20")
    return j.existing(lines, "l_partkey", large, "p_partkey", "existing")


@registered(
    "SELECT DISTINCT l_partkey AS partkey, l_orderkey AS orderkey FROM lineitem "
    "WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7')"
)
def reverse_reference_lookup(spark, sf_dir):
    references = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS partkey", "l_orderkey AS orderkey")
    wanted = table(spark, sf_dir, "part").filter("p_brand = 'Brand#7'").selectExpr("p_partkey AS partkey")
    return j.referencers(references, wanted, "partkey", "orderkey")


@registered(
    "SELECT DISTINCT 'part' AS property, l_partkey AS reference FROM lineitem WHERE l_returnflag = 'N' "
    "AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O')"
)
def orphan_references(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.lit("part").alias("property"), F.col("l_partkey").alias("reference"), "l_returnflag", "l_linestatus"
    )
    current = lines.filter("l_returnflag = 'A' AND l_linestatus = 'O'")
    return j.orphans(lines.filter("l_returnflag = 'N'"), current, ["property", "reference"])


@registered(
    "WITH placed AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey "
    "ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS place FROM lineitem), "
    "chunks AS (SELECT l_orderkey, cast(place // 1000 AS integer) AS chunk, "
    "string_agg(l_linenumber || ':' || l_partkey, ' ' ORDER BY place) AS lines FROM placed GROUP BY ALL) "
    "SELECT o_orderkey AS orderkey, o_orderstatus, chunk, lines FROM orders LEFT JOIN chunks ON l_orderkey = o_orderkey"
)
def children_into_array(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "orderkey")
    lines = lines.select("orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_orderstatus")
    item = F.concat_ws(":", "l_linenumber", "l_partkey")
    order_by = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    nested = j.children_folded(parents, lines, "orderkey", order_by, item, "lines", 1000)
    return nested.withColumn("lines", F.array_join("lines", " "))


TYPES = ["signup", "purchase", "view", "click", "error"]


@registered(
    "SELECT user_id, "
    + ", ".join(f"arg_max(CASE WHEN event_type = '{t}' THEN value END, CASE WHEN event_type = '{t}' THEN event_id END) AS \"{t}\"" for t in TYPES)
    + " FROM events GROUP BY user_id"
)
def attribute_rows_to_columns(spark, sf_dir):
    return j.attributes_to_columns(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["event_id"], TYPES)


@registered(
    "WITH pairs AS (SELECT p_partkey, unnest([p_type, p_brand]) AS tag FROM part), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY p_partkey) - 1 AS place FROM pairs) "
    "SELECT tag, cast(place // 100 AS integer) AS chunk, string_agg(cast(p_partkey AS varchar), ',' ORDER BY place) AS items "
    "FROM placed GROUP BY ALL"
)
def inverted_comma_list(spark, sf_dir):
    listed = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit(","), "p_type", F.lit(","), "p_brand", F.lit(",")).alias("tags")
    )
    pairs = j.inverted(listed, "p_partkey", "tags", "tag")
    lists = scale.folded(pairs, ["tag"], ["p_partkey"], F.col("p_partkey").cast("string"), "items", size=100)
    return lists.withColumn("items", F.array_join("items", ","))


@registered(
    "SELECT conv_id, turn, role, min(turn) OVER (PARTITION BY conv_id) AS source, "
    "turn = min(turn) OVER (PARTITION BY conv_id) AS is_source FROM conversations"
)
def first_row_as_source(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return j.pointed_at_source(turns, "conv_id", "turn")


@registered(
    "SELECT c_custkey, 'down' AS way FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "WHERE n_regionkey = 2 UNION ALL "
    "SELECT c_custkey, 'down 1' FROM customer WHERE false UNION ALL "
    "SELECT c_custkey, 'up' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7"
)
def hierarchy_depth_match(spark, sf_dir):
    regions = table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) AS term", "cast(null AS string) AS parent")
    nations = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS term", "concat('r', n_regionkey) AS parent")
    tag = F.concat_ws("-", F.concat(F.lit("n"), "c_nationkey"), "c_mktsegment")
    tagged = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", tag.alias("term"))
    segments = tagged.select("term", F.concat(F.lit("n"), "c_nationkey").alias("parent")).distinct()
    # Every level of the walk reads it: make the terms from the customers once.
    hierarchy = cut(regions.unionByName(nations).unionByName(segments), "hierarchy")
    parts = []
    for way, root, depth in (("down", "r2", 50), ("down 1", "r2", 1), ("up", "n7-BUILDING", -10)):
        roots = hierarchy.filter(F.col("term") == root)
        terms = j.terms_to_depth(hierarchy, roots, depth)
        parts.append(scale.lookup_join(tagged, terms, ["term"], "left_semi").select("c_custkey", F.lit(way).alias("way")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@registered(
    "SELECT c_custkey AS custkey, c_name, coalesce(enabled, true) AS enabled FROM customer LEFT JOIN "
    "(SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS enabled FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"
)
def default_when_missing(spark, sf_dir):
    settings = orders(spark, sf_dir, "o_orderstatus").groupBy("custkey").agg(
        F.bool_and(F.col("o_orderstatus") != "P").alias("enabled")
    )
    return j.with_default(customers(spark, sf_dir, "c_name"), settings, "custkey", "enabled", True)


@registered(
    "SELECT event_id, user_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events "
    "UNION ALL SELECT event_id, user_id, 'type', event_type FROM events"
)
def nested_map_to_rows(spark, sf_dir):
    return j.map_rows(event_settings(spark, sf_dir), ["event_id", "user_id"], "settings")


@registered(
    "WITH m AS (SELECT event_id, user_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events "
    "UNION ALL SELECT event_id, user_id, 'type', event_type FROM events) "
    "SELECT user_id, key, arg_max(value, event_id) AS value FROM m GROUP BY user_id, key"
)
def nested_map_last_row(spark, sf_dir):
    rows = j.map_rows(event_settings(spark, sf_dir), ["event_id", "user_id"], "settings")
    return j.latest(rows, ["user_id", "key"], ["event_id"]).drop("event_id")


def event_settings(spark, sf_dir):
    settings = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", "user_id", settings.alias("settings"))


@registered(
    "SELECT c_custkey, 'any' AS kind, coalesce(n_name, cast(c_nationkey AS varchar)) AS label FROM customer "
    "LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey UNION ALL "
    "SELECT c_custkey, 'labelled', n_name FROM customer JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey"
)
def label_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    labels = table(spark, sf_dir, "nation").filter("n_regionkey < 3").selectExpr("n_nationkey AS nation", "n_name AS label")
    every = j.labelled(rows, "nation", labels, "label").withColumn("kind", F.lit("any"))
    known = j.labelled(rows, "nation", labels, "label", required=True).withColumn("kind", F.lit("labelled"))
    return every.unionByName(known).drop("nation")
