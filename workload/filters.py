"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark import scale
from tabulark.operators import keys, predicates as p
from tabulark.plans import spec
from workload import registered, table


def orders_of(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def sometimes_null(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )


MAYBE = "(SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"


@registered(
    "SELECT o_custkey, count(*) AS n_orders, cast(sum(cast(round(o_totalprice * 100) AS bigint)) AS bigint) AS total_cents "
    "FROM orders WHERE o_orderstatus = 'O' AND (o_totalprice > 100000 OR o_orderpriority = '1-URGENT') "
    "GROUP BY o_custkey HAVING count(*) >= 3 ORDER BY total_cents DESC, o_custkey LIMIT 100 OFFSET 5"
)
def datastore_query(spark, sf_dir):
    return spec.run(
        {"orders": table(spark, sf_dir, "orders")},
        {
            "resource": "orders",
            "conditions": {
                "group": "AND",
                "conditions": [
                    {"field": "o_orderstatus", "value": "O"},
                    {
                        "group": "OR",
                        "conditions": [
                            {"field": "o_totalprice", "value": 100000, "op": ">"},
                            {"field": "o_orderpriority", "value": "1-URGENT"},
                        ],
                    },
                ],
            },
            "group_by": ["o_custkey"],
            "aggregates": {
                "n_orders": "count(*)",
                "total_cents": "sum(cast(round(o_totalprice * 100) AS bigint))",
            },
            "having": {"field": "n_orders", "value": 3, "op": ">="},
            "sorts": [("total_cents", "desc"), ("o_custkey", "asc")],
            "limit": 100,
            "offset": 5,
        },
    )


@registered("SELECT o_orderkey AS order_id, o_totalprice AS price FROM orders")
def field_projection(spark, sf_dir):
    return spec.run(
        {"orders": table(spark, sf_dir, "orders")},
        {"resource": "orders", "fields": {"order_id": "o_orderkey", "price": "o_totalprice"}, "all_rows": True},
    )


@registered("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def expression_column(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_extendedprice * (1 - l_discount) AS net"
    )


@registered(
    "SELECT o_orderkey, o_totalprice * 3 AS scaled, c_name FROM orders JOIN customer ON o_custkey = c_custkey "
    "WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'"
)
def rewrite_by_tag(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    rules = {
        "with_customer": lambda df: scale.salted_join(df, customer, ["o_custkey"]).filter("c_mktsegment = 'BUILDING'"),
        "finished_only": lambda df: df.filter("o_orderstatus = 'F'"),
        "triple": lambda df: df.withColumn("scaled", F.col("o_totalprice") * 3),
        "few_fields": lambda df: df.select("o_orderkey", "scaled", "c_name"),
        "unused": lambda df: df.limit(0),
    }
    tags = ["with_customer", "finished_only", "triple", "few_fields"]
    return spec.altered(table(spark, sf_dir, "orders"), tags, rules)


@registered(
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND l_discount <> 0.05 "
    "AND l_tax <= 0.04 AND l_extendedprice > 20000 AND l_linestatus = 'O'"
)
def comparison_predicates(spark, sf_dir):
    conditions = [
        ("l_quantity", 10, ">="),
        ("l_quantity", 40, "<"),
        ("l_discount", 0.05, "<>"),
        ("l_tax", 0.04, "<="),
        ("l_extendedprice", 20000, ">"),
        ("l_linestatus", "O", "="),
    ]
    rows = table(spark, sf_dir, "lineitem").filter(p.group("AND", [p.condition(*c) for c in conditions]))
    return rows.select("l_orderkey", "l_linenumber")


@registered(
    "SELECT o_orderkey, 'equal' AS op FROM orders WHERE o_orderstatus = 'F' "
    "UNION ALL SELECT o_orderkey, 'not equal' FROM orders WHERE o_orderstatus <> 'F'"
)
def equality_filter(spark, sf_dir):
    orders = orders_of(spark, sf_dir)
    equal = orders.filter(p.condition("o_orderstatus", "F")).select("o_orderkey", F.lit("equal").alias("op"))
    other = orders.filter(p.condition("o_orderstatus", "F", "!=")).select("o_orderkey", F.lit("not equal").alias("op"))
    return equal.unionByName(other)


@registered(
    "SELECT o_orderkey, 'in' AS op FROM orders WHERE o_orderstatus IN ('F', 'P') "
    "UNION ALL SELECT o_orderkey, 'not in' FROM orders WHERE o_orderstatus NOT IN ('F', 'P') "
    "UNION ALL SELECT o_orderkey, 'not in with null' FROM orders WHERE o_orderstatus NOT IN ('F', NULL)"
)
def in_list(spark, sf_dir):
    orders = orders_of(spark, sf_dir)
    parts = [
        orders.filter(p.condition("o_orderstatus", values, op)).select("o_orderkey", F.lit(name).alias("op"))
        for name, values, op in (
            ("in", ["F", "P"], "IN"),
            ("not in", ["F", "P"], "NOT IN"),
            ("not in with null", ["F", None], "NOT IN"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@registered(
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount NOT BETWEEN 0.02 AND 0.06"
)
def between(spark, sf_dir):
    kept = p.condition("l_quantity", (10, 20), "BETWEEN") & p.condition("l_discount", (0.02, 0.06), "NOT BETWEEN")
    return table(spark, sf_dir, "lineitem").filter(kept).select("l_orderkey", "l_linenumber")


@registered(
    "SELECT c_custkey, 'from' AS bound FROM customer WHERE c_name >= 'Customer#000000900' "
    "UNION ALL SELECT c_custkey, 'not from' FROM customer WHERE c_name < 'Customer#000000900' "
    "UNION ALL SELECT c_custkey, 'to' FROM customer WHERE c_name <= 'Customer#000000100' "
    "UNION ALL SELECT c_custkey, 'not to' FROM customer WHERE c_name > 'Customer#000000100' "
    "UNION ALL SELECT c_custkey, 'both' FROM customer WHERE c_name BETWEEN 'Customer#000000100' AND 'Customer#000000900' "
    "UNION ALL SELECT c_custkey, 'neither' FROM customer "
    "WHERE c_name NOT BETWEEN 'Customer#000000100' AND 'Customer#000000900'"
)
def half_open_text_range(spark, sf_dir):
    low, high = "Customer#000000100", "Customer#000000900"
    ranges = {
        "from": p.text_range("c_name", low=high),
        "not from": p.text_range("c_name", low=high, negate=True),
        "to": p.text_range("c_name", high=low),
        "not to": p.text_range("c_name", high=low, negate=True),
        "both": p.text_range("c_name", low, high),
        "neither": p.text_range("c_name", low, high, negate=True),
    }
    # One scan: each row lists the ranges it falls into.
    hits = F.array_compact(F.array(*[F.when(kept, F.lit(name)) for name, kept in ranges.items()]))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(hits).alias("bound"))


@registered(f"SELECT event_id, value IS NULL AS is_missing, value IS NOT NULL AS is_present FROM {MAYBE}")
def null_tests(spark, sf_dir):
    return sometimes_null(spark, sf_dir).select(
        "event_id",
        p.condition("value", op="IS NULL").alias("is_missing"),
        p.condition("value", op="IS NOT NULL").alias("is_present"),
    )


@registered(
    f"SELECT event_id, 'none' AS kind FROM {MAYBE} WHERE value IS NULL "
    f"UNION ALL SELECT event_id, 'some' FROM {MAYBE} WHERE value IS NOT NULL"
)
def null_value_condition(spark, sf_dir):
    events = sometimes_null(spark, sf_dir)
    none = events.filter(p.condition("value", None)).select("event_id", F.lit("none").alias("kind"))
    some = events.filter(p.condition("value", None, "<>")).select("event_id", F.lit("some").alias("kind"))
    return none.unionByName(some)


@registered("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' OR p_type LIKE '%AR%'")
def like_pattern(spark, sf_dir):
    kept = p.condition("p_name", "small%", "LIKE") | p.condition("p_type", "%AR%", "LIKE")
    return table(spark, sf_dir, "part").filter(kept).select("p_partkey", "p_name")


@registered(
    "SELECT doc_id, contains(text, 'The') AS exact, contains(lower(text), 'the th') AS folded FROM documents "
    "WHERE contains(text, 'The') OR contains(lower(text), 'the th')"
)
def contains_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        p.contains_text("text", "The").alias("exact"),
        p.contains_text("text", "The Th", case_sensitive=False).alias("folded"),
    )
    return docs.filter("exact OR folded")


@registered(
    "SELECT CASE WHEN contains(p_name, ',') THEN '\"' || p_name || ' (' || p_partkey || ')\"' "
    "ELSE p_name || ' (' || p_partkey || ')' END AS value, p_name AS label FROM part "
    "WHERE contains(p_name, 'olt') ORDER BY p_name, p_partkey LIMIT 10"
)
def autocomplete_match(spark, sf_dir):
    return keys.autocomplete(table(spark, sf_dir, "part"), "p_name", "p_partkey", "olt")


@registered(
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'A' AND l_quantity < 5) "
    "OR (l_returnflag = 'R' AND (l_discount = 0.1 OR l_tax = 0.08))"
)
def condition_groups(spark, sf_dir):
    tree = {
        "group": "OR",
        "conditions": [
            {"conditions": [{"field": "l_returnflag", "value": "A"}, {"field": "l_quantity", "value": 5, "op": "<"}]},
            {
                "conditions": [
                    {"field": "l_returnflag", "value": "R"},
                    {
                        "group": "OR",
                        "conditions": [{"field": "l_discount", "value": 0.1}, {"field": "l_tax", "value": 0.08}],
                    },
                ]
            },
        ],
    }
    return table(spark, sf_dir, "lineitem").filter(p.from_tree(tree)).select("l_orderkey", "l_linenumber")


@registered("SELECT o_orderkey FROM orders WHERE false")
def always_false(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(p.always_false()).select("o_orderkey")


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderpriority = '2-HIGH'")
def raw_predicate(spark, sf_dir):
    return spark.sql(
        "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > :floor AND o_orderpriority = :priority",
        args={"floor": 300000, "priority": "2-HIGH"},
        orders=table(spark, sf_dir, "orders"),
    )


@registered(
    "SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') t "
    "WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')"
)
def subquery_sources(spark, sf_dir):
    open_orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    wanted = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return scale.salted_join(open_orders, wanted, ["o_custkey"], "left_semi").select("o_orderkey", "o_totalprice")


@registered(
    "WITH n AS (SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN lower(c_mktsegment) ELSE c_mktsegment END AS label "
    "FROM customer) SELECT label, count(*) AS n FROM n GROUP BY label"
)
def case_sensitive_identity(spark, sf_dir):
    label = F.when(F.col("c_nationkey") < 12, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


FLAGS = (
    "(SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '' ELSE event_type END AS flag FROM events)"
)


@registered(
    f"SELECT event_id, 'true' AS kind FROM {FLAGS} WHERE flag <> '' "
    f"UNION ALL SELECT event_id, 'false' FROM {FLAGS} WHERE flag = '' "
    f"UNION ALL SELECT event_id, 'false or null' FROM {FLAGS} WHERE flag = '' OR flag IS NULL"
)
def text_boolean_filter(spark, sf_dir):
    flag = F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "error", F.col("event_type"))
    kinds = {
        "true": p.text_flag("flag", True),
        "false": p.text_flag("flag", False),
        "false or null": p.text_flag("flag", False, accept_null=True),
    }
    hits = F.array_compact(F.array(*[F.when(kept, F.lit(name)) for name, kept in kinds.items()]))
    events = table(spark, sf_dir, "events").select("event_id", flag.alias("flag"))
    return events.select("event_id", F.explode(hits).alias("kind"))


@registered(
    "WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id END AS user_id FROM events) "
    "SELECT event_id, 'mine' AS kind FROM e WHERE user_id = 7 "
    "UNION ALL SELECT event_id, 'other' FROM e WHERE user_id <> 7 OR user_id IS NULL"
)
def current_value_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id")
    )
    mine = events.filter(p.is_current("user_id", 7)).select("event_id", F.lit("mine").alias("kind"))
    other = events.filter(p.is_current("user_id", 7, wanted=False, accept_null=True))
    return mine.unionByName(other.select("event_id", F.lit("other").alias("kind")))


@registered(
    "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')"
)
def is_all_of(spark, sf_dir):
    return p.multi_value(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ["A", "R"], "and")


@registered(
    "SELECT l_orderkey, 'one of' AS kind FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag IN ('A', 'R')) "
    "UNION ALL SELECT l_orderkey, 'none of' FROM lineitem GROUP BY l_orderkey HAVING NOT bool_or(l_returnflag IN ('A', 'R')) "
    "UNION ALL SELECT DISTINCT l_orderkey, 'no filter' FROM lineitem"
)
def is_one_or_none_of(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    boxes = {"A": "A", "N": 0, "R": "R"}
    parts = [
        p.multi_value(lines, "l_orderkey", "l_returnflag", values, op).withColumn("kind", F.lit(kind))
        for kind, values, op in (("one of", boxes, "or"), ("none of", boxes, "not"), ("no filter", {"A": 0}, "or"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@registered(
    "SELECT o_orderkey, 'empty' AS kind FROM orders UNION ALL SELECT o_orderkey, 'given' FROM orders WHERE o_orderstatus = 'P'"
)
def empty_value_filter(spark, sf_dir):
    orders = orders_of(spark, sf_dir)
    every = p.optional_equals(orders, "o_orderstatus", "").select("o_orderkey", F.lit("empty").alias("kind"))
    some = p.optional_equals(orders, "o_orderstatus", "P").select("o_orderkey", F.lit("given").alias("kind"))
    return every.unionByName(some)


@registered("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_custkey = 42")
def published_or_own(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    kept = p.published_or_own(status, F.col("o_custkey"), user=42, may_view_own=True, bypass=False)
    return table(spark, sf_dir, "orders").filter(kept).select("o_orderkey")


@registered(
    "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND ((c_nationkey = 3 AND c_mktsegment = 'BUILDING') "
    "OR (c_nationkey = 7 AND c_mktsegment = 'HOUSEHOLD'))"
)
def row_grant_filter(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    grants = customer.select(
        "c_custkey",
        F.col("c_nationkey").alias("gid"),
        F.col("c_mktsegment").alias("realm"),
        F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("grant_view"),
    )
    items = customer.select("c_custkey", "c_name")
    return p.granted(items, grants, "c_custkey", [(3, "BUILDING"), (7, "HOUSEHOLD")], bypass=False)


@registered("SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de')")
def language_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return p.in_languages(docs, "lang", ["fr", "de"], ["de", "en", "es", "fr"])


@registered(
    "SELECT o_orderkey, o_orderpriority, o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AS allowed FROM orders"
)
def allowed_values(spark, sf_dir):
    options = {"1-URGENT": "Urgent", "2-HIGH": "High", "5-LOW": "Low"}
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", p.condition("o_orderpriority", list(options), "IN").alias("allowed")
    )


@registered(
    "SELECT doc_id, list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'the') AS has_term, "
    "trim(text) <> '' AS has_text FROM documents"
)
def full_text_contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", p.full_text("text", "=", "The").alias("has_term"), p.full_text("text", "not empty").alias("has_text")
    )


@registered(
    "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) "
    "AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
)
def item_exclusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return p.exclude_items(docs, table(spark, sf_dir, "labels"), "doc_id", F.col("toxic") == 1, F.col("quality") == 1)


def aliases(spark, sf_dir):
    """Page paths as aliases; those of feeds are written in capitals."""
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    section = F.regexp_extract("url", r"^https?://[^/]+(/[^/?#]*)", 1)
    short = F.when(F.col("url").contains("utm_source"), F.upper(section)).otherwise(section)
    return table(spark, sf_dir, "pages").select(
        "page_id", short.alias("alias"), F.when(path.endswith("/"), "und").otherwise("en").alias("lang")
    )


ALIASES = (
    "(SELECT page_id, CASE WHEN contains(url, 'utm_source') THEN upper(regexp_extract(url, '^https?://[^/]+(/[^/?#]*)', 1)) "
    "ELSE regexp_extract(url, '^https?://[^/]+(/[^/?#]*)', 1) END AS alias, "
    "CASE WHEN ends_with(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/') THEN 'und' ELSE 'en' END AS lang FROM pages)"
)


@registered(
    f"WITH s AS (SELECT lang, alias, count(*) AS uses FROM {ALIASES} GROUP BY lang, alias), "
    "o AS (SELECT *, cast(sum(uses) OVER (PARTITION BY lang, lower(alias)) - uses AS bigint) AS other_spellings FROM s) "
    "SELECT *, CASE WHEN uses > 1 THEN 'in use' ELSE 'differs in capitals' END AS violation FROM o "
    "WHERE uses > 1 OR other_spellings > 0"
)
def uniqueness_check(spark, sf_dir):
    return keys.duplicate_aliases(aliases(spark, sf_dir), "alias", "lang")


@registered(
    f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY lang, alias ORDER BY page_id) AS nth FROM {ALIASES}) "
    "SELECT page_id, alias, lang, CASE WHEN nth = 1 THEN alias ELSE alias || '-' || (nth - 2) END AS unique_alias FROM p"
)
def unique_suffix(spark, sf_dir):
    return keys.uniquify(aliases(spark, sf_dir), "alias", "lang", ["page_id"])


@registered("SELECT p_name, count(*) AS uses FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_labels(spark, sf_dir):
    return keys.duplicate_labels(table(spark, sf_dir, "part"), "p_name")


@registered("SELECT r_regionkey + 100 AS term, r_name AS name FROM region")
def top_level_terms(spark, sf_dir):
    regions = table(spark, sf_dir, "region").selectExpr(
        "r_regionkey + 100 AS term", "r_name AS name", "0 AS parent", "'places' AS vocabulary"
    )
    nations = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS term", "n_name AS name", "n_regionkey + 100 AS parent", "'places' AS vocabulary"
    )
    brands = table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey AS int) AS term", "p_name AS name", "0 AS parent", "'parts' AS vocabulary"
    )
    terms = regions.unionByName(nations).unionByName(brands)
    return keys.top_level_terms(terms, ["places"]).select("term", "name")


@registered("SELECT o_orderkey, o_orderdate FROM orders WHERE strftime(o_orderdate, '%Y%m') = '199703'")
def formula_argument(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return p.by_formula(orders, "date_format(***table***.o_orderdate, 'yyyyMM')", "199703")


NUMBERISH = (
    "CASE event_type WHEN 'error' THEN 'k' || json_extract_string(props, '$.k') WHEN 'view' THEN ' -' || "
    "json_extract_string(props, '$.k') || '.5e1' WHEN 'click' THEN json_extract_string(props, '$.k') || 'd' "
    "ELSE json_extract_string(props, '$.k') END"
)


@registered(
    f"SELECT event_id, {NUMBERISH} AS argument, "
    f"regexp_matches({NUMBERISH}, '^\\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$') AS is_numeric FROM events"
)
def numeric_argument(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("k"), k))
        .when(F.col("event_type") == "view", F.concat(F.lit(" -"), k, F.lit(".5e1")))
        .when(F.col("event_type") == "click", F.concat(k, F.lit("d")))
        .otherwise(k)
    )
    events = table(spark, sf_dir, "events").select("event_id", text.alias("argument"))
    return events.withColumn("is_numeric", p.is_numeric_text("argument"))


@registered(
    "SELECT l_orderkey, l_linenumber, 'within' AS kind FROM lineitem "
    "WHERE l_extendedprice BETWEEN 1000 AND 5000 OR l_extendedprice BETWEEN 90000.5 AND 95000 "
    "UNION ALL SELECT l_orderkey, l_linenumber, 'outside' FROM lineitem "
    "WHERE l_extendedprice NOT BETWEEN 1000 AND 5000 AND l_extendedprice NOT BETWEEN 90000.5 AND 95000"
)
def facet_range_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    active = [p.slider_bounds(item) for item in ("(min:1000,max:5000)", "(min:90000.5,max:95000)")]
    within = lines.filter(p.facet_ranges("l_extendedprice", active)).withColumn("kind", F.lit("within"))
    outside = lines.filter(p.facet_ranges("l_extendedprice", active, "AND", exclude=True))
    return within.unionByName(outside.withColumn("kind", F.lit("outside"))).drop("l_extendedprice")
