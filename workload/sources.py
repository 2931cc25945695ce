"""Sources, sinks and table writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark import scale
from tabulark.scratch import table_path
from tabulark.sources import delimited, documents, tables, writes
from workload import registered, table

COLUMNS = {
    "region": "r_regionkey,r_name",
    "nation": "n_nationkey,n_name,n_regionkey",
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "lineitem": "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,"
    "l_returnflag,l_linestatus,l_shipdate",
    "events": "event_id,ts,user_id,event_type,value,props",
    "documents": "doc_id,text,lang,source,n_chars",
    "pages": "page_id,url,html",
    "labels": "doc_id,quality,toxic",
    "conversations": "conv_id,turn,role,text",
}


def money(name: str):
    """A price as exact text, the same in every engine."""
    return F.col(name).cast("decimal(18,2)").cast("string")


@registered(
    "SELECT cast(o_orderkey AS varchar) o_orderkey, o_orderstatus, "
    "cast(cast(o_totalprice AS decimal(18,2)) AS varchar) o_totalprice, "
    "strftime(o_orderdate, '%Y-%m-%d') o_orderdate, o_orderpriority FROM orders"
)
def csv_file_source(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        money("o_totalprice").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority",
    )
    path = table_path(spark, "orders-csv")
    delimited.export_delimited(orders, path)
    return delimited.import_delimited(spark, path)


@registered(
    "SELECT 'drop' AS mode, cast(event_id AS varchar) event_id, event_type FROM events WHERE event_type <> 'error' "
    "UNION ALL SELECT 'keep', CASE WHEN event_type <> 'error' THEN cast(event_id AS varchar) END, "
    "CASE WHEN event_type <> 'error' THEN event_type END FROM events"
)
def blank_row_policy(spark, sf_dir):
    kept = F.col("event_type") != "error"
    events = table(spark, sf_dir, "events").select(
        F.when(kept, F.col("event_id")).alias("event_id"),
        F.when(kept, F.col("event_type")).alias("event_type"),
    )
    path = table_path(spark, "events-csv")
    delimited.export_delimited(events, path)
    modes = [
        delimited.import_delimited(spark, path, remove_empty_rows=drop).withColumn("mode", F.lit(mode))
        for mode, drop in (("drop", True), ("keep", False))
    ]
    return modes[0].unionByName(modes[1])


LONG = "measured_value_reported_by_the_publishing_agency_for_the_period_in_question_"


@registered(
    f"SELECT cast(c_custkey AS varchar) AS \"{delimited.heading(LONG + 'key')}\", "
    f"c_name AS \"{delimited.heading(LONG + 'name')}\", c_mktsegment AS segment FROM customer"
)
def long_header_truncation(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = table_path(spark, "customer-csv")
    delimited.export_delimited(customer, path, [LONG + "key", LONG + "name", "segment"])
    return delimited.import_delimited(spark, path)


@registered(
    "SELECT cast(o_orderkey AS varchar) AS order_key, "
    "CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN 'NULL' ELSE 'a,NULL,b' END AS note FROM orders"
)
def null_literal_on_import(spark, sf_dir):
    note = (
        F.when(F.col("o_orderstatus") == "P", "NULL")
        .when(F.col("o_orderstatus") == "F", '"NULL"')
        .otherwise('"a,NULL,b"')
    )
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), note)
    path = table_path(spark, "orders-text")
    lines = table(spark, sf_dir, "orders").select(line.alias("order_key,note"))
    lines.write.csv(path, header=True, sep="\u0001", quote="")
    return delimited.import_delimited(spark, path, null_literal=True)


@registered(
    "SELECT cast(doc_id AS varchar) AS doc_id, md5(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_md5, source "
    "FROM documents"
)
def csv_records_with_breaks(spark, sf_dir):
    """Whole texts, line breaks and quotes included, as cells of an import."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source")
    path = table_path(spark, "documents-csv")
    exact = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.write.csv(path, header=True, escape='"', quoteAll=True, **exact)
    rows = delimited.import_delimited(spark, path, remove_empty_rows=False)
    return rows.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "source")


@registered(
    "SELECT doc_id AS identifier, CASE WHEN lang = 'de' THEN source || ' (revised)' ELSE source END AS publisher, "
    "lang, n_chars FROM documents"
)
def catalog_json_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("identifier"), F.col("source").alias("publisher"), "lang", "n_chars"
    )
    page = F.floor(F.col("identifier") / 100).cast("bigint")
    revised = docs.filter(F.col("lang") == "de").withColumn("publisher", F.concat("publisher", F.lit(" (revised)")))
    entries = docs.withColumn("page", page).unionByName(revised.withColumn("page", page + 1_000_000_000))
    catalogs = entries.groupBy("page").agg(
        F.collect_list(F.struct("identifier", "publisher", "lang", "n_chars")).alias("dataset")
    )
    path = table_path(spark, "catalog-json")
    documents.json_lines(catalogs, path)
    return documents.read_catalog(
        spark, path, "identifier: bigint, publisher: string, lang: string, n_chars: bigint"
    )


@registered("SELECT doc_id, lang, n_chars FROM documents")
def extract_guard(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("item"))
    passed = documents.guard_items(items, "item")
    return passed.select(F.from_json("item", "doc_id bigint, lang string, n_chars bigint").alias("d")).select("d.*")


@registered("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def table_scan_projection(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@registered(
    "SELECT event_id, event_type, cast(json_extract_string(props, '$.k') AS integer) AS k FROM events "
    "WHERE event_type IN ('purchase', 'signup')"
)
def name_list_source(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    decoded = tables.named_values(events, "event_type", ["purchase", "signup"], "props", "k int")
    return decoded.select("event_id", "event_type", F.col("props.k").alias("k"))


@registered(
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'soon' END AS due FROM orders "
    "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"
)
def embedded_rows_source(spark, sf_dir):
    due = tables.embedded_rows(spark, [("1-URGENT", "now"), ("2-HIGH", "soon")], "o_orderpriority string, due string")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(scale.small_or_plain(due), "o_orderpriority").select("o_orderkey", "due")


@registered(
    "SELECT c_custkey AS key, c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' "
    "ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 10"
)
def key_value_scan(spark, sf_dir):
    return tables.slice_of(
        table(spark, sf_dir, "customer"),
        F.col("c_mktsegment") == "BUILDING",
        [F.desc("c_acctbal"), F.asc("c_custkey")],
        10,
        25,
        "c_custkey",
    )


@registered(
    "SELECT url, CASE WHEN url LIKE 'https%' THEN cast(strlen(html) AS bigint) END AS bytes, "
    "CASE WHEN url LIKE 'https%' THEN 'done' ELSE 'fetch' END AS state FROM pages"
)
def skip_fetched_files(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    manifest = pages.filter(F.col("url").startswith("https")).select(
        "url", F.octet_length("html").cast("bigint").alias("size")
    )
    return tables.fetch_plan(pages.select("url"), manifest, "url", "size")


@registered(
    "SELECT 'orders_table' AS table_name, count(*) > 0 AS imported FROM orders "
    "UNION ALL SELECT 'empty_table', false UNION ALL SELECT 'absent_table', false"
)
def import_status(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    tables.temporary(orders, "orders_table")
    tables.temporary(writes.truncate(orders), "empty_table")
    return tables.import_status(spark, ["orders_table", "empty_table", "absent_table"])


@registered(
    "WITH done AS (SELECT DISTINCT o_custkey FROM orders) "
    "SELECT user_id || '_' || event_id AS job_id, cast(user_id AS varchar) AS resource_id, "
    "cast(event_id AS varchar) AS version, CASE WHEN o_custkey IS NULL THEN 'waiting' ELSE 'done' END AS status "
    "FROM events LEFT JOIN done ON user_id = o_custkey WHERE event_type NOT IN ('error', 'click')"
)
def import_status_listing(spark, sf_dir):
    plain = F.concat_ws("_", "user_id", "event_id")
    jobs = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", F.concat(F.lit("error-"), "event_id"))
        .when(F.col("event_type") == "click", F.concat(plain, F.lit("_extra")))
        .otherwise(plain)
        .alias("job_id")
    )
    status = (
        table(spark, sf_dir, "orders")
        .select(F.col("o_custkey").cast("string").alias("resource_id"))
        .distinct()
        .withColumn("status", F.lit("done"))
    )
    return tables.job_listing(jobs, "job_id", status, "resource_id").fillna("waiting", ["status"])


@registered(
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {len(columns.split(','))} AS num_of_columns, '{columns}' AS columns, "
        f"cast(NULL AS varchar) AS indexes, nullif(count(*), 0) AS num_of_rows FROM {name}"
        for name, columns in COLUMNS.items()
    )
    + f" UNION ALL SELECT 'emptied', 2, '{COLUMNS['region']}', NULL, NULL"
)
def table_summary(spark, sf_dir):
    named = {name: table(spark, sf_dir, name) for name in COLUMNS}
    return tables.summaries(named | {"emptied": writes.truncate(named["region"])})


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 250000")
def temporary_table(spark, sf_dir):
    open_orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P")
    name = tables.temporary(open_orders, "open_orders")
    return spark.sql(
        "SELECT o_orderkey, o_totalprice FROM IDENTIFIER(:name) WHERE o_totalprice > :floor",
        args={"name": name, "floor": 250000},
    )


@registered(
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer "
    "UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL, 'SUPPLY' FROM supplier"
)
def insert_from_select(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey")
    )
    return writes.insert_rows(table(spark, sf_dir, "customer"), rows, {"c_mktsegment": "SUPPLY"})


@registered(
    "WITH old AS (SELECT * FROM customer WHERE c_nationkey <= 12), "
    "new AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL "
    "ELSE c_acctbal + 100 END AS c_acctbal FROM customer WHERE c_nationkey >= 8) "
    "SELECT coalesce(new.c_custkey, old.c_custkey) AS c_custkey, "
    "CASE WHEN new.c_custkey IS NULL THEN old.c_name ELSE new.c_name END AS c_name, "
    "CASE WHEN new.c_custkey IS NULL THEN old.c_nationkey ELSE new.c_nationkey END AS c_nationkey, "
    "CASE WHEN new.c_custkey IS NULL THEN old.c_acctbal ELSE new.c_acctbal END AS c_acctbal, old.c_mktsegment "
    "FROM old FULL JOIN new ON old.c_custkey = new.c_custkey"
)
def upsert_by_key(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    balance = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") + 100)
    new = customer.filter("c_nationkey >= 8").select("c_custkey", "c_name", "c_nationkey", balance.alias("c_acctbal"))
    return writes.upsert(customer.filter("c_nationkey <= 12"), new, "c_custkey")


@registered(
    "SELECT s_suppkey AS id, s_nationkey AS nation, 'supplier' AS kind FROM supplier UNION ALL "
    "SELECT c_custkey, c_nationkey, 'customer' FROM customer c WHERE NOT EXISTS "
    "(SELECT 1 FROM supplier s WHERE s_suppkey = c_custkey AND s_nationkey = c_nationkey)"
)
def merge_if_absent(spark, sf_dir):
    held = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS nation", "'supplier' AS kind")
    offered = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_nationkey AS nation", "'customer' AS kind"
    )
    return writes.merge_absent(held, offered, ["id", "nation"])


@registered(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'X' ELSE o_orderstatus END "
    "AS o_orderstatus, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END "
    "AS o_custkey FROM orders"
)
def conditional_update(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority")
    chosen = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    changed = writes.update_where(orders, {"o_orderstatus": F.lit("X"), "o_custkey": F.lit(None)}, chosen)
    return changed.drop("o_orderpriority")


@registered(
    "WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events) "
    "SELECT event_id, value FROM e WHERE NOT coalesce(value > 20, false)"
)
def conditional_delete(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )
    return writes.delete_where(events, F.col("value") > 20)


@registered("SELECT 'before' AS moment, count(*) AS n FROM orders UNION ALL SELECT 'after', 0")
def truncate_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    path = table_path(spark, "truncated")
    writes.truncate(orders).write.mode("overwrite").parquet(path)
    left = spark.read.schema(orders.schema).parquet(path)
    return orders.agg(F.lit("before").alias("moment"), F.count(F.lit(1)).alias("n")).unionByName(
        left.agg(F.lit("after").alias("moment"), F.count(F.lit(1)).alias("n"))
    )


@registered(
    "WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey < 10) "
    "SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone) "
    "UNION ALL SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders "
    "WHERE o_custkey IN (SELECT c_custkey FROM gone)) WHERE rn = 1"
)
def purge_prior_versions(spark, sf_dir):
    versions = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    ids = table(spark, sf_dir, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"))
    return writes.purge_prior(versions, "o_custkey", ["o_orderdate", "o_orderkey"], ids)


@registered(
    "SELECT '{\"o_orderkey\":' || o_orderkey || ',\"status\":' || "
    "CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '\"' || o_orderstatus || '\"' END || '}' AS line FROM orders"
)
def json_result_sink(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")
    )
    path = table_path(spark, "orders-json")
    documents.json_lines(rows, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@registered(
    'SELECT cast(c_custkey AS varchar) AS "Customer", c_name AS "Full name", '
    'c_mktsegment || \', "\' || c_nationkey || \'"\' AS "Market" FROM customer'
)
def csv_result_sink(spark, sf_dir):
    market = F.concat("c_mktsegment", F.lit(', "'), "c_nationkey", F.lit('"'))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", market)
    path = table_path(spark, "customer-csv")
    delimited.export_delimited(rows, path, ["Customer", "Full name", "Market"])
    return delimited.read_delimited(spark, path)


@registered(
    "WITH placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, "
    "l_shipdate, l_extendedprice) - 1 AS place FROM lineitem) "
    "SELECT l_orderkey, cast(place // 4 AS integer) AS chunk, "
    "string_agg(cast(l_partkey AS varchar), ',' ORDER BY place) AS parts, "
    "string_agg('\"' || l_partkey || ',' || l_suppkey || '\"', ',' ORDER BY place) AS pairs "
    "FROM placed GROUP BY l_orderkey, place // 4"
)
def multi_value_csv_cells(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
    )
    lists = scale.folded(
        lines,
        ["l_orderkey"],
        ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"],
        F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")),
        "pairs",
        size=4,
    )
    return lists.select(
        "l_orderkey",
        "chunk",
        delimited.cell_of_list(F.transform("pairs", lambda p: p[0])).alias("parts"),
        delimited.cell_of_nested_list(F.col("pairs")).alias("pairs"),
    )
