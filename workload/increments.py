"""Increments and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulark.scratch import table_path
from tabulark.streaming import flood, increments as inc
from workload import registered, table


@registered(
    "SELECT o_orderkey, 'first' AS run FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' UNION ALL "
    "SELECT o_orderkey, 'second' FROM orders WHERE o_orderdate > "
    "(SELECT max(o_orderdate) FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01') UNION ALL "
    "SELECT o_orderkey, 'no mark' FROM orders"
)
def high_water_increment(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    first = inc.above(orders.filter("o_orderdate <= TIMESTAMP_NTZ '1998-01-01 00:00:00'"), "o_orderdate", None)
    mark = inc.next_mark(first, "o_orderdate")
    second = inc.above(orders, "o_orderdate", mark)
    parts = [("first", first), ("second", second), ("no mark", inc.above(orders, "o_orderdate", ""))]
    runs = [df.select("o_orderkey", F.lit(name).alias("run")) for name, df in parts]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


CHANGES = (
    "(SELECT user_id || '-' || json_extract_string(props, '$.k') AS item, CASE event_type WHEN 'signup' THEN 'insert' "
    "WHEN 'error' THEN 'delete' ELSE 'update' END AS operation, ts, event_id FROM events)"
)


TRACKED = (
    f"WITH last AS (SELECT item, arg_max(operation, (ts, event_id)) AS operation, max((ts, event_id)) AS changed FROM {CHANGES} GROUP BY item) "
    "SELECT item, operation, cast((row_number() OVER (ORDER BY changed) - 1) // 50 AS bigint) AS batch FROM last"
)


def change_events(events):
    operation = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    item = F.concat_ws("-", "user_id", F.get_json_object("props", "$.k"))
    return events.select(item.alias("item"), operation.alias("operation"), "ts", "event_id")


@registered(TRACKED)
def change_tracking(spark, sf_dir):
    return inc.tracked(change_events(table(spark, sf_dir, "events")), "item", "operation", ("ts", "event_id"))


@registered(TRACKED)
def change_tracking_stream(spark, sf_dir):
    work = table_path(spark, "changes")
    events = table(spark, sf_dir, "events")
    events.repartition(3, "event_id").write.parquet(work + "/events")
    stream = inc.file_stream(spark, events.schema, files_per_batch=1).parquet(work + "/events")
    inc.run_changes(change_events(stream), "item", "operation", ("ts", "event_id"), work + "/changes", work + "/checkpoint")
    return inc.tracked_changes(spark, work + "/changes", "item", "operation")


DAILY = "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS daycount FROM events GROUP BY ALL"


@registered(DAILY)
def daily_counter_reset(spark, sf_dir):
    views = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    counts = inc.daily_counts(views, "event_type", "ts")
    return counts.withColumn("day", F.col("day").cast("timestamp_ntz"))


@registered(DAILY)
def daily_counter_stream(spark, sf_dir):
    views = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    work = table_path(spark, "daily")
    middle = F.lit("2024-01-15 12:00:00").cast("timestamp")
    # The newer half is delivered first, so that the other half comes late.
    for arrived in (F.col("ts") >= middle, F.col("ts") < middle):
        views.filter(arrived).write.mode("append").parquet(work + "/events")
        stream = inc.file_stream(spark, views.schema).parquet(work + "/events")
        inc.run_daily_counts(stream, "event_type", "ts", work + "/counts", work + "/checkpoint")
    counts = inc.latest_counts(spark, work + "/counts", "event_type")
    return counts.withColumn("day", F.col("day").cast("timestamp_ntz"))


FLOOD = (
    "WITH s AS (SELECT user_id, cast(epoch(date_trunc('second', ts)) AS bigint) AS second, count(*) AS n FROM events GROUP BY ALL), "
    "w AS (SELECT *, cast(sum(n) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS bigint) AS in_window FROM s) "
    "SELECT *, in_window < 4 AS is_allowed FROM w"
)


@registered(FLOOD)
def flood_limit(spark, sf_dir):
    counts = flood.per_second(table(spark, sf_dir, "events"), ["user_id"], "ts")
    return flood.allowed(counts, ["user_id"], threshold=4, window=86400)


@registered(FLOOD)
def flood_limit_stream(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    work = table_path(spark, "flood")
    middle = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    day = F.expr("INTERVAL 1 DAY")
    # Deliveries that overlap by a day on either side of the middle: seconds arrive in parts, and out of order.
    later = (F.col("ts") >= middle + day) | ((F.col("ts") >= middle - day) & (F.xxhash64("user_id", "ts") % 2 == 0))
    for arrived in (~later, later):
        events.filter(arrived).write.mode("append").parquet(work + "/events")
        stream = inc.file_stream(spark, events.schema).parquet(work + "/events")
        flood.run_flood(
            stream, ["user_id"], "ts", 4, work + "/decisions", work + "/state", work + "/checkpoint", window=86400, late=3 * 86400
        )
    return flood.decisions(spark, work + "/decisions", ["user_id"])


@registered("SELECT event_id, event_type, 'INCOMPLETE,COMPLETED' AS runs FROM events")
def resumable_batch(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    work = table_path(spark, "resumable")
    events.repartition(4, "event_id").write.parquet(work + "/events")
    stream = inc.file_stream(spark, events.schema, files_per_batch=1).parquet(work + "/events")
    runs = [
        inc.run_resumable(stream, work + "/copied", work + "/checkpoint", stop_after=stop) for stop in (2, None)
    ]
    copied = spark.read.schema(events.schema).parquet(work + "/copied").drop("batch")
    return copied.withColumn("runs", F.lit(",".join(runs)))


@registered("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def rollback_by_map(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    first, second = orders.filter("o_orderstatus <> 'P'"), orders.filter("o_orderstatus = 'P'")
    id_map = inc.imported(first, "o_orderkey", "one").unionByName(inc.imported(second, "o_orderkey", "two"))
    return inc.rolled_back(first.unionByName(second), id_map, "o_orderkey", "two")
