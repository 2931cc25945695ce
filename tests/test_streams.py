"""Streams against their batch results."""

import datetime

from pyspark.sql import functions as F

from tabulark.streaming import flood, increments as inc


def moment(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def test_high_water(spark):
    rows = spark.createDataFrame([(1, "Item 1", 1), (2, "Item 2", 2), (3, "Item 3", 3)], "id int, title string, changed int")
    ids = lambda mark: sorted(r.id for r in inc.above(rows, "changed", mark).collect())
    assert ids(1) == [2, 3] and ids(None) == ids("") == [1, 2, 3]
    assert inc.next_mark(rows, "changed") == 3 and inc.next_mark(rows.limit(0), "changed", 7) == 7


def test_flood_window_is_half_open(spark):
    seconds = [0, 10, 10, 3599, 3600, 3601, 9000]
    events = spark.createDataFrame([("u", moment(s)) for s in seconds], "who string, at timestamp")
    counts = flood.allowed(flood.per_second(events, ["who"], "at"), ["who"], threshold=4).orderBy("second").collect()
    base = counts[0].second
    for row in counts:
        now = row.second - base
        assert row.in_window == sum(now - 3600 < s <= now for s in seconds)
        assert row.is_allowed == (row.in_window < 4)
    assert flood.unexpired(flood.per_second(events, ["who"], "at"), base + 3610).count() == 4


def test_flood_stream_equals_batch_over_restarts(spark, tmp_path):
    events = spark.range(400).select(
        F.when(F.col("id") < 250, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 7)).alias("who"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 37).alias("at"),
    )
    work = str(tmp_path)
    for low, high in ((0, 5000), (5000, 9000), (9000, 20000)):
        age = F.unix_seconds("at") - 1704067200
        events.filter((age >= low) & (age < high)).write.mode("append").parquet(work + "/in")
        stream = inc.file_stream(spark, events.schema).parquet(work + "/in")
        flood.run_flood(stream, ["who"], "at", 3, work + "/out", work + "/state", work + "/check", window=1000)
    streamed = flood.decisions(spark, work + "/out", ["who"]).collect()
    batch = flood.allowed(flood.per_second(events, ["who"], "at"), ["who"], 3, 1000).collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch))


def test_flood_stream_revises_clears_and_purges(spark, tmp_path):
    import os

    work, schema = str(tmp_path), "who string, at timestamp, kind string"
    event = lambda who, *seconds: [(who, moment(s), "event") for s in seconds]
    clear = lambda who, second: [(who, moment(second), "clear")]
    deliveries = [
        event("a", 100, 100, 150) + event("b", 140) + clear("c", 120),
        event("a", 100, 120, 199, 260) + event("c", 110, 120, 130),  # one second in two parts, and late ones
        clear("a", 150) + event("a", 151) + clear("b", 141),  # a late clearing revises what was decided after it
        [],
        event("a", 1000, 5) + event("b", 990, 4000),
        event("a", 3990, 3000, 3000),  # more than 300 seconds behind 4000
    ]
    base = int((moment(0) - datetime.datetime(1970, 1, 1)).total_seconds())
    for rows in deliveries:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(work + "/in")
        stream = inc.file_stream(spark, spark.createDataFrame([], schema).schema).parquet(work + "/in")
        flood.run_flood(
            stream, ["who"], "at", 3, work + "/out", work + "/state", work + "/check", 100, late=300, cleared=F.col("kind") == "clear"
        )
    everything = [(w, int((t - moment(0)).total_seconds()), k) for rows in deliveries for w, t, k in rows]
    in_time = [r for r in everything if r != ("a", 3000, "event")]
    expected = set()
    for who, now in {r[:2] for r in in_time}:
        own = [r for r in in_time if r[0] == who]
        last_clear = max((s for _, s, k in own if k == "clear" and s <= now), default=-1)
        n = sum(k == "event" and max(now - 100, last_clear) < s <= now for _, s, k in own)
        expected.add((who, now, n, n < 3))
    got = [(r.who, r.second - base, r.in_window, r.is_allowed) for r in flood.decisions(spark, work + "/out", ["who"]).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    late = flood.late_counts(spark, work + "/state", ["who"]).collect()
    assert [(r.who, r.second - base, r.n) for r in late] == [("a", 3000, 2)]
    spans = sorted(int(f[5:]) - base // 100 for f in os.listdir(work + "/state/seconds/in_time=true") if f.startswith("span="))
    assert spans[0] >= 36 and spans[-1] >= 39


def test_daily_counts_go_on_after_a_restart(spark, tmp_path):
    work = str(tmp_path)
    rows = spark.range(100).select((F.col("id") % 3).alias("item"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 4000).alias("at"))
    for part in (F.col("item") < 2, F.col("item") >= 1):
        rows.filter(part).write.mode("append").parquet(work + "/in")
        stream = inc.file_stream(spark, rows.schema).parquet(work + "/in")
        inc.run_daily_counts(stream, "item", "at", work + "/out", work + "/check", late="30 days")
    both = rows.filter("item < 2").unionByName(rows.filter("item >= 1"))
    got = inc.latest_counts(spark, work + "/out", "item").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, inc.daily_counts(both, "item", "at").collect()))


def test_late_rows_count_and_are_reported(spark, tmp_path):
    work, schema = str(tmp_path), "item string, at timestamp"
    hour = lambda h: moment(3600 * h)
    deliveries = [[("a", hour(100)), ("b", hour(101))], [("a", hour(1)), ("a", hour(99)), ("b", hour(200))], [("b", hour(101)), ("c", hour(199))], []]
    for rows in deliveries:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(work + "/in")
        stream = inc.file_stream(spark, spark.createDataFrame([], schema).schema).parquet(work + "/in")
        inc.run_daily_counts(stream, "item", "at", work + "/out", work + "/check", late="1 day")
    everything = spark.createDataFrame([row for rows in deliveries for row in rows], schema)
    got = inc.latest_counts(spark, work + "/out", "item").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, inc.daily_counts(everything, "item", "at").collect()))
    # A day behind the newest row of earlier deliveries: a at 1 h, b at 101 h.
    assert sorted((r.item, r.late) for r in inc.late_counts(spark, work + "/out", "item").collect()) == [("a", 1), ("b", 1)]


def test_resumable_run_neither_loses_nor_repeats(spark, tmp_path):
    work = str(tmp_path)
    spark.range(100).repartition(5, "id").write.parquet(work + "/in")
    stream = inc.file_stream(spark, spark.range(1).schema, files_per_batch=1).parquet(work + "/in")
    states = [inc.run_resumable(stream, work + "/out", work + "/check", stop_after=n) for n in (1, 3, None, None)]
    assert states == [inc.INCOMPLETE, inc.INCOMPLETE, inc.COMPLETED, inc.COMPLETED]
    assert sorted(r.id for r in spark.read.parquet(work + "/out").collect()) == list(range(100))
