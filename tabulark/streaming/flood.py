"""Flood limits: how often an identifier did something in the last window, and whether it may again.

Events are first counted per second, so one identifier never holds more than the
seconds of two windows in a group, however many events it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulark.streaming.increments import batch_path


def per_second(events: DataFrame, keys: Sequence[str], at: str, cleared: Column | None = None) -> DataFrame:
    """Events per second. ``cleared`` marks the rows that are no events but make the identifier's earlier ones forgotten.

    Time has whole seconds here: a clearing counts for all of its second, so that the order of arrival does not matter.
    """
    second = F.unix_seconds(F.col(at).cast("timestamp")).alias("second")
    if cleared is None:
        return events.groupBy(*keys, second).agg(F.count(F.lit(1)).alias("n"))
    clears = F.coalesce(cleared, F.lit(False))
    return events.groupBy(*keys, second).agg(F.count_if(~clears).alias("n"), F.max(clears).alias("cleared"))


def window_counts(counts: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """Events in the ``window`` seconds up to and including each second, as far as they have not been cleared.

    Each second also visits the next bucket as history, so a bucket holds all it looks back on.
    """
    own = F.floor(F.col("second") / window)
    visits = counts.withColumn("_own", own).withColumn("_bucket", F.explode(F.array(own, own + 1)))
    group, events = [*keys, "_bucket"], F.col("n")
    if "cleared" in counts.columns:
        # A clearing opens a new stretch of its group; windows do not look over its edge.
        so_far = Window.partitionBy(*group).orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
        visits = visits.withColumn("_stretch", F.count_if("cleared").over(so_far))
        group, events = [*group, "_stretch"], F.when(F.col("cleared"), 0).otherwise(events)
    back = Window.partitionBy(*group).orderBy("second").rangeBetween(-(window - 1), 0)
    counted = visits.withColumn("in_window", F.sum(events).over(back))
    return counted.filter(F.col("_own") == F.col("_bucket")).drop("_own", "_bucket", "_stretch")


def allowed(counts: DataFrame, keys: Sequence[str], threshold: int, window: int = 3600) -> DataFrame:
    """Per second: the events in the window, and whether one more is allowed."""
    return window_counts(counts, keys, window).withColumn("is_allowed", F.col("in_window") < threshold)


def unexpired(counts: DataFrame, now: int, window: int = 3600) -> DataFrame:
    """Counts that still matter at a time; the others may be purged."""
    return counts.filter(F.col("second") > now - window)


def run_flood(
    events: DataFrame,
    keys: Sequence[str],
    at: str,
    threshold: int,
    target: str,
    state: str,
    checkpoint: str,
    window: int = 3600,
    late: int | None = None,
    cleared: Column | None = None,
) -> None:
    """Stream flood decisions until the input is used up; ``decisions`` reads them.

    The state holds counts per second, in folders by span of time and batch. A batch reads the spans its windows reach and
    decides its own seconds and those after them whose window they lie in: what comes out of order, or in parts, revises
    what was decided. A repeated batch replaces its folders. Seconds more than ``late`` seconds (one window unless given)
    behind the newest of earlier batches are not decided any more but counted apart (``late_counts``), and
    spans that no window can reach are deleted. An empty batch changes nothing.
    """
    spark, late = events.sparkSession, window if late is None else late

    def newest(batch_id: int) -> int | None:
        return spark.read.parquet(batch_path(f"{state}/newest", batch_id)).first()["second"] if batch_id >= 0 else None

    def decide(batch: DataFrame, batch_id: int) -> None:
        before = newest(batch_id - 1)
        span = F.floor(F.col("second") / window)
        arrived = per_second(batch, keys, at, cleared).withColumn("span", span).withColumn("batch", F.lit(batch_id))
        in_time = F.lit(True) if before is None else F.col("second") >= before - late
        # One pass: rows too late for a decision lie in a folder of their own.
        placed = arrived.withColumn("in_time", in_time)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("in_time", "span", "batch").parquet(f"{state}/seconds")
        held = _seconds(spark, state, True)
        reach = None
        if held is not None:
            reach = held.where(F.col("batch") == batch_id).agg(F.min("second").alias("first"), F.max("second").alias("last")).first()
        last = None if reach is None else reach["last"]
        top = max((m for m in (before, last) if m is not None), default=None)
        if last is not None:
            spans = F.col("span").between((reach["first"] - window + 1) // window, (last + window - 1) // window)
            sums = [F.sum("n").alias("n"), F.max(F.col("batch") == batch_id).alias("_fresh")]
            sums += [F.max("cleared").alias("cleared")] if cleared is not None else []
            known = held.where(spans & (F.col("batch") <= batch_id)).groupBy(*keys, "second").agg(*sums)
            revised = _touched(allowed(known, keys, threshold, window), keys, window)
            revised.write.mode("overwrite").parquet(batch_path(target, batch_id))
        spark.createDataFrame([(top,)], "second bigint").write.mode("overwrite").parquet(batch_path(f"{state}/newest", batch_id))
        if before is not None:
            # By the mark this batch began with, so that it can be repeated.
            _purge(spark, f"{state}/seconds/in_time=true", (before - late - window + 1) // window)

    query = events.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def _seconds(spark: SparkSession, state: str, in_time: bool) -> DataFrame | None:
    """The counts of the state, or None as long as there are none."""
    folder = f"{state}/seconds/in_time={str(in_time).lower()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path) or not files.listStatus(path):
        return None
    return spark.read.parquet(folder)


def _touched(counted: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """The seconds whose window holds a second marked as fresh."""
    own = F.floor(F.col("second") / window)
    fresh = counted.where("_fresh").select(*keys, F.explode(F.array(own, own + 1)).alias("_bucket"), F.col("second").alias("_new"))
    # One row per bucket: from its own first fresh second on, or up to one window after the last of the bucket before.
    here = F.floor(F.col("_new") / window) == F.col("_bucket")
    bounds = fresh.groupBy(*keys, "_bucket").agg(
        F.min(F.when(here, F.col("_new"))).alias("_from"), F.max(F.when(~here, F.col("_new"))).alias("_until")
    )
    reached = (F.col("second") >= F.col("_from")) | (F.col("second") < F.col("_until") + window)
    return counted.withColumn("_bucket", own).join(bounds, [*keys, "_bucket"]).where(reached).drop("_bucket", "_from", "_until", "_fresh")


def _purge(spark: SparkSession, folder: str, first: int) -> None:
    """Delete the spans before ``first``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(path) if files.exists(path) else ():
        name = status.getPath().getName()
        if name.startswith("span=") and int(name[len("span=") :]) < first:
            files.delete(status.getPath(), True)


def decisions(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """The decision of each second as it stands after all batches, one row per identifier and second."""
    written = spark.read.parquet(target)
    values = [c for c in written.columns if c not in (*keys, "second", "batch")]
    last = written.groupBy(*keys, "second").agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "second", "_last.*")


def late_counts(spark: SparkSession, state: str, keys: Sequence[str]) -> DataFrame | None:
    """Events that came too late for a decision, per identifier and second; None if there were none."""
    rows = _seconds(spark, state, False)
    return None if rows is None else rows.groupBy(*keys, "second").agg(F.sum("n").alias("n"))
