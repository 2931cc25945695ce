"""Increments: high-water marks, change tracking, daily counters, resumable runs, rollback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from tabulark.scale import numbered


def above(df: DataFrame, field: str, mark) -> DataFrame:
    """Rows beyond the stored mark; no mark yet (NULL or empty) means all rows."""
    return df if mark is None or mark == "" else df.filter(F.col(field) > F.lit(mark))


def next_mark(df: DataFrame, field: str, mark=None):
    """The mark to keep after these rows: their maximum, or the old one if there were none."""
    top = df.agg(F.max(field)).first()[0]
    return mark if top is None else top


def last_changes(changes: DataFrame, item: str, operation: str, at: tuple[str, ...]) -> DataFrame:
    """The last change of each item."""
    return changes.groupBy(item).agg(
        F.max_by(operation, F.struct(*at)).alias(operation), F.max(F.struct(*at)).alias("changed")
    )


def tracked(changes: DataFrame, item: str, operation: str, at: tuple[str, ...], size: int = 50) -> DataFrame:
    """Items waiting to be indexed or removed, in batches by time of change."""
    last = last_changes(changes, item, operation, at)
    placed = numbered(last, "changed", name="_place", start=0)
    return placed.withColumn("batch", F.floor(F.col("_place") / size).cast("bigint")).drop("_place", "changed")


def daily_counts(views: DataFrame, item: str, at: str) -> DataFrame:
    """Counts per item and day: the counter starts anew each day."""
    day = F.window(at, "1 day")
    return views.groupBy(day, item).agg(F.count(F.lit(1)).alias("daycount")).select(
        F.col("window.start").alias("day"), item, "daycount"
    )


def file_stream(spark: SparkSession, schema, files_per_batch: int | None = None) -> DataStreamReader:
    reader = spark.readStream.schema(schema)
    return reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader


def batch_path(target: str, batch_id: int) -> str:
    return f"{target}/batch={batch_id}"


def run_daily_counts(views: DataFrame, item: str, at: str, target: str, checkpoint: str, late: str = "1 day") -> None:
    """Stream the daily counters until the input is used up.

    Each batch writes what it adds to the counts to its own folder, so a repeated batch replaces itself. Counts are sums,
    so nothing has to be kept in memory between batches and a row counts however late it comes. Rows that are more than
    ``late`` behind the newest row of earlier batches are counted as late, too.
    """
    spark, since = views.sparkSession, F.expr(f"INTERVAL {late}")

    def keep(batch: DataFrame, batch_id: int) -> None:
        newest = None
        if batch_id:
            earlier = spark.read.parquet(target).where(F.col("batch") < batch_id)
            newest = earlier.agg(F.max("newest")).first()[0]
        behind = F.lit(False) if newest is None else F.col(at) < F.lit(newest) - since
        added = batch.groupBy(F.window(at, "1 day").alias("window"), item).agg(
            F.count(F.lit(1)).alias("daycount"), F.count_if(behind).alias("late"), F.max(at).alias("newest")
        )
        added.select(F.col("window.start").alias("day"), item, "daycount", "late", "newest").write.mode("overwrite").parquet(batch_path(target, batch_id))

    query = views.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def latest_counts(spark: SparkSession, target: str, item: str) -> DataFrame:
    """The count of each item and day over all batches, late rows included."""
    return spark.read.parquet(target).groupBy("day", item).agg(F.sum("daycount").alias("daycount"))


def late_counts(spark: SparkSession, target: str, item: str) -> DataFrame:
    """Of these counts, the rows that came late."""
    written = spark.read.parquet(target).where("late > 0")
    return written.groupBy("day", item).agg(F.sum("late").alias("late"))


COMPLETED, INCOMPLETE = "COMPLETED", "INCOMPLETE"


def run_resumable(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    stop_after: int | None = None,
) -> str:
    """Process what is there, batch by batch. An interrupted run goes on where it stopped.

    ``stop_after`` interrupts before that batch number, as a lost driver would.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        if stop_after is not None and batch_id >= stop_after:
            raise InterruptedError(f"interrupted before batch {batch_id}")
        transform(batch).write.mode("overwrite").parquet(batch_path(target, batch_id))

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    running = query.trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    except StreamingQueryException as error:
        if "interrupted before batch" not in str(error):
            raise
        return INCOMPLETE
    return COMPLETED


def run_changes(
    changes: DataFrame, item: str, operation: str, at: tuple[str, ...], target: str, checkpoint: str
) -> str:
    """Stream changes into a change table, each batch folded to the last change per item before it is written."""
    return run_resumable(changes, target, checkpoint, lambda batch: last_changes(batch, item, operation, at))


def tracked_changes(spark: SparkSession, target: str, item: str, operation: str, size: int = 50) -> DataFrame:
    """Waiting items of a streamed change table, in batches by time of change."""
    return tracked(spark.read.parquet(target), item, operation, ("changed",), size)


def imported(rows: DataFrame, key: str, run: str) -> DataFrame:
    """The id map of an import run: which rows it brought."""
    return rows.select(key, F.lit(run).alias("run"))


def rolled_back(target: DataFrame, id_map: DataFrame, key: str, run: str) -> DataFrame:
    """The target without the rows of a run."""
    return target.join(id_map.filter(F.col("run") == run).select(key), key, "left_anti")


