"""Row processing by declared steps: chains per column, skipped rows, ordered processors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[Column], Column]
Processor = Callable[[DataFrame], DataFrame]


class Guard:
    """A test inside a chain: where it fails the row is skipped, or the chain stops with NULL."""

    def __init__(self, test: Step, skip_row: bool = False, message: str = "") -> None:
        self.test, self.skip_row, self.message = test, skip_row, message


def skip_unset(df: DataFrame, field: str, message: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with the field, and the skipped ones with a message."""
    skipped = df.filter(F.col(field).isNull()).withColumn("message", F.lit(message or f"{field} is not set"))
    return df.filter(F.col(field).isNotNull()), skipped


def expand(df: DataFrame, field: str, many: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per value where a value stands for several."""
    column = F.array(F.col(field))
    for value, results in many.items():
        column = F.when(F.col(field) == value, F.array(*[F.lit(r) for r in results])).otherwise(column)
    others = [c for c in df.columns if c != field]
    return df.select(*others, F.explode(column).alias(field))


def processed(df: DataFrame, chains: Mapping[str, tuple[str, Sequence[Step | Guard]]], keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Build destination columns from source columns through chains of steps.

    Returns the processed rows and the skipped ones with the first message.
    """
    columns, skips = {}, []
    for destination, (source, steps) in chains.items():
        value, going = F.col(source), F.lit(True)
        for step in steps:
            if isinstance(step, Guard):
                passed = F.coalesce(step.test(value), F.lit(False))
                if step.skip_row:
                    skips.append(F.when(going & ~passed, F.lit(step.message or f"{destination} skipped")))
                going = going & passed
            else:
                value = step(value)
        columns[destination] = F.when(going, value)
    reason = F.coalesce(*skips) if skips else F.lit(None).cast("string")
    done = df.select(*keep, *[c.alias(n) for n, c in columns.items()], reason.alias("message"))
    return done.filter(F.col("message").isNull()).drop("message"), done.filter(F.col("message").isNotNull()).select(*keep, "message")


class Processors:
    """Post-import processors: one per priority number, a later one replacing an earlier."""

    def __init__(self) -> None:
        self._by_priority: dict[int, Processor] = {}

    def add(self, processor: Processor, priority: int = 0) -> None:
        self._by_priority[priority] = processor

    def ordered(self) -> list[Processor]:
        return [self._by_priority[p] for p in sorted(self._by_priority)]

    def run(self, df: DataFrame) -> DataFrame:
        return transformed(df, self.ordered())


def transformed(df: DataFrame, transforms: Iterable[Processor]) -> DataFrame:
    """Harvest transforms, one after the other."""
    for transform in transforms:
        df = df.transform(transform)
    return df
