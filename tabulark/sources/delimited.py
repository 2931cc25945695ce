"""CSV resources: import into string tables, and export with relabelled headers."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tabulark.scratch import cut, table_path

MAX_HEADING = 64
HASH_LENGTH = 4
# The column of a record that does not fit its heading.
BAD = "__rejected_record__"
# A block is worked on in stretches of 2 ** STRETCH_BITS lines.
STRETCH_BITS = 10
STRETCH = ["file", "block", "stretch"]


def heading(name: str) -> str:
    """A column name of at most 64 characters; longer ones end in four hash characters."""
    if len(name) <= MAX_HEADING:
        return name
    digest = hashlib.md5(name.encode()).hexdigest()
    return name[: MAX_HEADING - HASH_LENGTH] + digest[:HASH_LENGTH]


def read_delimited(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text, named by the header record.

    ``multi_line`` allows line breaks inside quotes, at the price of one task per file.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', encoding="UTF-8")
    return raw.toDF(*[heading(c) for c in raw.columns])


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Remove records whose every cell is empty."""
    filled = [F.when(F.trim(F.col(f"`{c}`")) != "", F.lit(1)) for c in df.columns if c != BAD]
    return df.filter(F.coalesce(*filled).isNotNull())


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the block they stand in, and a number that rises within the block."""
    place = F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place)
    return lines.withColumn("at", F.monotonically_increasing_id())


def _opens(line: Column) -> Column:
    """Whether a line that begins outside quotes ends inside: a quote at the beginning of a cell that has no end."""
    closed = F.regexp_replace(line, r'(^|,)"[^"]*+(?:""[^"]*+)*+"(?=,|$)', "$1")
    return closed.rlike(r'(^|,)"')


def _has_breaks(lines: DataFrame) -> bool:
    """Whether some line ends inside quotes."""
    return bool(lines.where(F.col("value").contains('"') & _opens(F.col("value"))).head(1))


def _state_before(start: int, within: WindowSpec) -> tuple[Column, Column]:
    """The swaps up to each row, and whether each row begins inside quotes (1) when the first one begins in ``start``.

    A row turns the state into ``from0`` or ``from1``. Rows with both equal decide it whatever came before; since the last of
    these only the rows that swap it count.
    """
    swaps = F.sum("swap").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    decided = F.when(F.col("from0") == F.col("from1"), F.struct(F.col("from0").alias("state"), F.col("swaps").alias("swaps")))
    last = F.last(decided, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    before = F.col("swaps") - F.col("swap")
    return swaps, F.pmod(F.coalesce(last["state"] + before - last["swaps"], F.lit(start) + before), F.lit(2)).cast("int")


def _with_states(rows: DataFrame, within: WindowSpec) -> DataFrame:
    """Adds ``before0`` and ``before1``, the state before each row for either start."""
    rows = rows.withColumn("swap", ((F.col("from0") == 1) & (F.col("from1") == 0)).cast("int"))
    rows = rows.withColumn("swaps", _state_before(0, within)[0])
    return rows.withColumns({f"before{k}": _state_before(k, within)[1] for k in (0, 1)})


def record_lines(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The records (``value``) of CSV files as text, blank lines too, less each file's heading and what stands before it.

    Line breaks inside quotes stay in their record, as ``\\n``. Where no line ends inside quotes, lines are records and nothing moves.
    Otherwise every stretch of lines of a block works out how it would end if it began outside or inside quotes; a table
    of one row per stretch then tells which it was. Stretches are dealt evenly, so no task reads more with larger files.
    Only lines of records with breaks are put together, by record.
    A quote inside a cell that does not begin with one is text.
    """
    lines = _lines(spark, path)
    filled = F.when(F.trim("value") != "", F.col("at"))
    if not (multi_line and _has_breaks(lines)):
        return _without_headings(lines, lines.groupBy("file", "block").agg(F.min(filled).alias("first"))).select("value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    turned = lines.withColumn("stretch", F.shiftright("at", STRETCH_BITS))
    turned = turned.withColumns({"from0": _opens(F.col("value")).cast("int"), "from1": (1 - quotes % 2).cast("int")})
    within = Window.partitionBy(*STRETCH).orderBy("at")
    turned = _with_states(turned, within)
    for k in (0, 1):
        turned = turned.withColumn(f"after{k}", F.when(F.col(f"before{k}") == 0, F.col("from0")).otherwise(F.col("from1")))
        begun = F.last(F.when(F.col(f"before{k}") == 0, F.col("at")), ignorenulls=True)
        turned = turned.withColumn(f"begun{k}", begun.over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = [*STRETCH, "at", "value", *[f"{name}{k}" for name in ("before", "after", "begun") for k in (0, 1)]]
    turned = cut(turned.select(*kept), "csv-lines")
    ends = [F.max_by(f"{name}{k}", "at").alias(f"{new}{k}") for name, new in (("after", "from"), ("begun", "begun")) for k in (0, 1)]
    stretches = turned.groupBy(*STRETCH).agg(F.min(filled).alias("first"), *ends)
    # One row per stretch of a file.
    along = Window.partitionBy("file").orderBy("block", "stretch")
    stretches = _with_states(stretches, along).withColumn("inside", F.col("before0"))
    begun = F.when(F.col("inside") == 0, F.col("begun0")).otherwise(F.col("begun1"))
    carried = F.last(begun, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    stretches = cut(stretches.withColumn("carried", carried).select(*STRETCH, "first", "inside", "carried"), "csv-stretches")

    def of(name: str) -> Column:
        return F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    placed = turned.join(stretches.drop("first"), STRETCH).select(
        "file", "block", "value", "at", of("before").alias("before"), of("after").alias("after"), F.coalesce(of("begun"), "carried").alias("begun")
    )
    whole = (F.col("before") == 0) & (F.col("after") == 0)
    pieces = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    broken = placed.where(~whole).groupBy("file", F.col("begun").alias("at")).agg(pieces.alias("pieces"))
    broken = broken.select("file", F.col("pieces")[0]["block"].alias("block"), "at", F.array_join(F.col("pieces.value"), "\n").alias("value"))
    records = placed.where(whole).select("file", "block", "at", "value").unionByName(broken)
    return _without_headings(records, stretches).select("value")


def _without_headings(records: DataFrame, stretches: DataFrame) -> DataFrame:
    """Records behind their file's heading, its first record that is not blank; ``first`` is the first such line of a block or stretch."""
    headings = stretches.where("first is not null").groupBy("file").agg(F.min(F.struct("block", "first")).alias("heading"))
    # One row per file; by file, a large file's records would meet in one task.
    joined = records.join(F.broadcast(headings), "file", "left")
    return joined.where(F.struct("block", "at") > F.struct("heading.block", "heading.first"))


def records_of_lines(spark: SparkSession, path: str, lines: DataFrame) -> DataFrame:
    """Records as rows under the heading of the files; a blank line is a row of empty cells.

    A record whose number of cells is not the heading's stands in one more column, whole, beside its cut or filled up cells.
    """
    names = read_delimited(spark, path, multi_line=True).columns
    if not "".join(names).strip():
        # Reading whole files, the reader takes a line of spaces for the heading; by line it does not.
        names = read_delimited(spark, path).columns
    schema = ", ".join([f"`c{i}` string" for i in range(len(names))] + [f"{BAD} string"])
    cells = F.from_csv("value", schema, {"escape": '"', "columnNameOfCorruptRecord": BAD, "multiLine": "true"})
    found = lines.select("value", cells.alias("cells"))
    bad = F.when((F.col("value") != "") & F.col(f"cells.{BAD}").isNotNull(), F.col("value")).alias(BAD)
    return found.select(*[F.col(f"cells.c{i}").alias(n) for i, n in enumerate(names)], bad)


def without_null_literals(line: Column) -> Column:
    """A line with its bare ``NULL`` cells emptied, in one pass: quoted stretches are matched first and stay."""
    return F.regexp_replace(line, r'("[^"]*+")|(?<=^|,)NULL(?=,|$)', "$1")


def rejected_records(spark: SparkSession, path: str) -> DataFrame:
    """The records (``record``) whose number of cells is not the heading's: what an import cuts or fills up."""
    rows = records_of_lines(spark, path, record_lines(spark, path))
    return cut(rows.select(BAD), "rejected").where(F.col(BAD).isNotNull()).select(F.col(BAD).alias("record"))


def import_delimited(
    spark: SparkSession,
    path: str,
    remove_empty_rows: bool = True,
    null_literal: bool = False,
    target: str | None = None,
    multi_line: bool = True,
    rejects: str | None = None,
) -> DataFrame:
    """Import one CSV resource as a table, replacing an earlier import at ``target``.

    Cells may hold line breaks inside quotes; files stay splittable. Without ``multi_line`` every line is a record. With ``null_literal`` an unquoted ``NULL`` is an empty
    cell. Without ``remove_empty_rows`` blank lines behind the heading are records too. Records whose number of cells is not the
    heading's are cut or filled up, and written whole (``record``) to ``rejects`` where that is given, from the same pass.
    """
    target = target or table_path(spark, "resource")
    reads_alike = remove_empty_rows and not null_literal and rejects is None
    if reads_alike and not (multi_line and _has_breaks(spark.read.text(path))):
        # Lines are records and blank ones go: the reader itself does all that is asked.
        drop_blank_rows(read_delimited(spark, path)).write.mode("overwrite").parquet(target)
        return spark.read.parquet(target)
    lines = record_lines(spark, path, multi_line)
    if null_literal:
        lines = lines.select(without_null_literals(F.col("value")).alias("value"))
    rows = records_of_lines(spark, path, lines)
    if remove_empty_rows:
        rows = drop_blank_rows(rows)
    if rejects is None:
        rows.drop(BAD).write.mode("overwrite").parquet(target)
        return spark.read.parquet(target)
    rows = cut(rows, "records")
    rows.drop(BAD).write.mode("overwrite").parquet(target)
    rows.where(F.col(BAD).isNotNull()).select(F.col(BAD).alias("record")).write.mode("overwrite").parquet(rejects)
    return spark.read.parquet(target)


def export_delimited(df: DataFrame, path: str, labels: Sequence[str] | None = None) -> None:
    """Write CSV with a header, columns renamed to ``labels`` where given."""
    named = df.toDF(*labels) if labels else df
    named.write.mode("overwrite").csv(path, header=True, escape='"')


def cell_of_list(values: Column) -> Column:
    """A list as one cell: items joined by commas."""
    return F.array_join(values, ",", "")


def cell_of_nested_list(values: Column) -> Column:
    """A list of lists as one cell: inner lists joined by commas and wrapped in quotes."""
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), F.array_join(v, ",", ""), F.lit('"'))), ",")
