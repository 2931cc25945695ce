"""Shared scratch space for intermediate tables.

It lies in the folder the cluster names in ``spark.checkpoint.dir``, so what is written
there outlives any executor. Only a local-mode session without that setting gets a
folder of its own. Tables lie under the application's id, to be removed with it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    application = context.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="tabulark-")
    return _local_folders[application]


def table_path(spark: SparkSession, label: str) -> str:
    """A fresh path for an intermediate table."""
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write the rows as a table and go on from there: the lineage ends, nothing is computed twice.

    A written table is columnar, so later passes read only the columns they need, and unlike
    ``checkpoint()`` it is made in one run of the plan.
    """
    path = table_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more, and have Spark delete the shuffle files of ended jobs.

    Spark deletes shuffle files when the driver happens to collect its garbage, which may be long after the job.
    """
    jvm = spark.sparkContext._jvm
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()
