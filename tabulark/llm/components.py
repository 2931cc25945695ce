"""Connected components by alternating star contraction, as joins over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.scratch import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("child", "parent")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b); component is the smallest node reachable.

    Each round links the larger neighbours of a node to its smallest one, then the smaller ones, until the
    edges are stars. The rounds are written to the shared folder, so lineage stays short and nothing
    passes through the driver but a count and a checksum. Loops, repeated edges and edges with a null end
    are ignored; no edges give no rows.
    """
    ends = edges.select("a", "b").where("a <> b")
    current = cut(ends.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct(), "edges")
    before, state = None, _state(current)
    while state != before:
        both = current.select(F.col("child").alias("u"), F.col("parent").alias("v"))
        both = both.union(current.select("parent", "child"))
        lowest = both.groupBy("u").agg(F.min("v").alias("low"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("child"), F.least("low", "u").alias("parent"))
        chosen = large.groupBy("child").agg(F.min("parent").alias("low"))
        rest = large.join(chosen, "child").where("parent <> low").select(F.col("parent").alias("child"), "low")
        current = cut(chosen.select("child", "low").union(rest).distinct().withColumnRenamed("low", "parent"), "edges")
        before, state = state, _state(current)
    return current.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(
        current.select(F.col("parent"), F.col("parent")).distinct()
    )
