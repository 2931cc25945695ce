"""Sharding by fixed virtual slots: records hash to slots once, and a small versioned map says which shard owns a slot.

The number of slots never changes, so a record's slot never does. Bytes are added up per slot; shards get slots so that their
bytes are nearly equal. To rebalance, a new version of the map is written in which few slots have another owner.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulark.scale import numbered_within
from tabulark.scratch import table_path

SLOTS = 4096
MAP = "version int, slot int, shard int, bytes bigint, n_rows bigint"


def slot_of(doc_id: Column, text_key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, text_key), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, text_key, size, text_crc32, virtual_slot): a record's size is its text's bytes and 8 more."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_key"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return rows.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_key"), slots))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of every slot, empty ones too: always ``slots`` entries."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    found = {r["virtual_slot"]: (r["bytes"], r["n"]) for r in sums.collect()}
    return [(slot, *found.get(slot, (0, 0))) for slot in range(slots)]


def first_map(sizes: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """Slot to shard: the largest slots first, each to the shard with the fewest bytes, ties to the lower number."""
    load = [(0, shard) for shard in range(shards)]
    owner = {}
    for slot, size, _ in sorted(sizes, key=lambda s: (-s[1], s[0])):
        least, shard = heapq.heappop(load)
        owner[slot] = shard
        heapq.heappush(load, (least + size, shard))
    return owner


def rebalanced(owner: dict[int, int], sizes: list[tuple[int, int, int]], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """An edited map: slots move from the fullest shard that has a fitting one to the emptiest, until the gap is in the tolerance.

    With more shards than before, the new ones start empty; slots of shards that are gone move first.
    """
    bytes_of = {slot: size for slot, size, _ in sizes}
    owned: dict[int, set[int]] = {shard: set() for shard in range(shards)}
    homeless = [slot for slot, shard in owner.items() if shard >= shards]
    for slot, shard in owner.items():
        if shard < shards:
            owned[shard].add(slot)
    load = {shard: sum(bytes_of[s] for s in slots) for shard, slots in owned.items()}

    def give(slot: int, shard: int):
        owned[shard].add(slot)
        load[shard] += bytes_of[slot]

    for slot in sorted(homeless, key=lambda s: (-bytes_of[s], s)):
        give(slot, min(load, key=lambda s: (load[s], s)))
    mean = sum(load.values()) / shards
    while True:
        empty = min(load, key=lambda s: (load[s], s))
        for full in sorted(load, key=lambda s: (-load[s], s)):
            gap = load[full] - load[empty]
            fitting = [s for s in owned[full] if 0 < bytes_of[s] < gap]
            if fitting or gap <= tolerance * mean:
                break
        if gap <= tolerance * mean:
            return {slot: shard for shard, slots in owned.items() for slot in slots}
        slot = min(fitting, key=lambda s: (abs(gap / 2 - bytes_of[s]), s))
        owned[full].discard(slot)
        load[full] -= bytes_of[slot]
        give(slot, empty)


def stored_map(spark: SparkSession, owner: dict[int, int], sizes: list[tuple[int, int, int]], version: int, path: str | None = None) -> str:
    """Append one version of the map to the table at ``path`` (a fresh one by default) and return the path."""
    path = path or table_path(spark, "slot-map")
    rows = [(version, slot, owner[slot], size, n) for slot, size, n in sizes]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").parquet(path)
    return path


def current_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the newest by default."""
    every = spark.read.schema(MAP).parquet(path)
    newest = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == newest)


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` of ``records`` with shard, slot (place in the shard, gapless from 0) and the map's version.

    A shard's slots lie one after the other; a row's place is its place in the slot after the rows of the slots before. The
    map has a fixed number of rows and is broadcast. Hot slots are numbered in parts, see ``numbered_within``.
    """
    entries = sorted(slot_map.collect(), key=lambda r: r["slot"])
    before: dict[int, int] = {}
    table = []
    for entry in entries:
        start = before.get(entry["shard"], 0)
        table.append((entry["slot"], entry["shard"], start, entry["version"]))
        before[entry["shard"]] = start + entry["n_rows"]
    spark = rows.sparkSession
    starts = spark.createDataFrame(table, "virtual_slot int, shard int, first bigint, map_version int")
    numbered = numbered_within(rows, ["virtual_slot"], ["doc_id", "text_key"], name="place")
    joined = numbered.join(F.broadcast(starts), "virtual_slot")
    return joined.withColumn("slot", F.col("first") + F.col("place") - 1).drop("first", "place")
