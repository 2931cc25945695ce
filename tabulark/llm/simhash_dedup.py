"""SimHash near-duplicates: word shingles, 64-bit fingerprints, and a hierarchical index in Gray order.

Fingerprints within the distance agree on some of their bit segments. For each choice of agreeing segments
there is one table whose fingerprints are rearranged to begin with them, sorted by Gray rank, and cut into
leaves of neighbours. Above the leaves stand nodes that hold the bits all members share, as mask and pattern.
A search compares nodes first, where differing shared bits add up; whole groups beyond the distance are
dropped before any of their members is looked at. Neighbours in Gray order differ in few bits, so masks are wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.llm.common import KEYS, keyed, with_decisions
from tabulark.llm.components import components
from tabulark.scratch import cut

BITS = 64
# Fingerprints of a leaf, leaves of an upper node, members of the small nodes inside a leaf.
LEAF, FAN, TWIG = 1024, 32, 32
# Random fingerprints that may share the leading segments of a table, before a finer cut into segments is taken.
CROWD = 64


def fingerprint(data: bytes, width: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; no word gives 0."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        starts, ends = [0], [len(joined)]
    else:
        stops = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *stops[: len(words) - width]]
        ends = [stop - 1 for stop in stops[width - 1 :]]
    ones = np.zeros(BITS, np.int64)
    for low in range(0, len(starts), 65536):
        spans = zip(starts[low : low + 65536], ends[low : low + 65536])
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, fp) of every row, in one pass over the texts."""

    @F.pandas_udf("bigint")
    def simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found = np.array([fingerprint(bytes(t), width) for t in texts], np.uint64)
            yield pd.Series(found.view(np.int64))

    rows = keyed(docs)
    return rows.select(*KEYS, simhash(F.col("text").cast("binary")).alias("fp"))


def segment_count(rows: int, distance: int) -> int:
    """Into how many segments to cut 64 bits so that few of ``rows`` random fingerprints share the agreeing ones."""
    blocks = distance + 1
    while blocks < 16 and rows > CROWD * 2.0 ** (BITS * (blocks - distance) / blocks):
        blocks += 1
    return blocks


def arrangements(blocks: int, distance: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each choice of ``blocks - distance`` agreeing segments: their bits, and the (start, width) order."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    segments = [(low, high - low) for low, high in zip(cuts, cuts[1:])]
    found = []
    for lead in combinations(segments, blocks - distance):
        found.append((sum(width for _, width in lead), [*lead, *[s for s in segments if s not in lead]]))
    return found


def _low_bits(width: int) -> Column:
    return F.lit(-1 if width == BITS else (1 << width) - 1).cast("bigint")


def rearranged(fp: Column, order: list[tuple[int, int]]) -> Column:
    """The bits of ``fp`` with the segments in the given order, first segment on top."""
    place, parts = BITS, []
    for start, width in order:
        place -= width
        parts.append(F.shiftleft(F.shiftrightunsigned(fp, start).bitwiseAND(_low_bits(width)), place))
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def gray_rank(code: Column) -> Column:
    """Place of a code word in the binary reflected Gray sequence (as unsigned bits)."""
    steps = F.array(*[F.lit(step) for step in (1, 2, 4, 8, 16, 32)])
    return F.aggregate(steps, code, lambda done, step: done.bitwiseXOR(F.call_function("shiftrightunsigned", done, step)))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[:, None] ^ y[None, :])


def _nodes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared bits (mask) and their values (pattern) of each run of TWIG neighbours."""
    starts = np.arange(0, len(x), TWIG)
    both, any_ = np.bitwise_and.reduceat(x, starts), np.bitwise_or.reduceat(x, starts)
    return ~(both ^ any_), both


def linked(x: np.ndarray, y: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the distance; pairs of nodes whose shared bits differ too much are skipped."""
    if len(x) <= TWIG and len(y) <= TWIG:
        return np.nonzero(_distances(x, y) <= distance)
    (mx, px), (my, py) = _nodes(x), _nodes(y)
    near = np.bitwise_count((px[:, None] ^ py[None, :]) & mx[:, None] & my[None, :]) <= distance
    rows, cols = [], []
    for i in np.nonzero(near.any(axis=1))[0]:
        keep = np.repeat(near[i], TWIG)[: len(y)]
        at = np.nonzero(keep)[0]
        r, c = np.nonzero(_distances(x[i * TWIG : (i + 1) * TWIG], y[at]) <= distance)
        rows.append(r + i * TWIG)
        cols.append(at[c])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def forest(rows: np.ndarray, cols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Few edges that connect what the given pairs of positions connect: each position with its smallest."""
    if len(rows) <= size:
        return rows, cols
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, rows, label[cols])
        np.minimum.at(label, cols, label[rows])
        label = label[label]
        if (label == before).all():
            break
    at = np.nonzero(label != np.arange(size))[0]
    return at, label[at]


EDGE = "a bigint, b bigint"
LEAF_ROW = EDGE + ", arrangement int, lead bigint, leaf bigint, pattern_and bigint, pattern_or bigint, fps binary"


def _emit(a: np.ndarray, b: np.ndarray) -> dict:
    return {"a": a.view(np.int64), "b": b.view(np.int64)}


def _leaves(distance: int):
    """Cut sorted rows into leaves; links inside a leaf come out as edges, leaves with a sister as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        columns = ("arrangement", "lead", "fp")
        empty = {name: np.zeros(0, np.int64) for name in columns}
        rest, first, previous = empty, True, False

        def close(one: dict, last: bool):
            # previous: the leaf before had the same lead. first, last: the key may go on in another task.
            nonlocal number, first, previous
            starts = np.nonzero(np.diff(one["lead"], prepend=one["lead"][0] - 1) | np.diff(one["arrangement"], prepend=-1))[0]
            ends = [*starts[1:], len(one["lead"])]
            a_parts, b_parts, leaves = [], [], []
            for start, end in zip(starts, ends):
                for low in range(start, end, LEAF):
                    high = min(end, low + LEAF)
                    own = one["fp"][low:high].view(np.uint64)
                    r, c = linked(own, own, distance)
                    up = r < c
                    r, c = forest(r[up], c[up], len(own))
                    a_parts.append(own[r])
                    b_parts.append(own[c])
                    edge = (first and start == 0) or (last and end == len(one["lead"])) or end - start > LEAF
                    if edge or (previous and start == 0):
                        leaves.append((one["arrangement"][low], one["lead"][low], (part << 32) + number, own))
                        number += 1
            first = False
            a, b = np.concatenate(a_parts), np.concatenate(b_parts)
            n, k = len(a), len(leaves)
            nothing = [None] * n
            yield pa.RecordBatch.from_pydict(
                {
                    "a": pa.array([*a.view(np.int64).tolist(), *[None] * k], pa.int64()),
                    "b": pa.array([*b.view(np.int64).tolist(), *[None] * k], pa.int64()),
                    "arrangement": pa.array([*nothing, *[int(x[0]) for x in leaves]], pa.int32()),
                    "lead": pa.array([*nothing, *[int(x[1]) for x in leaves]], pa.int64()),
                    "leaf": pa.array([*nothing, *[x[2] for x in leaves]], pa.int64()),
                    "pattern_and": pa.array([*nothing, *[int(np.bitwise_and.reduce(x[3]).view(np.int64)) for x in leaves]], pa.int64()),
                    "pattern_or": pa.array([*nothing, *[int(np.bitwise_or.reduce(x[3]).view(np.int64)) for x in leaves]], pa.int64()),
                    "fps": pa.array([*nothing, *[x[3].tobytes() for x in leaves]], pa.binary()),
                }
            )

        for batch in batches:
            new = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in columns}
            rest = {name: np.concatenate([rest[name], new[name].astype(np.int64)]) for name in columns}
            if len(rest["fp"]) < 65536:
                continue
            # Keep the last key back, as it may go on; a key beyond that size is cut at leaf borders.
            same = (rest["lead"] == rest["lead"][-1]) & (rest["arrangement"] == rest["arrangement"][-1])
            end = int(np.argmax(same))
            cut_key = end == 0
            end = end or len(same) // LEAF * LEAF
            yield from close({name: rest[name][:end] for name in columns}, cut_key)
            previous = cut_key
            rest = {name: rest[name][end:] for name in columns}
        if len(rest["fp"]):
            yield from close(rest, True)

    return run


def _pairs(distance: int):
    """Links between the fingerprints of two leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for left, right in zip(batch.column("fps").to_pylist(), batch.column("other").to_pylist()):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = np.concatenate([x, y])
                r, c = linked(x, y, distance)
                r, c = forest(r, c + len(x), len(both))
                a.append(both[r])
                b.append(both[c])
            yield pa.RecordBatch.from_pydict(_emit(np.concatenate(a), np.concatenate(b)))

    return run


def links(fps: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all those within the distance."""
    blocks = segment_count(fps.count(), distance)
    shapes = arrangements(blocks, distance)
    codes = F.array(
        *[
            F.struct(
                F.lit(i).alias("arrangement"),
                F.lit(BITS - lead).alias("below"),
                rearranged(F.col("fp"), order).alias("code"),
            )
            for i, (lead, order) in enumerate(shapes)
        ]
    )
    entries = fps.select("fp", F.explode(codes).alias("e")).select("fp", "e.*")
    entries = entries.withColumn("lead", F.call_function("shiftrightunsigned", "code", "below"))
    # Flipping the sign bit makes a signed sort follow the unsigned rank.
    entries = entries.withColumn("rank", gray_rank(F.col("code")).bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")))
    in_order = entries.repartitionByRange("arrangement", "rank").sortWithinPartitions("arrangement", "rank")
    found = cut(in_order.select("arrangement", "lead", "fp").mapInArrow(_leaves(distance), LEAF_ROW), "leaves")
    leaves = found.where("fps is not null").drop("a", "b")
    upper = F.floor(F.col("leaf") / FAN).cast("bigint")
    leaves = leaves.withColumn("upper", upper)
    uppers = leaves.groupBy("arrangement", "lead", "upper").agg(
        F.bit_and("pattern_and").alias("pattern_and"), F.bit_or("pattern_or").alias("pattern_or")
    )

    def apart(left: str, right: str) -> Column:
        shared = [F.col(f"{s}.pattern_and").bitwiseXOR(F.col(f"{s}.pattern_or")) for s in (left, right)]
        differing = F.col(f"{left}.pattern_and").bitwiseXOR(F.col(f"{right}.pattern_and"))
        return F.bit_count(differing.bitwiseAND(F.bitwise_not(shared[0].bitwiseOR(shared[1]))))

    keys = ["arrangement", "lead"]
    x, y = uppers.alias("x"), uppers.alias("y")
    same = reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys])
    near = x.join(y, same & (F.col("x.upper") <= F.col("y.upper")) & (apart("x", "y") <= distance))
    near = near.select(*[F.col(f"x.{k}") for k in keys], F.col("x.upper").alias("upper"), F.col("y.upper").alias("other_upper"))
    left = leaves.join(near, [*keys, "upper"]).alias("x")
    right = leaves.withColumnRenamed("upper", "other_upper").alias("y")
    at = reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*keys, "other_upper"]])
    pairs = left.join(right, at & (F.col("x.leaf") < F.col("y.leaf")) & (apart("x", "y") <= distance))
    across = pairs.select(F.col("x.fps").alias("fps"), F.col("y.fps").alias("other")).mapInArrow(_pairs(distance), EDGE)
    return found.where("fps is null").select("a", "b").union(across).distinct()


def groups(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, fp, component (smallest fingerprint of its group) and
    component_id (smallest doc_id of its group).

    Two documents are linked when their fingerprints differ in at most ``distance`` bits. Exact and repeated
    copies share a fingerprint and meet as one entry of the index. Null and empty texts have fingerprint 0 and
    are linked like any other. A null doc_id keeps its row and never is the smallest, unless all are null.
    No documents give no rows; other columns of ``docs`` are not read.
    """
    marked = cut(fingerprints(docs, width), "fingerprints")
    entries = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "entries")
    stars = components(links(entries.select("fp"), distance))
    named = entries.join(stars.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = named.join(smallest, "component").select("fp", "component", "component_id")
    return marked.join(labels, "fp").select(*KEYS, "fp", "component", "component_id")


def one_of_each(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the document with the smallest doc_id stays.

    If the smallest doc_id stands on rows with different texts, the smallest text hash of them stays, and of
    rows that agree in both, one. Columns are returned as they came.
    """
    placed = groups(docs, width, distance)
    per_key = placed.groupBy(*KEYS, "component").agg(F.count(F.lit(1)).alias("copies"))
    ranked = per_key.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "copies")).alias("stays")
    )
    stays = cut(ranked.select("stays.doc_id", "stays.text_key", "stays.copies"), "stays")
    once = with_decisions(docs, stays.where("copies = 1").drop("copies"), "left_semi")
    repeated = stays.where("copies > 1").drop("copies")
    if not repeated.isEmpty():
        once = once.union(with_decisions(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
    return once
