"""Embedding near-duplicates: exact cosine links inside a label by tiles of vectors in PCA order.

Unit vectors are turned into the basis of their principal components, so that the leading dimensions hold most of a
product. Vectors of a label are sorted by the first one and cut into tiles; two tiles whose ranges of it are too far
apart cannot hold a link. For a pair of tiles the leading dimensions are multiplied first. What the
others can add is at most the product of the suffix norms (Cauchy-Schwarz), and pairs that cannot reach the
threshold any more are dropped before the next dimensions. The remaining pairs are judged by the cosine of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.llm.components import components
from tabulark.scratch import cut

# Vectors of a tile, and dimensions that are added at a time.
TILE, STEP = 1024, 16
# Rounding that the bounds allow for; the last check is made without it.
SLACK = 1e-9


def can_link() -> Column:
    """Whether a row has a label and a vector of finite numbers that are not all zero."""
    doubles = F.col("embedding").cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & nonzero, F.lit(False))


def usable(rows: DataFrame) -> DataFrame:
    """Distinct (label, vector) with their count and smallest id, of the rows that can be linked."""
    good = rows.where(can_link()).groupBy("label", "embedding")
    return good.agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension of the vectors, the axes by falling second moment; d * d sums per task and dimension."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for size in set(map(len, rows)):
                x = unit(np.array([r for r in rows if len(r) == size], np.float64))
                sums[size] = sums.get(size, 0) + x.T @ x
        for size, total in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"size": pa.array([size] * size, pa.int32()), "i": pa.array(range(size), pa.int32()), "sums": pa.array(total.tolist(), pa.list_(pa.float64()))}
            )

    parts = vectors.select("embedding").mapInArrow(moments, "size int, i int, sums array<double>")
    cells = parts.select("size", "i", F.posexplode("sums").alias("j", "x")).groupBy("size", "i", "j").agg(F.sum("x").alias("x"))
    axes: dict[int, np.ndarray] = {}
    for row in cells.collect():
        axes.setdefault(row["size"], np.zeros((row["size"], row["size"])))[row["i"], row["j"]] = row["x"]
    return {size: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for size, m in axes.items()}


TILE_ROW = "label int, size int, tile bigint, low double, high double, groups binary, copies binary, vectors binary"


def _tiles(axes: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def close() -> pa.RecordBatch:
            nonlocal number
            vectors = np.array([r["embedding"] for r in held], np.float64)
            lead = unit(vectors) @ axes[vectors.shape[1]][:, 0]
            number += 1
            row = {
                "label": held[0]["label"], "size": vectors.shape[1], "tile": (part << 32) + number, "low": lead.min(), "high": lead.max(),
                "groups": np.array([r["group"] for r in held], "<i8").tobytes(), "copies": np.array([r["n"] for r in held], "<i8").tobytes(),
                "vectors": vectors.tobytes(),
            }
            held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], names=list(row))

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == TILE or held[0]["label"] != row["label"] or len(held[0]["embedding"]) != len(row["embedding"])):
                    yield close()
                held.append(row)
        if held:
            yield close()

    return run


def near(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of unit vectors whose product may reach the threshold; all that reach it are among them."""
    u, v = x @ axes, y @ axes
    tail_u = np.sqrt(np.cumsum((u * u)[:, ::-1], axis=1)[:, ::-1])
    tail_v = np.sqrt(np.cumsum((v * v)[:, ::-1], axis=1)[:, ::-1])
    size, sums, rows, cols = u.shape[1], None, None, None
    for low in range(0, size, STEP):
        high = min(size, low + STEP)
        if rows is None:
            sums = u[:, low:high] @ v[:, low:high].T
            bound = sums + (tail_u[:, high][:, None] * tail_v[:, high][None, :] if high < size else 0)
            rows, cols = np.nonzero(bound >= threshold - SLACK)
            sums = sums[rows, cols]
        else:
            sums = sums + np.einsum("ij,ij->i", u[rows, low:high], v[cols, low:high])
            bound = sums + (tail_u[rows, high] * tail_v[cols, high] if high < size else 0)
            keep = bound >= threshold - SLACK
            rows, cols, sums = rows[keep], cols[keep], sums[keep]
        if not len(rows):
            break
    return rows, cols


LINKS = "node bigint, other bigint, links bigint"


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                sides = []
                for s in ("", "other_"):
                    vectors = np.frombuffer(pair[f"{s}vectors"]).reshape(-1, pair["size"])
                    sides.append((unit(vectors), np.frombuffer(pair[f"{s}groups"], "<i8"), np.frombuffer(pair[f"{s}copies"], "<i8")))
                (x, gx, nx), (y, gy, ny) = sides
                own = pair["tile"] == pair["other_tile"]
                counts, all_rows, all_cols = np.zeros((2, max(len(x), len(y))), np.int64), [], []
                for low in range(0, len(x), 256):
                    rows, cols = near(x[low : low + 256], y, axes[pair["size"]], threshold)
                    rows = rows + low
                    keep = rows < cols if own else np.ones(len(rows), bool)
                    rows, cols = rows[keep], cols[keep]
                    keep = np.einsum("ij,ij->i", x[rows], y[cols]) >= threshold
                    all_rows.append(rows[keep])
                    all_cols.append(cols[keep])
                rows, cols = np.concatenate(all_rows), np.concatenate(all_cols)
                counts[0, : len(x)] = np.bincount(rows, ny[cols], len(x))
                counts[1, : len(y)] = np.bincount(cols, nx[rows], len(y))
                # Each vector with its links here and one partner of each, the smallest; that connects what is linked.
                node = np.concatenate([gx, gy])
                label = np.arange(len(node))
                while True:
                    before = label.copy()
                    np.minimum.at(label, rows, label[cols + len(gx)])
                    np.minimum.at(label, cols + len(gx), label[rows])
                    label = label[label]
                    if (label == before).all():
                        break
                links = np.concatenate([counts[0, : len(x)], counts[1, : len(y)]])
                at = np.nonzero(links)[0]
                yield pa.RecordBatch.from_pydict({"node": node[at], "other": node[label[at]], "links": links[at]})
                if own and len(rows):
                    # The two sides are one tile here: tie each vector to itself on the other side.
                    both = np.nonzero(links[: len(x)] | links[len(x) :])[0]
                    yield pa.RecordBatch.from_pydict({"node": node[label[both]], "other": node[label[both + len(x)]], "links": np.zeros(len(both), np.int64)})

    return run


def linked(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per row of ``rows`` (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Two rows are linked when they have the same label, which is not null, and the cosine of their vectors in
    double precision is at least the threshold. ``n_links`` counts the other rows linked directly, ``component_id`` is
    the smallest vec_id reachable, ``kept`` says that it is the row's own. Vectors that are null, empty, zero or
    hold null or non-finite numbers, and those of different lengths, are linked with nothing. Equal vectors are
    compared once and counted as often as they occur; a repeated row is a row of its own. A null vec_id keeps its row.
    No rows give none; other columns are not read.
    """
    rows = rows.select("vec_id", "label", "embedding")
    distinct = usable(rows).withColumn("group", F.xxhash64("label", "embedding"))
    distinct = cut(distinct, "distinct-vectors")
    axes = principal_axes(distinct)
    order = F.element_at("embedding", 1)
    if axes:
        main = F.array(*[F.lit(float(v)) for v in axes[max(axes)][:, 0]])
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        order = F.aggregate(F.zip_with("embedding", main, lambda x, m: x * m), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / norm
    keys = ["label", "dims", "lead", "group"]
    in_order = distinct.withColumn("lead", order).withColumn("dims", F.size("embedding"))
    in_order = in_order.repartitionByRange(*keys).sortWithinPartitions(*keys).select("label", "embedding", "group", "n")
    tiles = cut(in_order.mapInArrow(_tiles(axes), TILE_ROW), "tiles")
    # Unit vectors with this cosine are at most so far apart, and so are their leading coordinates.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    x, y = tiles.alias("x"), tiles.alias("y")
    close = F.expr("x.label = y.label and x.size = y.size and x.tile <= y.tile")
    close = close & (F.col("y.low") <= F.col("x.high") + reach) & (F.col("x.low") <= F.col("y.high") + reach)
    pairs = x.join(y, close).select(
        "x.size", "x.tile", "x.groups", "x.copies", "x.vectors",
        *[F.col(f"y.{c}").alias(f"other_{c}") for c in ("tile", "groups", "copies", "vectors")],
    )
    pairs = pairs.repartition(F.xxhash64("tile", "other_tile"))
    found = cut(pairs.mapInArrow(_compare(axes, threshold), LINKS), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    stars = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = distinct.select("label", "embedding", "group", "first_id", "n")
    named = named.join(counts.withColumnRenamed("node", "group"), "group", "left")
    named = named.join(stars.withColumnRenamed("node", "group"), "group", "left")
    named = named.withColumn("component", F.coalesce("component", "group"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select(
        "group", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    marked = rows.select("vec_id", F.when(can_link(), F.xxhash64("label", "embedding")).alias("group"))
    joined = marked.join(named, "group", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
