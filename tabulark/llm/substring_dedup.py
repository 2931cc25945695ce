"""Passages that occur more than once, by anchored window hashes in place of a greedy relative Lempel-Ziv parse.

Every document is parsed from left to right into phrases. A phrase is a run of windows (``width`` consecutive
words) that share their smallest word group, its anchor; equal windows have equal anchors wherever they stand.
The phrases of all documents, dealt by anchor, are the reference blocks, and each document's phrases are looked up in
the block that holds their anchor. A phrase that occurs elsewhere whole continues its document's factor: all its windows are
duplicates. An anchor that stands in different phrases marks a factor boundary: there the windows of
each different phrase are looked up one by one, so no passage is lost where factors meet. Factors of at least one
window become duplicate spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.llm.common import KEYS, free_names, keyed, text_key, text_key_of
from tabulark.scratch import cut

# Words of the groups among which a window's anchor is the smallest.
GROUP = 8
# Windows parsed at a time, which bounds a worker's memory on long documents.
STEP = 1 << 16
# An odd multiplier and its inverse modulo 2**64, for hashes of word runs from running sums.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
# Bits for each text of a table that few texts are in, and the bits there are at least and at most.
SPARE = 8
FEWEST_BITS, MOST_BITS = 1 << 15, 1 << 29
# Windows of one phrase at most, as they are marked by the bits of a number.
MARKS = 60


def words_of(data: bytes) -> list[bytes]:
    """Words between blanks, tabs, line ends, vertical tabs, form feeds and carriage returns."""
    return data.split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of any run of words of one stretch, from running sums."""

    def __init__(self, words: list[bytes]):
        h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        powers = np.cumprod(np.full(len(h), BASE, np.uint64))
        self.back = np.cumprod(np.full(len(h), INVERSE, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers)])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        run = (self.sums[start + length] - self.sums[start]) * self.back[start]
        return _mixed(run + np.asarray(length).astype(np.uint64))


def phrases_of(words: list[bytes], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, whole-phrase hash, first window, windows) arrays, for one stretch of windows after the other."""
    total = len(words) - width + 1
    span = width - GROUP + 1
    for low in range(0, max(total, 0), STEP):
        count = min(STEP, total - low)
        runs = Runs(words[low : low + count + width - 1])
        groups = runs.of(np.arange(count + span - 1), GROUP)
        smallest = np.lib.stride_tricks.sliding_window_view(groups, span).argmin(axis=1) + np.arange(count)
        part = (smallest - np.arange(count)) // MARKS
        first = np.nonzero(np.diff(smallest, prepend=-1) | np.diff(part, prepend=0))[0]
        windows = np.diff(np.append(first, count))
        yield groups[smallest[first]], runs.of(first, windows + width - 1), first + low, windows


PHRASE = "doc_id bigint, text_key bigint, anchor bigint, phrase bigint, first int, windows int"
WINDOW = "anchor bigint, phrase bigint, copies bigint, place int, window bigint"


def _parse(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for anchor, phrase, first, windows in phrases_of(words_of(text.as_py()), width):
                    n = len(first)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([doc_id] * n, pa.int64()),
                            "text_key": pa.array([key] * n, pa.int64()),
                            "anchor": anchor.view(np.int64),
                            "phrase": phrase.view(np.int64),
                            "first": first.astype(np.int32),
                            "windows": windows.astype(np.int32),
                        }
                    )

    return run


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                words = words_of(text.as_py())
                wanted.sort(key=lambda p: p["first"])
                for at in range(0, len(wanted), 2000):
                    some = wanted[at : at + 2000]
                    low = some[0]["first"]
                    runs = Runs(words[low : some[-1]["first"] + some[-1]["windows"] + width - 1])
                    counts = np.array([p["windows"] for p in some])
                    places = np.concatenate([np.arange(c) for c in counts])
                    starts = np.repeat([p["first"] - low for p in some], counts) + places
                    yield pa.RecordBatch.from_pydict(
                        {
                            "anchor": np.repeat(np.array([p["anchor"] for p in some], np.int64), counts),
                            "phrase": np.repeat(np.array([p["phrase"] for p in some], np.int64), counts),
                            "copies": np.repeat(np.array([p["copies"] for p in some], np.int64), counts),
                            "place": places.astype(np.int32),
                            "window": runs.of(starts, width).view(np.int64),
                        }
                    )

    return run


def with_likely(texts: DataFrame, key: Column, table: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: whether the text with this key may be in the written ``table``; never false for one that is.

    A bitmap of one or two bytes for each text of the table is broadcast, 64 MB at most. So only texts that are
    likely to find their rows are moved to them.
    """
    bits = min(max(1 << (SPARE * table.count()).bit_length(), FEWEST_BITS), MOST_BITS)
    slot = lambda k: F.pmod(k, F.lit(bits))
    part, bitmap = free_names(texts, "part", "bitmap")
    marks = table.select(slot(F.col("text_key")).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias(part))
    marks = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias(bitmap))
    place = F.bitmap_bit_position(slot(key))
    byte = F.substring(F.col(bitmap), F.floor(place / 8).cast("int") + 1, F.lit(1))
    found = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")) == 1
    met = texts.join(F.broadcast(marks), F.bitmap_bucket_number(slot(key)) == F.col(part), "left")
    return met.select(*[texts[f"`{c}`"] for c in texts.columns], F.coalesce(found, F.lit(False)).alias(name))


def repeated_windows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, firsts, bits): per document, phrase starts and, as bits, which windows from there repeat."""
    rows = keyed(docs).select(*KEYS, F.col("text").cast("binary").alias("data"))
    phrases = cut(rows.mapInArrow(_parse(width), PHRASE), "phrases")
    anchors = phrases.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("phrase").alias("least"), F.max("phrase").alias("most")
    )
    anchors = anchors.where("n > 1").select("anchor", (F.col("least") != F.col("most")).alias("boundary"))
    found = cut(phrases.join(anchors, "anchor"), "repeated")
    one = F.lit(1).cast("bigint")
    whole = F.call_function("shiftleft", one, F.col("windows")) - 1
    inside = found.where("not boundary").select(*KEYS, "first", whole.alias("bits"))

    # At a factor boundary one stretch of text stands for all equal phrases, counted as often as they occur.
    edges = found.where("boundary")
    single = edges.groupBy("anchor", "phrase").agg(
        F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in (*KEYS, "first", "windows")]
    )
    asked = F.collect_list(F.struct("anchor", "phrase", "copies", "first", "windows"))
    wanted = cut(single.groupBy(*KEYS).agg(asked.alias("wanted")), "boundaries")
    likely = with_likely(rows, rows["text_key"], wanted, "likely").where("likely")
    # A row's list has no bound, so however few rows there are they are not broadcast.
    asking = wanted.select(F.col("doc_id").alias("by_id"), F.col("text_key").alias("by_key"), "wanted").hint("merge")
    held = likely.join(asking, F.col("doc_id").eqNullSafe(F.col("by_id")) & (F.col("text_key") == F.col("by_key"))).select("data", "wanted")
    windows = cut(held.mapInArrow(_windows(width), WINDOW), "windows")
    again = windows.groupBy("anchor", "window").agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
    mark = F.call_function("shiftleft", one, F.col("place"))
    marks = windows.join(again, ["anchor", "window"]).groupBy("anchor", "phrase").agg(F.bit_or(mark).alias("bits"))
    outside = edges.join(marks, ["anchor", "phrase"]).select(*KEYS, "first", "bits")

    places = inside.union(outside).groupBy(*KEYS, "first").agg(F.bit_or("bits").alias("bits"))
    listed = places.groupBy(*KEYS).agg(F.collect_list(F.struct("first", "bits")).alias("places"))
    return listed.select(*KEYS, F.col("places.first").alias("firsts"), F.col("places.bits").alias("bits"))


def covered(n_words: int, firsts: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window that begins at a marked place."""
    steps = np.zeros(n_words + 1, np.int64)
    marked = (bits[:, None] >> np.arange(MARKS)) & 1 == 1
    starts = (firsts[:, None] + np.arange(MARKS))[marked]
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps[:-1]) > 0


REMOVAL = "n_words bigint, n_removed bigint, kept binary, span_starts array<bigint>, span_lengths array<bigint>"


def _removal(width: int):
    @F.pandas_udf(REMOVAL)
    def remove(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, firsts, bits in parts:
            rows = []
            for data, first, bit in zip(texts, firsts, bits):
                words = words_of(bytes(data))
                if first is None:
                    rows.append((len(words), 0, b" ".join(words), [], []))
                    continue
                gone = covered(len(words), np.asarray(first, np.int64), np.asarray(bit, np.int64), width)
                edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
                starts = np.nonzero(edge == 1)[0]
                kept = b" ".join(compress(words, (~gone).tolist()))
                rows.append((len(words), int(gone.sum()), kept, starts, np.nonzero(edge == -1)[0] - starts))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "span_starts", "span_lengths"])

    return remove


def without_repeats(docs: DataFrame, width: int = 35, name: str = "dedup") -> DataFrame:
    """The rows of ``docs`` with a column ``name`` added (in place of one so called): what to keep of each text.

    It holds n_words, n_removed, kept (UTF-8 of the remaining words, joined by one space) and the removed spans in words
    (span_starts, span_lengths). A word is removed when a window of ``width`` words over it also begins anywhere else
    in the input, in the same or another document; every occurrence goes, the first included, and all windows
    are judged on the input.

    A null or empty text has no words. Rows that repeat a text remove each other's windows. Texts shorter than a window
    are kept whole. No rows give none.
    """
    places = cut(repeated_windows(docs, width), "places")
    remove = _removal(width)
    others = [c for c in docs.columns if c != name]
    likely, data, firsts, bits, by_id, by_key = free_names(docs, "likely", "data", "firsts", "bits", "by_id", "by_key")
    known = with_likely(docs, text_key_of(docs), places, likely)
    # Texts without repeats stay where they are; the others meet their places, whose lists have no bound.
    found = places.toDF(by_id, by_key, firsts, bits).hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col(by_id)) & (text_key() == F.col(by_key))
    moved = known.where(F.col(likely)).join(found, same, "left")
    rest = known.where(~F.col(likely))

    def laid(rows: DataFrame, first: Column, bit: Column) -> DataFrame:
        whole = F.coalesce("text", F.lit("")).cast("binary")
        return rows.select(*[F.col(f"`{c}`") for c in others], whole.alias(data), first.alias(firsts), bit.alias(bits))

    none = lambda kind: F.lit(None).cast(f"array<{kind}>")
    both = laid(moved, F.col(firsts), F.col(bits)).union(laid(rest, none("int"), none("bigint")))
    return both.select(*[F.col(f"`{c}`") for c in others], remove(F.col(data), F.col(firsts), F.col(bits)).alias(name))
