"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

The classes are the capacities 1/1, 1/2, 1/4, ... 1/capacity of a sequence. A document is cut into
whole sequences and, for the rest, at most one piece of each smaller class, so that a piece always has exactly
the size of its class and a bin of class 1/k is full with exactly k pieces. Every task fills its own bins,
one open bin for each class, without a shuffle. What is left in the open bins when a task ends becomes sequences
whose lengths are powers of two. So no sequence needs padding, whatever the number of tasks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tokens of the vocabulary that are found in any text before the pattern cuts it; the rank file does not hold them.
ADDED = {"<|endoftext|>": 50256}
# Encoded words a worker remembers at most.
REMEMBERED = 1 << 19
PIECE = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
)
_TASK_BITS = 40


class WordIds(dict):
    """Token ids (little-endian unsigned 32-bit) of a space and a word, encoded on first use."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), "<u4").tobytes()
        self[word] = ids
        return ids


class ByteBpe:
    """Byte-level BPE of whole texts from a rank file; texts are cut where no token can cross, words are remembered.

    The pattern's tokens take one space in front of a word and leave a run of white space but for its last
    character together, so a space between a non-space and anything, or before a non-space, starts a new token.
    """

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.encode = encoding.encode_ordinary
        self.words = WordIds(self.encode)
        self.runs = re.compile(r"\s \s")
        self.borders = re.compile(r"(?<=\S)(?= \S)")

        self.added = {token: np.array([i], "<u4").tobytes() for token, i in ADDED.items()}
        self.marks = re.compile("|".join(map(re.escape, ADDED)))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; the parts between added tokens are encoded each for itself."""
        if not self.marks.search(text):
            return self._ids(text)
        parts, marks = self.marks.split(text), self.marks.findall(text)
        return self._ids(parts[0]) + b"".join(self.added[mark] + self._ids(part) for mark, part in zip(marks, parts[1:]))

    def _ids(self, text: str) -> bytes:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if self.runs.search(text):
            first, *rest = self.borders.split(text)
            rest = [part[1:] for part in rest]
        else:
            first, *rest = text.split(" ")
        head = np.array(self.encode(first), "<u4").tobytes()
        return head + b"".join(map(self.words.__getitem__, rest))


def sizes(tokens: int, capacity: int) -> list[int]:
    """Piece lengths of a document: whole sequences, then the powers of two in the rest, largest first."""
    whole, rest = divmod(tokens, capacity)
    return [capacity] * whole + [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]


class Bins:
    """The open bin of each class in one task, and the numbers of the sequences."""

    def __init__(self, task: int, capacity: int):
        self.next, self.capacity = task << _TASK_BITS, capacity
        self.open: dict[int, list[tuple]] = {}

    def _sequence(self, pieces: list[tuple], size: int) -> Iterator[tuple]:
        for place, piece in enumerate(pieces):
            yield (*piece, self.next, place * size)
        self.next += 1

    def put(self, size: int, piece: tuple) -> Iterator[tuple]:
        pieces = self.open.setdefault(size, [])
        pieces.append(piece)
        if len(pieces) * size == self.capacity:
            yield from self._sequence(pieces, size)
            self.open[size] = []

    def close(self) -> Iterator[tuple]:
        for size, pieces in self.open.items():
            low = 0
            for count in sizes(len(pieces), self.capacity):
                yield from self._sequence(pieces[low : low + count], size)
                low += count


def pack(docs: DataFrame, ranks: str, pattern: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers; the document's ids end with
    ``end_id``. ``start`` counts the document's ids before the piece, ``offset`` the sequence's. ``ranks`` and
    ``pattern`` name the vocabulary, a file that every executor can read. Lengths are powers of two up to
    ``capacity``, which must be one too.

    A null or empty text is its end id alone; repeated rows and null doc_ids are packed row by row. No rows
    give none, and other columns are not read. A retried task makes the same sequences again, as their numbers follow
    from the task's number and the order of its rows.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    schema = pa.schema(
        [(name, pa.binary() if name == "ids" else pa.int64()) for name in (part.split()[0] for part in PIECE.split(", "))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, bins = ByteBpe(ranks, pattern), Bins(TaskContext.get().partitionId(), capacity)
        end = np.array([end_id], "<u4").tobytes()
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.ids(text.as_py()) + end
                total, start = len(ids) // 4, 0
                for size in sizes(total, capacity):
                    out.extend(bins.put(size, (doc_id, start, size, ids[4 * start : 4 * (start + size)], total)))
                    start += size
                if len(out) >= 4096:
                    yield flushed()
        out.extend(bins.close())
        yield flushed()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECE)
