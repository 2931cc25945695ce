"""SentencePiece vocabularies: encoding by a streaming Viterbi search, decoding by a table.

The best segmentation maximises the sum of the pieces' scores. The search keeps scores only for a window of the longest
piece, and backpointers only since the last committed boundary. Ids are committed whenever all paths that can still
win pass one boundary: at once where no piece crosses it, else where the backpointers of the window meet.
Memory is bounded by that distance, not by the text. Characters without a piece cost more than any piece and become their
bytes' pieces.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

SPACE = "▁"
# Added to the lowest score for a character that has no piece.
UNKNOWN_PENALTY = 10.0
LEAST = float("-inf")
# Encoded stretches a worker remembers at most, and the longest it remembers.
REMEMBERED, LONGEST = 1 << 19, 64
# Up to this length the next merge is looked for among all neighbours, beyond it in a heap; no score is as bad as NEVER.
SCANNED, NEVER = 32, float("inf")


class Vocabulary:
    """Pieces with scores, from a model file that every executor can read."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes_ids = [0] * 256
        self.spelled: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_ids[int(piece[1:-1], 16)] = i
                self.spelled.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.spelled.append(b"")
            else:
                self.pieces[piece] = (i, model.get_score(i))
                self.spelled.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.pieces), default=1)
        # One level per character; a piece's score and id stand under the empty text.
        self.tree: dict = {}
        for piece, (i, score) in self.pieces.items():
            node = self.tree
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = (score, (i,))
        usual = [score for _, score in self.pieces.values() if score > -1e8]
        self.unknown = min(usual, default=0.0) - UNKNOWN_PENALTY


def viterbi(text: Iterable[str], vocabulary: Vocabulary) -> Iterator[list[int]]:
    """Ids of a stream of characters, committed boundary by boundary."""
    tree, longest = vocabulary.tree, vocabulary.longest
    stream, more = iter(text), True
    ahead, here = "", 0  # a few longest pieces of characters, and the next position's place among them
    base, at, reach = 0, 0, 0  # last committed boundary, next position, farthest end of a piece so far
    score: dict[int, float] = {0: 0.0}
    back: dict[int, tuple[int, tuple[int, ...]]] = {}

    def path(end: int) -> list[int]:
        found = []
        while end > base:
            end, ids = back[end]
            found.append(ids)
        return [i for ids in reversed(found) for i in ids]

    while True:
        if more and len(ahead) - here < longest:
            read = "".join(islice(stream, 4 * longest))
            ahead, here, more = ahead[here:] + read, 0, len(read) == 4 * longest
        if here == len(ahead):
            break
        own, node, end = score.pop(at), tree, at
        for char in ahead[here : here + longest]:
            if (node := node.get(char)) is None:
                break
            end += 1
            if (hit := node.get("")) is not None:
                total = own + hit[0]
                if end > reach:
                    reach = end
                if total > score.get(end, LEAST):
                    score[end], back[end] = total, (at, hit[1])
        if ahead[here] not in vocabulary.pieces:
            end, total = at + 1, own + vocabulary.unknown
            reach = max(reach, end)
            if total > score.get(end, LEAST):
                score[end] = total
                back[end] = (at, tuple(vocabulary.bytes_ids[b] for b in ahead[here].encode("utf-8", "surrogatepass")))
        here, at = here + 1, at + 1
        meet = at
        if reach > at:
            if at - base < 4 * longest or (at - base) % longest:
                continue
            live = set(score)
            while len(live) > 1:  # the backpointers of the window, down to where they meet
                last = max(live)
                live.discard(last)
                live.add(back[last][0])
            meet = live.pop()
        if meet > base:
            yield path(meet)
            base = meet
            back = {end: link for end, link in back.items() if end > base}
    if at > base:
        yield path(at)


class Encoder:
    """Whole texts to ids; stretches between certain boundaries are remembered."""

    # No piece has a space after another character or a line feed, so paths always meet there.
    stretches = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")

    def __init__(self, model_file: str):
        self.vocabulary = Vocabulary(model_file)
        if any(SPACE in piece.lstrip(SPACE) or "\n" in piece for piece in self.vocabulary.pieces):
            self.stretches = re.compile("(?s).+")
        self.known: dict[str, bytes] = {}

    def _encode(self, stretch: str) -> bytes:
        ids = [i for part in viterbi(stretch, self.vocabulary) for i in part]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, which is read with a space before it."""
        if not text:
            return b""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        stretches = self.stretches.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(known.get, stretches))
        if None in found:
            for at, ids in enumerate(found):
                if ids is None:
                    stretch = stretches[at]
                    found[at] = ids = known.get(stretch) or self._encode(stretch)
                    if len(stretch) <= LONGEST:
                        known[stretch] = ids
        return b"".join(found)


class Merges(Encoder):
    """Whole texts to the ids of the model's own merges: of all neighbours that form a piece the best score goes first, then the leftmost.

    No merge crosses a boundary between stretches, nor one between two characters that no piece has side by side.
    Short stretches need no heap: their few neighbours are looked through after each merge.
    """

    def __init__(self, model_file: str):
        super().__init__(model_file)
        self.beside = {piece[i : i + 2] for piece in self.vocabulary.pieces for i in range(len(piece) - 1)}
        # The smallest goes first.
        self.ranks = {piece: -score for piece, (_, score) in self.vocabulary.pieces.items()}
        self.packed = {piece: struct.pack("<I", i) for piece, (i, _) in self.vocabulary.pieces.items()}

    def _encode(self, stretch: str) -> bytes:
        beside, known, found, low = self.beside, self.known, [], 0
        pairs = [a + b for a, b in zip(stretch, stretch[1:])]
        if beside.issuperset(pairs):
            return self._merged(stretch, pairs)
        for at, pair in enumerate([*pairs, ""], 1):
            if pair not in beside:
                part = stretch[low:at]
                ids = known.get(part)
                if ids is None:
                    ids = self._merged(part, pairs[low : at - 1])
                    if len(part) <= LONGEST:
                        known[part] = ids
                found.append(ids)
                low = at
        return b"".join(found)

    def _merged(self, text: str, pairs: list[str]) -> bytes:
        """The ids of a text with these neighbours side by side, four bytes each."""
        parts, rank = list(text), self.ranks.get
        if len(text) > SCANNED:
            parts, pairs = self._heaped(text), []
        ranks = [rank(pair, NEVER) for pair in pairs]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            parts[at] = whole = parts[at] + parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + whole, NEVER)
            if at < len(ranks):
                ranks[at] = rank(whole + parts[at + 1], NEVER)
        try:
            return b"".join([self.packed[part] for part in parts])
        except KeyError:
            return b"".join([self.packed.get(part) or self._bytes(part) for part in parts])

    def _bytes(self, part: str) -> bytes:
        ids = [self.vocabulary.bytes_ids[b] for b in part.encode("utf-8", "surrogatepass")]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _heaped(self, text: str) -> list[str]:
        pieces, n = self.vocabulary.pieces, len(text)
        parts, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(left: int):
            if left >= 0 and after[left] < n and (hit := pieces.get(whole := parts[left] + parts[after[left]])):
                heappush(heap, (-hit[1], left, len(whole)))

        for left in range(n):
            offer(left)
        while heap:
            _, left, size = heappop(heap)
            right = after[left]
            # Since the offer one of the two may have been merged.
            if not parts[left] or right >= n or len(parts[left]) + len(parts[right]) != size:
                continue
            parts[left], parts[right] = parts[left] + parts[right], ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left])
            offer(left)
        return list(filter(None, parts))


@lru_cache(maxsize=1)
def merges_of(model_file: str) -> Merges:
    """One encoder per worker process, as ``encoder_of``."""
    return Merges(model_file)


@lru_cache(maxsize=1)
def encoder_of(model_file: str) -> Encoder:
    """One encoder per worker process, which keeps its vocabulary and what it remembers from task to task."""
    return Encoder(model_file)


@lru_cache(maxsize=1)
def spelled_of(model_file: str) -> list[bytes]:
    """The bytes of every id, read once per worker process."""
    return Vocabulary(model_file).spelled


def encoded(model_file: str):
    """Column function: the ids of a text as little-endian unsigned 32-bit numbers.

    A null text gives null, an empty one no ids.
    """

    @F.pandas_udf("binary")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(model_file)
        for texts in parts:
            yield pd.Series([None if t is None else encoder.ids(t) for t in texts], dtype=object)

    return encode


def merged(model_file: str):
    """Column function: the ids that the model's merges give, as little-endian unsigned 32-bit numbers; null stays null."""

    @F.pandas_udf("binary")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = merges_of(model_file)
        for texts in parts:
            yield pd.Series([None if t is None else encoder.ids(t) for t in texts], dtype=object)

    return encode


def decoded(model_file: str):
    """Column function: the text of such ids. A space sign in the original text comes back as a space; null stays null."""

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spelled = spelled_of(model_file)
        for column in parts:
            texts = []
            for ids in column:
                if ids is None:
                    texts.append(None)
                    continue
                data = b"".join(map(spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))
                texts.append(data.removeprefix(b" ").decode("utf-8", "replace"))
            yield pd.Series(texts, dtype=object)

    return decode
