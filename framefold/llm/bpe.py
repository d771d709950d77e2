"""Byte-level BPE by monoid tree reduction.

Encodings of byte strings form a monoid: the product of two encodings is the encoding of the joined bytes.
A match of the splitting pattern is halved until its parts are short, the parts are merged directly, and
neighbours are joined by re-encoding a window of tokens at their border.  The window doubles until the
tokens next to it provably stay: a token sequence is the encoding of its bytes if and only if every pair of
neighbours is its own encoding (no merge can then cross a border before it would in the pair alone).  All
pairs inside a half or the window are so already; only the window's two ends are tried.  So a match of n
bytes takes about n log n steps, and n log^2 n where windows grow to the whole, as in runs of one
character.  Decoding concatenates the tokens' bytes up the same tree.

The ranks come from a file whose path is a parameter; each Python worker reads it once.

Defined cases: a null text is empty; an empty one has no tokens; special tokens' strings are ordinary text; a very long
text or match is encoded whole; rows with one doc_id twice, or none, are encoded each; an empty table gives an empty
result; other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold.llm.common import sliced

#: Bytes that are merged directly: a leaf of the tree; and from how many on a window is merged by a heap.
LEAF, HEAP = 8, 192
#: Tokens that decoding joins at once, a leaf of its tree.
LEAVES = 32
#: Distinct matches that a worker remembers, and the longest of them in characters; bounds its memory.
REMEMBERED, LONGEST = 400_000, 64
_NONE = sys.maxsize


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Ranks:
    """Tokens by rank, and the merges: (rank, rank) to the rank of the joined bytes."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        singles = [self.ranks[bytes([b])] for b in range(256)]
        if sorted(singles) != list(range(256)):
            raise ValueError(f"{path}: the ranks of single bytes must be 0 to 255")
        self.singles = bytes(singles)
        ranks = self.ranks
        self.merges = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.kept: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding, by merging the pair of least rank, the leftmost first, while there is one."""
        ids = list(data.translate(self.singles))
        if len(ids) > HEAP:
            return self._merged_by_heap(ids)
        get = self.merges.get
        open_ = [get(pair, _NONE) for pair in zip(ids, ids[1:], strict=False)]
        while open_ and (least := min(open_)) != _NONE:
            i = open_.index(least)
            ids[i : i + 2] = [least]
            del open_[i]
            if i:
                open_[i - 1] = get((ids[i - 1], least), _NONE)
            if i < len(open_):
                open_[i] = get((least, ids[i + 1]), _NONE)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        """The same for long strings: runs of one character change their tokens over their whole length when joined."""
        n, get = len(ids), self.merges.get
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n + 1)
        heap = [(rank, i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (rank := get(pair)) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if gone[i] or j >= n or get((ids[i], ids[j])) != rank:
                continue  # one of the two has merged meanwhile
            ids[i], gone[j], after[i] = rank, 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (rank := get((ids[left], ids[after[left]]))) is not None:
                    heappush(heap, (rank, left))
        return [x for i, x in enumerate(ids) if not gone[i]]

    def stays(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their joined bytes."""
        known = self.kept.get((left, right))
        if known is None:
            if len(self.kept) > REMEMBERED:
                self.kept.clear()
            known = self.kept[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The product: the encoding of the bytes of left and right."""
        if not left or not right:
            return left or right
        window = 1
        while True:
            i, j = max(0, len(left) - window), min(len(right), window)
            middle = self.merged(self.decoded(left[i:]) + self.decoded(right[:j]))
            if (not i or self.stays(left[i - 1], middle[0])) and (j == len(right) or self.stays(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            window *= 2

    def encoded(self, data: bytes) -> list[int]:
        """The encoding of one match, up the tree."""
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.encoded(data[:half]), self.encoded(data[half:]))

    def decoded(self, ids: list[int]) -> bytes:
        return concatenated(list(map(self.tokens.__getitem__, ids)))


def concatenated(tokens: list[bytes]) -> bytes:
    """Tokens' bytes up the tree: runs of LEAVES first, then neighbours, level by level."""
    parts = [b"".join(tokens[i : i + LEAVES]) for i in range(0, len(tokens), LEAVES)]
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else b""


@lru_cache(maxsize=4)
def loaded(path: str) -> Ranks:
    return Ranks(path)


class Matches(dict):
    """Match to what `shown` makes of its ids; filled as matches occur."""

    def __init__(self, ranks: Ranks, shown) -> None:
        super().__init__()
        self.ranks, self.shown = ranks, shown

    def __missing__(self, match: str):
        made = self.shown(self.ranks.encoded(match.encode()))
        if len(match) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[match] = made
        return made


@lru_cache(maxsize=4)
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


@lru_cache(maxsize=4)
def _decimal(path: str) -> tuple[Matches, dict[str, bytes]]:
    ranks = loaded(path)
    return Matches(ranks, lambda ids: " ".join(map(str, ids))), {str(i): t for i, t in ranks.tokens.items()}


@lru_cache(maxsize=4)
def _packed(path: str) -> Matches:
    return Matches(loaded(path), lambda ids: np.array(ids, "<u4").tobytes())


def packed_ids(text: str, path: str, pattern: str) -> bytes:
    """A text's ids as little-endian unsigned 32-bit numbers."""
    return b"".join(map(_packed(path).__getitem__, splitter(pattern).findall(text)))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the tokens of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [np.frombuffer(packed_ids(x or "", path, pattern), "<u4") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids).  Bytes, as the ids of a part of a text need not be whole characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = loaded(path)
        for batch in sliced(batches):
            made = [ranks.decoded(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "bytes"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text and decodes the ids, up the tree, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches, tokens = _decimal(path)
        find = splitter(pattern).findall
        for batch in sliced(batches):
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = " ".join(map(matches.__getitem__, find(text or "")))
                each = ids.split()
                counts.append(len(each))
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(concatenated(list(map(tokens.__getitem__, each)))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
