"""Packing documents into sequences of a fixed number of tokens by bin completion.

Documents are encoded and an end token is added; those longer than a sequence are cut into full pieces, of
which the first holds the rest.  What is packed are then lengths from 1 to `capacity`, so the problem is a
histogram with at most `capacity` entries, however many documents there are.  The driver solves that:

  Around the largest length left, the undominated fillings of a sequence are enumerated: least waste first,
  large lengths before small ones.  A filling is dominated if its lengths can be dealt into the lengths of
  one that was enumerated before.  Each filling is tried for as many copies as the counts allow, then for
  fewer, down to one; so a first dive takes about as many steps as there are lengths, and the search is
  complete.  Branches end when their waste, or the lengths over half that they leave, can't beat the best
  packing so far, or when what they leave was met before with no more sequences; best-fit decreasing gives
  the first packing.  The search ends when the number of sequences meets the lower bound (all tokens over the
  capacity, or the pieces of more than half), when all is tried, or after `steps` steps, with the best packing
  found.  `steps` is the only limit: it bounds the driver's time on histograms that can't be settled.

The packing is a list of patterns with counts: at most `steps` of a search, or some two for each length of
best-fit.  Pieces of one length are numbered (in salted parts, as any length may be hot), and a broadcast table
of ranges of numbers says which pattern, copy and offset a number stands for.  A pattern holds at most
sqrt(2 * capacity) different lengths, so at the defaults that table has under 400,000 rows, whatever the input.

Ids are those of the library that a tokenizer's json file is for: its vocabulary and its added tokens, which are
matched in a text before it is split.  They are found with a faster encoder that is built from the same file
(a file of ranks without added tokens will do, too); tests hold them against the library.

Defined cases: a null text is empty, and an empty text is its end token alone; a very long text is cut into
as many pieces as it needs; pieces that are alike in all columns may change places, and each has its own; rows
with one doc_id twice are packed each; a null doc_id is packed like any other; an empty table gives an empty
result; other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b
from itertools import islice
from math import isqrt

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold.llm.bpe import read_ranks
from framefold.llm.common import only, ranked, sliced, written

CAPACITY = 2048
#: Lengths of a filling, beside those that both have, for which every deal into another's is tried.
DEALT = 6
#: Nodes at the end of the search's path that keep what they enumerate.
LIVE = 64

Pattern = tuple[tuple[int, ...], int]


def byte_names() -> dict[str, int]:
    """The characters that stand for bytes in a json file's vocabulary: printable Latin-1 ones for themselves, and
    for the others those from 256 on, in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def read_tokenizer(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and added tokens of a tokenizer's json file, if it is byte-level BPE whose ids follow its merges."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, added, names = told["model"], told["added_tokens"], byte_names()
    plain = told.get("normalizer") is None and told["pre_tokenizer"]["type"] == "ByteLevel" and not told["pre_tokenizer"]["add_prefix_space"]
    if model["type"] != "BPE" or not plain or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: only plain byte-level BPE is read")
    special = {t["content"]: t["id"] for t in added}
    vocab = {token: rank for token, rank in model["vocab"].items() if token not in special}
    merges = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merges != sorted(merges):
        raise ValueError(f"{path}: ids must follow the merges")
    return {bytes(names[c] for c in token): rank for token, rank in vocab.items()}, special


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder for a tokenizer's json file, or for a file of ranks, which has no added tokens."""
    ranks, special = read_tokenizer(path) if path.endswith(".json") else (read_ranks(path), {})
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all full but the first."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))] if total else []


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): one row for each piece; keep_ids adds its ids, little-endian 32-bit."""
    mark = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path, pattern)
        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode_to_numpy(text or "", allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes() + mark
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(part), part), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)][: 5 + keep_ids], names=names[: 5 + keep_ids])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, for whole classes at a time: sequences of equal content move together."""
    rooms: list[int] = []  # ascending, those in use
    open_: dict[int, list[list]] = {}  # room: [[lengths], how many]

    def put(content: list[int], many: int, room: int) -> None:
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append([content, many])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                content, many = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
                if many > left:
                    put(content, many - left, room)
                    many = left
            else:
                room, content = capacity, []
                many = left if 2 * length > capacity else -(-left // (capacity // length))
            fits = 1 if content and room // length < 2 else min(room // length, max(1, left // many))
            put(content + [length] * fits, many, room - fits * length) if fits * many <= left else put(content + [length], many, room - length)
            left -= fits * many if fits * many <= left else many
    return [(tuple(content), many) for group in open_.values() for content, many in group]


def dominated(lengths: tuple[int, ...], by: tuple[int, ...]) -> bool:
    """Whether lengths can be dealt into those of `by`, each holding those dealt to it.

    Equal lengths take each other's place.  Of more than DEALT others only the best-fit deal is tried: a filling
    that is wrongly held to be undominated costs a step and changes no result.
    """
    small, large = Counter(lengths), Counter(by)
    same = small & large
    items, rooms = sorted((small - same).elements(), reverse=True), sorted((large - same).elements())
    if sum(items) > sum(rooms):
        return False
    few = len(items) <= DEALT

    def dealt(k: int) -> bool:
        if k == len(items):
            return True
        tried = set()
        for i in sorted(range(len(rooms)), key=rooms.__getitem__):
            if rooms[i] >= items[k] and rooms[i] not in tried:
                tried.add(rooms[i])
                rooms[i] -= items[k]
                if dealt(k + 1):
                    return True
                rooms[i] += items[k]
                if not few:
                    return False
        return False

    return dealt(0)


def fillings(room: int, counts: dict[int, int]) -> Iterator[tuple[int, ...]]:
    """The undominated fillings, least waste first, then those with the largest lengths."""
    return (found for found in tried_fillings(room, counts, room) if found is not None)


def tried_fillings(room: int, counts: dict[int, int], waste: int) -> Iterator[tuple[int, ...] | None]:
    """fillings() with no more than `waste`, and None for each that turned out to be dominated."""
    lengths = sorted(x for x in counts if x <= room)
    if not lengths:
        yield ()
        return
    if lengths[-1] == room:
        yield (room,)  # an exact single fit dominates all others
        return
    full = (1 << (room + 1)) - 1
    sums = [1]  # bit s of sums[i]: some of the i smallest lengths add up to s
    for x in lengths:
        bits, left, step = sums[-1], min(counts[x], room // x), 1
        while left:
            take = min(step, left)
            bits |= (bits << (x * take)) & full
            left, step = left - take, step * 2
        sums.append(bits)

    def adding_up(goal: int, below: int) -> Iterator[tuple[int, ...]]:
        """All ways to add up to goal from the `below` smallest lengths, the largest first."""
        if not goal:
            yield ()
            return
        for i in range(min(below, bisect_right(lengths, goal)), 0, -1):
            if not (sums[i] >> goal) & 1:
                return
            x = lengths[i - 1]
            for many in range(min(counts[x], goal // x), 0, -1):
                if (sums[i - 1] >> (goal - many * x)) & 1:
                    for rest in adding_up(goal - many * x, i - 1):
                        yield (x,) * many + rest

    given: list[tuple[int, ...]] = []
    reach = sums[-1]
    while reach:
        goal = reach.bit_length() - 1
        if goal < lengths[-1] or room - goal > waste:
            return  # the largest length alone holds these
        for found in adding_up(goal, len(lengths)):
            if any(dominated(found, other) for other in given):
                yield None
            else:
                given.append(found)
                yield found
        reach &= (1 << goal) - 1


class _Node:
    """A place in the search: sequences, patterns and waste so far, the counts left, and what is tried next.

    Far from the end of the path a node keeps no counts and no enumeration; both are made again when it is its turn.
    """

    __slots__ = ("used", "done", "waste", "taken", "counts", "untried")

    def __init__(self, used: int, done: list[Pattern], waste: int, counts: dict[int, int]) -> None:
        self.used, self.done, self.waste, self.taken, self.counts = used, done, waste, 0, counts
        self.untried: Iterator[Pattern | None] | None = None


@dataclass
class Search:
    """Branch and bound over fillings, by depth; each filling that is enumerated, and each number of copies, is a step."""

    counts: dict[int, int]
    capacity: int
    steps: int = 6000
    best: list[Pattern] = field(default_factory=list)
    bins: int = 0
    bound: int = 0

    def options(self, counts: dict[int, int], spare: int) -> Iterator[Pattern | None]:
        """Fillings around the largest length, each with as many copies as there can be, and fewer; None for a dominated one."""
        largest = max(counts)
        rest = dict(counts)
        rest[largest] -= 1
        if not rest[largest]:
            del rest[largest]
        for found in tried_fillings(self.capacity - largest, rest, spare):
            if found is None:
                yield None
                continue
            pattern = (largest, *found)
            most = min(counts[x] // n for x, n in Counter(pattern).items())
            for many in range(most, 0, -1):
                yield pattern, many

    def after(self, counts: dict[int, int], patterns: list[Pattern]) -> dict[int, int]:
        left = dict(counts)
        for pattern, many in patterns:
            for x, n in Counter(pattern).items():
                left[x] -= n * many
                if not left[x]:
                    del left[x]
        return left

    def run(self) -> list[Pattern]:
        total = sum(x * n for x, n in self.counts.items())
        self.best = best_fit(self.counts, self.capacity)
        self.bins = sum(n for _, n in self.best)
        self.bound = max(-(-total // self.capacity), sum(n for x, n in self.counts.items() if 2 * x > self.capacity))
        stack: list[_Node] = []
        met: dict[bytes, int] = {}  # digests of counts left, with how many sequences were used

        def spare(waste: int) -> int:
            return (self.bins - 1) * self.capacity - total - waste

        def enter(node: _Node) -> None:
            if not node.counts:
                if node.used < self.bins:
                    self.best, self.bins = node.done, node.used
                return
            if spare(node.waste) < 0 or node.used + sum(n for x, n in node.counts.items() if 2 * x > self.capacity) >= self.bins:
                return
            state = blake2b(repr(sorted(node.counts.items())).encode(), digest_size=16).digest()
            if met.get(state, node.used + 1) > node.used:
                met[state] = node.used
                stack.append(node)
                if len(stack) > LIVE:
                    stack[-LIVE - 1].counts = stack[-LIVE - 1].untried = None

        enter(_Node(0, [], 0, dict(self.counts)))
        while stack and self.bins > self.bound and self.steps:
            node = stack[-1]
            if node.counts is None:
                node.counts = self.after(self.counts, node.done)
            if node.untried is None:
                node.untried = islice(self.options(node.counts, self.capacity * self.bins - total - node.waste), node.taken, None)
            option = next(node.untried, ())
            if option == ():
                stack.pop()
                continue
            node.taken += 1
            self.steps -= 1
            if option is None:
                continue
            pattern, many = option
            spent = node.waste + many * (self.capacity - sum(pattern))
            if spare(spent) < 0:
                continue  # no better packing with as many copies
            enter(_Node(node.used + many, [*node.done, option], spent, self.after(node.counts, [option])))
        return self.best


def packed_counts(counts: dict[int, int], capacity: int = CAPACITY, steps: int = 6000) -> list[Pattern]:
    """Patterns and how often each is used, so that every length occurs as often as counted."""
    return Search({x: n for x, n in counts.items() if n}, capacity, steps).run() if counts else []


def ranges(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(length, first, beyond, sequence, each, offsets): the numbers first to beyond of a length fill `each` places in every copy of a pattern."""
    out, used, sequence = [], {}, 0
    for pattern, many in patterns:
        places: dict[int, list[int]] = {}
        offset = 0
        for x in pattern:
            places.setdefault(x, []).append(offset)
            offset += x
        for x, offsets in places.items():
            first = used.get(x, 0)
            used[x] = first + many * len(offsets)
            out.append((x, first, used[x], sequence, len(offsets), offsets))
        sequence += many
    return out


def placed(parts: DataFrame, capacity: int = CAPACITY, steps: int = 6000) -> DataFrame:
    """parts plus sequence_id and offset.  parts is read several times, so pass a written table."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    schema = "length long, first long, beyond long, sequence long, each long, offsets array<long>"
    table = parts.sparkSession.createDataFrame(ranges(packed_counts(counts, capacity, steps)), schema)
    salts = isqrt(max(counts.values(), default=1)) + 1  # parts of the most frequent length are as many as they are large
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    rows = ranked(parts, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), salts, order, "_nr")
    found = rows.join(F.broadcast(table.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & (F.col("_nr") >= F.col("first")) & (F.col("_nr") < F.col("beyond")))
    copy = F.expr("(_nr - first) div each")
    place = F.element_at("offsets", (F.expr("(_nr - first) % each") + 1).cast("int"))
    return found.select(*[F.col(f"`{c}`") for c in parts.columns], (F.col("sequence") + copy).alias("sequence_id"), place.alias("offset"))


def packed(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    parts = written(pieces(only(docs, "doc_id", "text"), path, pattern, capacity, end, keep_ids), "pieces")
    return placed(parts, capacity)
