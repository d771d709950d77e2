"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at `distance` or fewer differing bits.  The bits are grouped, correlated ones
together, into m parts; part i gets a threshold t[i] >= -1 with sum(t[i] + 1) = distance + 1.  Two
fingerprints within `distance` then differ in at most t[i] bits of some part i, so it suffices to look, in
each part, for those within its threshold: every fingerprint is indexed under its bits of the part, probes
all values within t[i] flips, and each meeting is verified on all 64 bits.  Parts differ in how evenly
they spread the fingerprints, so the thresholds are unequal: dynamic programming picks them, and the best
m is taken, by the estimated cost of probes and candidates.  Estimates cover all fingerprints: exact
counts of equal parts, carried on to more flips by how often each bit is set.

Equal fingerprints are one node, so copies cost one row each and no pairs.  Links become components by
distributed stars; nothing but statistics of 64 * 64 numbers and a few counts reaches the driver.

near_duplicates() links by fingerprints of 64 bits.  similar() is for documents that are alike by a share of their
shingles, and searches the same way with fingerprints of WORDS words: each word has its groups and thresholds, what
meets in a part of any word is held against CLOSE bits, and then verified on the sets of shingles, exactly.  Where more
than CROWD share a part's bits they meet only if they also share a shingle of their prefixes, as all do that are alike,
and only after each has met the leaders of its shingles: a large group of near copies makes no square of pairs.  Texts
that differ in more bits than thresholds can afford may meet in no part; the pairs that are left are found by
prefixes of the sets, so that none is lost.

Defined cases: null and empty texts have no words and fingerprint zero, and link like any other; fewer
than three words are one shingle; a null doc_id gets a fingerprint but no component, and takes no part in
linking; rows with one doc_id twice are both nodes of that id; a very long text is read whole, in blocks of shingles;
a bit that is set in exactly half of the shingles' hashes is 0; empty tables give empty results; other columns aren't
read, or travel in a struct, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import ceil, comb
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framefold.llm.common import components, discard, only, sliced, swept, written

BITS = 64
#: Shingles whose bits are counted at a time; bounds the memory of very long texts.
BLOCK = 1 << 15
#: For similar(): how many frequent shingles it knows at most, how many shingles a task counts at a time, and rows of a
#: frequent shingle in one part.
FREQUENT, TALLY, CHUNK = 1 << 20, 1 << 21, 2000
#: Bits of a text's parity sketch at least.
SKETCH = 1024
#: Words of a wide fingerprint; in how many bits one of them may differ and is sure to meet; and in how many bits of the
#: first two words a pair may differ that is verified: texts with a similarity of 0.8 differ in 19 of 128, unlike ones in 64.
WORDS, SURE, CLOSE = 8, 3, 32
#: Rows of one part's bits that meet each other by these alone.  Of more, those meet that share a shingle of their prefixes.
CROWD = 20
#: What a shuffled probe costs, in verified candidates.
PROBE_COST = 400


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the lower-cased word shingles, in blocks.  bytes.split() parts at exactly the six white space bytes."""
    words = text.lower().split()
    if not words:
        return
    digest = xxhash.xxh64_intdigest
    count = max(1, len(words) - width + 1)
    for begin in range(0, count, BLOCK):
        end = min(begin + BLOCK, count)
        part = words[begin : end + width - 1]
        joined = zip(*(part[i:] for i in range(width)), strict=False) if count > 1 or len(words) == width else [tuple(words)]
        yield np.fromiter((digest(b" ".join(x), seed) for x in joined), dtype="<u8", count=end - begin)


def fingerprint(text: bytes) -> int:
    """Bit b is set if it is set in over half of the shingles' hashes."""
    total, n = np.zeros(BITS, np.int64), 0
    for block in shingle_hashes(text):
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            made = np.fromiter((fingerprint(x or b"") for x in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def together(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints, and how many have bits i and j both set: at most 64 * 64 numbers, summed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BITS, BITS))
        for batch in batches:
            column = np.asarray(batch.column(0), dtype=np.int64)
            for begin in range(0, len(column), BLOCK):
                bits = np.unpackbits(column[begin : begin + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                sums += bits.T @ bits
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(sums.ravel()[cells].astype(np.int64))], names=["cell", "n"])

    table = np.zeros(BITS * BITS)
    for row in nodes.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[row["cell"]] = row["n"]
    return nodes.count(), table.reshape(BITS, BITS)


def grouped(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of near equal size, each grown by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    like = np.abs(np.divide(both / max(n, 1) - np.outer(p, p), spread, out=np.zeros_like(spread), where=spread > 0))
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        seed = max(left, key=lambda b: (like[b, left].sum() - like[b, b], -b))
        group = [seed]
        left.remove(seed)
        while len(group) < width:
            best = max(left, key=lambda b: (like[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def as_mask(bits: list[int] | tuple[int, ...]) -> int:
    """The bits as a signed long."""
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


@dataclass(frozen=True)
class Plan:
    """Groups of bits, their thresholds, and the cost that was estimated."""

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def allocated(n: int, both: np.ndarray, groups: list[list[int]], equal: list[int], distance: int) -> Plan:
    """The cheapest thresholds, by dynamic programming over parts and the sum of t + 1 spent so far.

    equal: pairs of fingerprints that agree in all bits of a part.  Pairs within t flips are estimated by
    the share of pairs within t flips over that of equal ones, were the bits independent.
    """
    p = np.diag(both) / max(n, 1)
    costs = []
    for group, pairs in zip(groups, equal, strict=True):
        flips = np.zeros(distance + 1)  # chances of 0, 1, ... differing bits
        flips[0] = 1.0
        for b in group:
            q = 2 * p[b] * (1 - p[b])
            flips[1:] = flips[1:] * (1 - q) + flips[:-1] * q
            flips[0] *= 1 - q
        more = np.cumsum(flips) / max(flips[0], 1e-300)
        one = [0.0]
        for t in range(distance + 1):
            probes = sum(comb(len(group), k) for k in range(t + 1))
            one.append(n * (probes + 1) * PROBE_COST + max(pairs, n * (n - 1) / 2 * flips[0]) * more[t])
        costs.append(one)  # by t + 1
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for one in costs:
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (cost, chosen) in best.items():
            for add in range(distance + 2 - spent):
                option = (cost + one[add], (*chosen, add - 1))
                if spent + add not in after or option < after[spent + add]:
                    after[spent + add] = option
        best = after
    cost, thresholds = best[distance + 1]
    return Plan(tuple(map(tuple, groups)), thresholds, cost)


def planned(nodes: DataFrame, distance: int, choices: tuple[int, ...] = (2, 3, 4)) -> Plan:
    """The cheapest plan over the numbers of parts in choices."""
    n, both = together(nodes)
    ways = [grouped(n, both, m) for m in choices]
    masks = [(w, k, as_mask(g)) for w, groups in enumerate(ways) for k, g in enumerate(groups)]
    keys = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for w, k, m in masks])
    each = nodes.select(F.explode(keys).alias("e")).groupBy("e.w", "e.k", "e.key").count()
    pairs = {(r["w"], r["k"]): int(r["pairs"]) for r in each.groupBy("w", "k").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    plans = [allocated(n, both, groups, [pairs.get((w, k), 0) for k in range(len(groups))], distance) for w, groups in enumerate(ways)]
    return min(plans, key=lambda x: x.cost)


def links(nodes: DataFrame, distance: int, plan: Plan) -> DataFrame:
    """(a, b): the reps of nodes (fp, rep) whose fingerprints differ in at most `distance` bits, each pair once or more."""
    used = [(i, as_mask(g), g, t) for i, (g, t) in enumerate(zip(plan.groups, plan.thresholds, strict=True)) if t >= 0]
    index = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m, _, _ in used])
    stored = nodes.select("fp", "rep", F.explode(index).alias("e")).select("e.part", "e.key", F.col("fp").alias("fp2"), F.col("rep").alias("b"))
    flips = [(i, m, as_mask(c)) for i, m, g, t in used for k in range(t + 1) for c in combinations(g, k)]
    table = nodes.sparkSession.createDataFrame([(i, m, x) for i, m, x in flips], "part int, mask long, flip long")
    # As many flips as the plan has, whatever the input: at most a few thousand rows.
    near = nodes.crossJoin(F.broadcast(table)).select("part", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("key"), "fp", F.col("rep").alias("a"))
    met = near.join(stored, ["part", "key"]).filter((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance))
    return met.select("a", "b")


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row for each document."""
    rows = written(fingerprints(only(docs, "doc_id", "text")), "fingerprints")
    nodes = written(rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    joined = components(links(nodes, distance, planned(nodes, distance)))
    named = nodes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named, "fp", "left")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", shown.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending; a text without words has one, the empty shingle."""
    blocks = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(blocks)) if blocks else np.array([xxhash.xxh64_intdigest(b"", 42)], "<u8")


def parity_sketch(tokens: np.ndarray) -> bytes:
    """Bit b is whether an odd number of the tokens end in b: a power of two of bits, SKETCH or as many as there are tokens."""
    width = max(SKETCH, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches_differ(x: bytes, y: bytes) -> int:
    """Differing bits of two sketches, the longer folded onto the shorter: at most as many as tokens that only one set has."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(a), len(b))
    a, b = np.bitwise_xor.reduce(a.reshape(-1, n)), np.bitwise_xor.reduce(b.reshape(-1, n))
    return int(np.bitwise_count(a ^ b).sum())


def digested(docs: DataFrame, *more: str | Column) -> DataFrame:
    """(doc_id, digest, ..) of rows with a doc_id: equal texts have equal digests, and null is as the empty text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"), *more).filter("doc_id is not null")


def tallied(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token once, ascending, with its count.  Sorts tokens where they are."""
    tokens.sort()
    edges = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]])) if len(tokens) else np.zeros(1, np.int64)
    return tokens[edges[:-1]], np.diff(edges)


def frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts have, ascending, and in how many they were counted; at most FREQUENT of them.

    Every text is counted.  A task forgets what it saw but once among some TALLY shingles, so its memory is bounded
    and what it sends on is few; a shingle may be counted too low thereby.  Counts only order the shingles and deal
    frequent ones over tasks: any order finds the same pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        new, filled = np.empty(2 * TALLY, np.uint64), 0  # one buffer, sorted in place

        def settled() -> tuple[np.ndarray, np.ndarray]:
            tokens, n = tallied(new[:filled])
            at = np.minimum(np.searchsorted(tokens, known), max(len(tokens) - 1, 0))
            again = tokens[at] == known if len(tokens) else np.zeros(len(known), bool)
            counts[again] += n[at[again]]
            n[at[again]] = 1
            often = n > 1
            all_tokens, all_counts = np.concatenate([known, tokens[often]]), np.concatenate([counts, n[often]])
            order = np.argsort(all_tokens)
            return all_tokens[order], all_counts[order]

        for batch in sliced(batches):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                tokens = shingle_set(text or b"", width)
                for begin in range(0, len(tokens), TALLY):
                    part = tokens[begin : begin + TALLY]
                    if filled + len(part) > len(new):
                        known, counts = settled()
                        filled = 0
                    new[filled : filled + len(part)] = part
                    filled += len(part)
            if filled >= TALLY:
                known, counts = settled()
                filled = 0
        known, counts = settled()
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(counts)], names=["token", "n"])

    counted = texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 2")
    top = counted.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens, counts = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def prefixed(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], least: float, width: int) -> DataFrame:
    """(doc_id, digest, size, prefix, salts, sketch, fps): the first shingles of each text's set, rare ones first; fps its wide fingerprint.

    Of two sets with a Jaccard similarity of `least` or more, these share one.  salts deals the rows of a frequent
    shingle over as many parts as hold some CHUNK each; null if a text has none of these.
    """
    known, counts = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, prefixes, salts, sketches, fps = [], [], [], [], []
            for digest, text in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                tokens = shingle_set(text or b"", width)
                often = np.zeros(len(tokens), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    often = np.where(known[at] == tokens, counts[at], 0)
                first = np.argsort(often, kind="stable")[: len(tokens) - ceil(least * len(tokens) - 1e-6) + 1]
                parts = often[first] // CHUNK + 1
                sizes.append(len(tokens))
                sketches.append(parity_sketch(tokens))
                fps.append(wide_fingerprint(tokens))
                prefixes.append(tokens[first].view(np.int64))
                salts.append((int.from_bytes(digest[:7], "little") % parts).astype(np.int32) if parts.max() > 1 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int32())), pa.array(sketches, pa.binary()), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "digest", "size", "prefix", "salts", "sketch", "fps"])

    return rows.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest binary, size int, prefix array<long>, salts array<int>, sketch binary, fps array<long>")


def unlike_dropped(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, ..) that their sketches (node, size, sketch) don't rule out: no pair that is alike goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x, y, m, n = (batch.column(c).to_pylist() for c in ("sa", "sb", "m", "n"))
            may = [sketches_differ(*both) * (1 + least) <= (1 - least) * (i + j) + 1e-6 for *both, i, j in zip(x, y, m, n, strict=True)]
            yield batch.select(names).filter(pa.array(may, pa.bool_()))

    names = pairs.columns
    b, a = (nodes.select(F.col("node").alias(k), F.col("sketch").alias(f"s{k}"), F.col("size").alias(n)) for k, n in (("b", "n"), ("a", "m")))
    return pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").select(*names, "sa", "sb", "m", "n").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, least: float, width: int) -> DataFrame:
    """The pairs (a, b, ..) of nodes whose sets of shingles have a Jaccard similarity of `least` or more, as a written table.

    nodes: (node, rep, digest, size, sketch); rows: (doc_id, digest, text).  Only texts in a pair that the sketches
    leave are held against each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}  # one of two texts is often the same from row to row
        for batch in sliced(batches, 200):
            held = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                if a not in seen:
                    if len(seen) >= 64:
                        seen.clear()
                    seen[a] = shingle_set((ta or "").encode(), width)
                x, y = seen[a], shingle_set((tb or "").encode(), width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                held.append(both / (len(x) + len(y) - both) >= least)
            yield batch.select(names).filter(pa.array(held, pa.bool_()))

    names = pairs.columns
    left = written(unlike_dropped(pairs, nodes, least), "alike")
    wanted = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep", "digest").hint("merge"), "node")
    texts = rows.join(wanted.select("node", F.col("rep").alias("doc_id"), "digest").hint("merge"), ["doc_id", "digest"])
    texts = written(texts.dropDuplicates(["node"]).select("node", "text"), "texts")
    swept(pairs.sparkSession)
    b, a = texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    both = left.join(b.hint("merge"), "b").join(a.hint("merge"), "a").select(*names, "ta", "tb")
    found = written(both.mapInArrow(run, ", ".join(f"{n} long" for n in names)), "verified")
    discard(texts)
    swept(pairs.sparkSession)
    return found


def wide_fingerprint(tokens: np.ndarray) -> np.ndarray:
    """WORDS fingerprints of a set of hashes, as signed longs: each word by other hashes, mixed from the set's."""
    total = np.zeros(WORDS * BITS, np.int64)
    for begin in range(0, len(tokens), 255):  # so many sums fit a byte
        z = tokens[begin : begin + 255, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        total += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(tokens), bitorder="little").view("<i8")


def together_by_word(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """As together(), for each word of nodes (fps): WORDS * 64 * 64 numbers, summed on the executors in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((WORDS, BITS, BITS)), 0
        for batch in sliced(batches):
            words = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, WORDS, 1)
            bits = np.unpackbits(words.view(np.uint8), axis=2, bitorder="little").astype(np.float32)
            sums += np.matmul(bits.transpose(1, 2, 0), bits.transpose(1, 0, 2))
            n += len(words)
        cells = np.flatnonzero(sums)
        counts = np.concatenate([[n], sums.ravel()[cells]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], cells]).astype(np.int32)), pa.array(counts)], names=["cell", "n"])

    got = nodes.select("fps").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, counts = got["cell"].to_numpy(), got["n"].to_numpy()
    both = np.zeros(WORDS * BITS * BITS)
    both[cells[cells >= 0]] = counts[cells >= 0]
    return int(counts[cells < 0].sum()), both.reshape(WORDS, BITS, BITS)


def planned_by_word(nodes: DataFrame, distance: int, choices: tuple[int, ...] = (3, 4)) -> list[Plan]:
    """A plan for each word of nodes (fps), all with the number of parts that is the cheapest over all words."""
    n, both = together_by_word(nodes)
    ways = [[grouped(n, both[w], m) for w in range(WORDS)] for m in choices]
    parts = [(way, w, k, as_mask(g)) for way, words in enumerate(ways) for w, groups in enumerate(words) for k, g in enumerate(groups)]
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.get("fps", F.lit(w)).bitwiseAND(F.lit(m)).alias("key")) for i, (_, w, _, m) in enumerate(parts)])
    each = nodes.select(F.explode(keys).alias("e")).groupBy("e.i", "e.key").count()
    found = {r["i"]: int(r["pairs"]) for r in each.groupBy("i").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    pairs = {part[:3]: found.get(i, 0) for i, part in enumerate(parts)}
    plans = [[allocated(n, both[w], groups, [pairs[way, w, k] for k in range(len(groups))], distance) for w, groups in enumerate(words)] for way, words in enumerate(ways)]
    return min(plans, key=lambda x: sum(p.cost for p in x))


def indexed(nodes: DataFrame, plans: list[Plan]) -> DataFrame:
    """(part, key, node, c, f0, f1): nodes (node, c, fps) under their bits of each part, for parts with a threshold of 0 or more."""
    used = [(i, w, as_mask(g)) for i, (w, g, _) in enumerate(searched(plans))]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.get("fps", F.lit(w)).bitwiseAND(F.lit(m)).alias("key")) for i, w, m in used])
    first = [F.get("fps", F.lit(w)).alias(f"f{w}") for w in (0, 1)]
    return nodes.select("node", "c", *first, F.explode(keys).alias("e")).select("e.part", "e.key", "node", "c", "f0", "f1")


def searched(plans: list[Plan]) -> list[tuple[int, tuple[int, ...], int]]:
    """(word, bits, threshold) of all parts that are probed."""
    return [(w, g, t) for w, plan in enumerate(plans) for g, t in zip(plan.groups, plan.thresholds, strict=True) if t >= 0]


def close(x: str, y: str) -> Column:
    """Whether x.f0, x.f1 and y.f0, y.f1 differ in at most CLOSE bits."""
    return F.bit_count(F.col(f"{x}.f0").bitwiseXOR(F.col(f"{y}.f0"))) + F.bit_count(F.col(f"{x}.f1").bitwiseXOR(F.col(f"{y}.f1"))) <= CLOSE


def star_links(nodes: DataFrame, plans: list[Plan]) -> DataFrame:
    """(a, b): each of nodes (node, c, fps) with the least that shares a part's bits: stars, not pairs, for large groups."""
    lead = F.min(F.struct("node", "f0", "f1")).over(W.partitionBy("part", "key"))
    led = indexed(nodes, plans).select(F.struct("node", "f0", "f1").alias("x"), lead.alias("y"))
    return led.filter((F.col("x.node") != F.col("y.node")) & close("x", "y")).select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct()


def probing(nodes: DataFrame, plans: list[Plan]) -> DataFrame:
    """As indexed(), under all bits within each part's threshold."""
    stored = indexed(nodes, plans)
    flips = [(i, as_mask(x)) for i, (_, g, t) in enumerate(searched(plans)) for k in range(t + 1) for x in combinations(g, k)]
    if not any(x for _, x in flips):
        return stored
    # As many as the plans have, whatever the input: at most a few thousand rows.
    table = nodes.sparkSession.createDataFrame(flips, "part int, flip long")
    return stored.join(F.broadcast(table), "part").withColumn("key", F.col("key").bitwiseXOR(F.col("flip"))).drop("flip")


def crowded(nodes: DataFrame, plans: list[Plan]) -> DataFrame:
    """(part, key) that more than CROWD of nodes (node, fps) have, as a written table."""
    return written(indexed(nodes.select("node", F.col("node").alias("c"), "fps"), plans).groupBy("part", "key").count().filter(F.col("count") > CROWD).select("part", "key"), "crowded")


def wide_links(nodes: DataFrame, plans: list[Plan], crowds: DataFrame | None = None) -> DataFrame:
    """(a, b, ca, cb), once each: nodes (node, c, fps) of different c that meet within a part's threshold and are close.

    Without those that meet in crowds (part, key) only, where they would be a square of rows: for these see crowd_links().
    """
    near, stored = probing(nodes, plans), indexed(nodes, plans)
    if crowds is not None:
        stored = stored.join(crowds, ["part", "key"], "left_anti")
    x, y = near.alias("x"), stored.alias("y")
    meeting = (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c"))
    return x.join(y, meeting & close("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb")).distinct()


def by_prefix(nodes: DataFrame, *more: str) -> DataFrame:
    """(token, salt, pos, node, size, c, lead, ..): nodes (node, c, size, salts, prefix, ..) under each shingle of their prefixes.

    Under each that with the fewest rarer ones leads: in each part of a frequent shingle.
    """
    salt = F.coalesce(F.get("salts", F.col("pos")), F.lit(0))
    met = nodes.select("node", "size", "c", *more, "salts", F.posexplode("prefix").alias("pos", "token"))
    return met.withColumn("salt", salt).drop("salts").withColumn("lead", F.min(F.struct("pos", "node", "c")).over(W.partitionBy("token", "salt")))


def prefix_stars(nodes: DataFrame) -> DataFrame:
    """(a, b, ca, cb): each of nodes (node, c, size, salts, prefix) with those of other components that lead its shingles: no more pairs than shingles."""
    led = by_prefix(nodes).filter(F.col("c") != F.col("lead.c"))
    return led.select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.c").alias("ca"), F.col("c").alias("cb")).distinct()


def under_prefixes(nodes: DataFrame, common: tuple[np.ndarray, np.ndarray], least: float, *more: str) -> DataFrame:
    """(token, node, size, pos, c, lc, hot, ..), written: nodes as by_prefix() has them, under shingles of several; lc: the leader's component.

    hot: whether the shingle is frequent.  The shorter text of a pair has the shingle among the first of its prefix.
    """
    under = W.partitionBy("token", "salt")
    short = F.col("size") - F.col("pos") >= 2 * least / (1 + least) * F.col("size") - 1e-6
    met = by_prefix(nodes, *more).withColumn("lc", F.col("lead.c")).withColumn("n", F.count(F.lit(1)).over(under)).withColumn("s", F.max(short).over(under))
    tokens = [(int(t),) for t in common[0].view(np.int64)[common[1] >= CHUNK]]
    hot = F.broadcast(nodes.sparkSession.createDataFrame(tokens, "hot long"))  # at most FREQUENT rows
    met = met.join(hot, F.col("token") == F.col("hot"), "left").withColumn("hot", F.col("hot").isNotNull())
    return written(met.filter("hot or n > 1 and s").select("token", "node", "size", "pos", "c", "lc", "hot", *more), "met")


def prefix_links(stored: DataFrame, least: float, also: Column | None = None) -> DataFrame:
    """(a, b, ca, cb), once each: nodes of different components that share a shingle, whose sizes, and what is left after
    its places, allow the similarity, and for whose rows x and y the condition `also` holds.  stored: as under_prefixes() has it.
    """

    def possible(m: str, pos: str, n: str, other: str) -> Column:
        m, pos, n, other = F.col(m), F.col(pos), F.col(n), F.col(other)
        return (F.least(m, n) >= least * F.greatest(m, n) - 1e-6) & (F.least(m - pos, n - other) >= least / (1 + least) * (m + n) - 1e-6)

    # Pairs of different components only; the leader's component isn't paired with itself.
    # A token whose rows are all of one component has no such pair; a frequent one's parts have leaders of their own.
    mixed = stored.filter("hot or c <> lc").select("token").distinct()
    # Of several components under a frequent shingle any one may be the leader's.
    one = stored.filter("hot").groupBy("token").agg(F.min("lc").alias("hc"))
    left = stored.join(mixed.hint("merge"), "token", "left_semi").join(F.broadcast(one), "token", "left").withColumn("lc", F.coalesce("hc", "lc")).drop("hc", "hot")
    x, y = left.filter("c <> lc").alias("x"), left.alias("y")
    meeting = (F.col("x.token") == F.col("y.token")) & (F.col("x.c") != F.col("y.c")) & possible("x.size", "x.pos", "y.size", "y.pos")
    if also is not None:
        meeting &= also
    pairs = x.join(y.hint("merge"), meeting).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb"))
    swap = F.col("a") > F.col("b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("cb")).otherwise(F.col("ca")).alias("ca"), F.when(swap, F.col("ca")).otherwise(F.col("cb")).alias("cb"))
    return pairs.distinct()


def crowd(whole: DataFrame, plans: list[Plan], crowds: DataFrame) -> DataFrame:
    """(node, size, salts, prefix, fps): those of whole that meet others in crowds (part, key), as a written table."""
    inside = probing(whole.select("node", F.col("node").alias("c"), "fps"), plans).join(crowds, ["part", "key"], "left_semi")
    return written(whole.select("node", "size", "salts", "prefix", "fps").join(inside.select("node").distinct(), "node", "left_semi"), "crowd")


def crowd_links(nodes: DataFrame, plans: list[Plan], common: tuple[np.ndarray, np.ndarray], least: float) -> DataFrame:
    """(a, b, ca, cb), once each: as wide_links(), for nodes (node, c, size, salts, prefix, fps) that also share a shingle of their prefixes.

    Two sets with a similarity of `least` share one, so no pair that is alike goes.
    """
    first = [F.get("fps", F.lit(w)).alias(f"f{w}") for w in (0, 1)]
    stored = under_prefixes(nodes.select("*", *first), common, least, "f0", "f1", "fps")
    within = [F.bit_count(F.get("x.fps", F.lit(w)).bitwiseXOR(F.get("y.fps", F.lit(w))).bitwiseAND(F.lit(as_mask(g)))) <= t for w, g, t in searched(plans)]
    return prefix_links(stored, least, close("x", "y") & reduce(or_, within))


def joined(named: DataFrame, found: DataFrame) -> DataFrame:
    """named (node, c) after its components have been linked by the pairs found (.., ca, cb)."""
    over = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("c"), F.col("component").alias("top"))
    return written(named.join(over.hint("merge"), "c", "left").select("node", F.coalesce("top", "c").alias("c")), "joined")


def met_by_fingerprints(whole: DataFrame, nodes: DataFrame, rows: DataFrame, common: tuple[np.ndarray, np.ndarray], least: float, width: int) -> DataFrame:
    """(node, c): components of the pairs that wide fingerprints find, each verified.  whole: (node, size, prefix, salts, fps, ..)."""
    plans = planned_by_word(whole, SURE)
    alone = whole.select("node", F.col("node").alias("c"), "fps")
    stars = written(star_links(alone, plans).select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), "stars")
    swept(whole.sparkSession)
    known = joined(alone.select("node", "c"), verified(stars, nodes, rows, least, width))
    # Large groups of near copies would be a square of rows under their bits.  There the leaders of shingles link most of a
    # group, and of the components that are left those meet that share a shingle of their prefixes.
    crowds = crowded(whole, plans)
    some = None if crowds.isEmpty() else crowd(whole, plans, crowds)
    swept(whole.sparkSession)
    if some is not None:
        stars = written(prefix_stars(some.join(known.hint("merge"), "node")), "stars")
        swept(whole.sparkSession)
        known = joined(known, verified(stars, nodes, rows, least, width))
    pairs = written(wide_links(whole.select("node", "fps").join(known.hint("merge"), "node"), plans, crowds), "pairs")
    swept(whole.sparkSession)
    if some is not None:
        pairs = written(pairs.union(crowd_links(some.join(known.hint("merge"), "node"), plans, common, least)).distinct(), "pairs")
        swept(whole.sparkSession)
    return joined(known, verified(pairs, nodes, rows, least, width))


def similar_nodes(docs: DataFrame, least: float, width: int) -> DataFrame:
    """(digest, rep, component): each text with its smallest doc_id and the group of texts that it belongs to."""
    spark = docs.sparkSession
    rows = digested(docs, F.col("text").cast("string").alias("text"))
    common = frequent(rows.select("text"), width)
    each = prefixed(rows, common, least, width)
    nodes = each.groupBy("digest").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("size", "prefix", "salts", "sketch", "fps")])
    whole = written(nodes.withColumn("node", F.monotonically_increasing_id()), "prefixes")
    nodes = written(whole.select("node", "rep", "digest", "size", "sketch"), "nodes")
    swept(spark)

    known = met_by_fingerprints(whole, nodes, rows, common, least, width)
    # The rest, by prefixes.
    stored = under_prefixes(whole.join(known.hint("merge"), "node"), common, least)
    discard(whole)
    swept(spark)
    pairs = written(prefix_links(stored, least), "pairs")
    # Components of components, then back to their members.
    named = joined(known, verified(pairs, nodes, rows, least, width)).withColumnRenamed("c", "component")
    swept(spark)
    return nodes.select("node", "digest", "rep").join(named.hint("merge"), "node").select("digest", "rep", "component")


def similar(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, component_id): documents whose sets of `width` words' shingles have a Jaccard similarity of `least` or more.

    First by fingerprints, as planned_by_word() has them.  What they miss by prefixes: in any one order of all shingles,
    two sets that are so alike share one of their first size - ceil(least * size) + 1 each.  Rare ones come first, so few
    sets meet.  All pairs are found, and each is verified on the whole sets (of 64-bit hashes).  Texts are the nodes, not doc_ids: a doc_id with different
    texts links none of them.  A group's component_id is its smallest doc_id.

    Defined cases: null and empty texts are one text, without words, and those of fewer than `width` words are one
    shingle; a very long text is a set like any other; a null doc_id has no group; equal rows are one node; an empty
    table gives an empty result; other columns aren't read, so their names can't clash.
    """
    slim = only(docs, "doc_id", "text")
    nodes = written(similar_nodes(slim, least, width), "named")
    tops = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = nodes.join(tops, "component").select("digest", "component_id")
    linked = digested(slim).join(named, "digest").select("doc_id", "component_id")
    return linked.unionByName(slim.filter("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, one document of each group: the one with the smallest doc_id.  Documents without a doc_id stay.

    Groups are those of texts as in similar(), with its defined cases, so that of a doc_id with different texts each
    stays, or goes, with its own group.  Rows that are equal in doc_id and text are one document.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    nodes = similar_nodes(only(docs, "doc_id", "text"), 0.8, 5)
    kept = written(nodes.groupBy("component").agg(F.min(F.struct("rep", "digest")).alias("k")).select(F.col("k.rep").alias("doc_id"), "k.digest"), "kept")
    swept(docs.sparkSession)
    # The same join at every size: neither side is known to stay small.
    rows = digested(docs, row, F.col("text").isNotNull().alias("some")).join(kept.hint("merge"), ["doc_id", "digest"], "left_semi")
    first = F.row_number().over(W.partitionBy("doc_id", "digest").orderBy("some"))
    out = rows.withColumn("first", first).filter("first = 1").select("row.*")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter("doc_id is null"))
