"""Embedding near-duplicates by an epsilon grid order join.

Cosine at least t between unit vectors is distance at most eps = sqrt(2 - 2t).  Vectors are turned onto their
principal dimensions; cells of width eps on the leading ones, compared lexicographically, give the epsilon
grid order.  The ordered sequence is cut into blocks of `block` vectors, and blocks into a tree of `fan`
intervals each.  Pairs of intervals are joined recursively from the top: those whose bounding boxes are
further apart than eps are skipped, others are replaced by the pairs of their children, level by level, as
joins of small tables of boxes.

Pairs of blocks that are left are dealt to tasks by intervals of the sequence: a task takes all that is left
between two intervals, and each block comes to it once.  The sequence has SIDES intervals, or as many as keep one
under `most` vectors; so up to SIDES * most vectors the shuffle is in proportion to them (at most SIDES copies),
and beyond that a task's memory stays bounded.  A task goes on with the recursion over halves of two blocks down to
`leaf` vectors.  Of these, what the leading dimensions and the length of the rest prove to be too far apart is
skipped, and the others are compared exactly, by dot products of unit vectors in double precision.

Boxes and leading dimensions only ever skip pairs that provably don't link.  Where vectors spread evenly over many
dimensions no box is far from another, all pairs of blocks are left, and the work is that of all pairs.

Equal vectors are one vector with a count, so copies make no pairs, and a task returns for each vector its number of
links and one link of a spanning forest: rows stay in proportion to the vectors, while links are all counted.
Vectors of different lengths don't link; each length is joined by itself.

Defined cases: vectors that are null, empty, zero, or hold null, NaN or infinite components link with nothing and
are their own component; very long vectors and ties at the threshold are compared like any others; a null vec_id is
counted as a link of others but names no component; rows with one vec_id twice are vectors of their own; an empty
table gives an empty result; other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framefold.llm.common import components, only, written

#: Leading dimensions of the grid and of the boxes.
GRID, BOX = 8, 16
#: What rounding may add to a squared distance, and take from a dot product in single precision.
SLACK, ROUNDING = 1e-9, 1e-4
#: Intervals of the sequence whose pairs are tasks, at least where there are as many blocks.
SIDES = 8


def usable() -> Column:
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return F.expr(f"embedding is not null and size(embedding) > 0 and coalesce({finite}, false) and coalesce(exists(embedding, x -> x <> 0), false)")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of that width as rows, in its own precision."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def units(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; dividing by the largest component first keeps squares in range."""
    wide = rows.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    wide /= np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    return wide


def principal(vectors: DataFrame, width: int) -> np.ndarray:
    """The principal dimensions as columns, by falling variance; width * (width + 1) + 1 sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width * (width + 1) + 1)
        for batch in batches:
            u = units(matrix(batch.column(0), width))
            sums += np.concatenate([(u.T @ u).ravel(), u.sum(axis=0), [len(u)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["cell", "v"])

    sums = np.zeros(width * (width + 1) + 1)
    for row in vectors.select("embedding").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        sums[row["cell"]] = row["v"]
    n, mean = max(sums[-1], 1.0), sums[width * width : -1] / max(sums[-1], 1.0)
    _, turned = np.linalg.eigh(sums[: width * width].reshape(width, width) / n - np.outer(mean, mean))
    return turned[:, ::-1].copy()


def in_grid_order(vectors: DataFrame, turn: np.ndarray, eps: float) -> DataFrame:
    """vectors (did, embedding, n) plus rank, their place in the epsilon grid order, as a written table."""
    width = len(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = units(matrix(batch.column(1), width)) @ turn[:, :GRID]
            cells = pa.array(list(np.floor(y / eps).astype(np.int32)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells, pa.array(list(y), pa.list_(pa.float64()))], names=[*batch.schema.names, "cell", "y"])

    kind = dict(vectors.dtypes)["embedding"]
    placed = written(vectors.select("did", "embedding", "n").mapInArrow(run, f"did long, embedding {kind}, n long, cell array<int>, y array<double>"), "cells")
    # Distinct vectors differ in y, so even one crowded cell is dealt over tasks.
    ordered = placed.repartitionByRange("cell", "y", "did").sortWithinPartitions("cell", "y", "did").drop("cell", "y")
    kept = written(ordered.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "order")
    sizes = sorted((r["part"], r["count"]) for r in kept.groupBy("part").count().collect())  # one row for each partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    table = vectors.sparkSession.createDataFrame(starts, "part int, start long")
    return kept.join(F.broadcast(table), "part").withColumn("rank", F.col("start") + F.col("place")).drop("part", "place", "start")


def blocks(ordered: DataFrame, turn: np.ndarray, block: int) -> DataFrame:
    """(idx, dids, counts, vectors, lo_*, hi_*): consecutive vectors packed, with the box of their leading dimensions."""
    width, box = len(turn), min(BOX, len(turn))
    names = ["idx", "dids", "counts", "vectors", *[f"lo_{k}" for k in range(box)], *[f"hi_{k}" for k in range(box)]]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank").combine_chunks()
        rows = matrix(table["embedding"].combine_chunks(), width)
        y = units(rows) @ turn[:, :box]
        binary = [np.ascontiguousarray(table[c].to_numpy(), np.int64).tobytes() for c in ("did", "n")]
        values = [table["idx"][0].as_py(), *binary, rows.tobytes(), *y.min(axis=0).tolist(), *y.max(axis=0).tolist()]
        return pa.table([pa.array([v]) for v in values], names=names)

    schema = "idx long, dids binary, counts binary, vectors binary, " + ", ".join(f"{n} double" for n in names[4:])
    return ordered.withColumn("idx", F.expr(f"rank div {block}")).groupBy("idx").applyInArrow(run, schema)


def near_pairs(packed: DataFrame, eps: float, fan: int, box: int) -> DataFrame:
    """(a, b), a <= b: pairs of blocks whose boxes are within eps, by recursion from the top of the tree."""
    spark = packed.sparkSession
    sides = [f"{s}_{k}" for s in ("lo", "hi") for k in range(box)]
    base = packed.select("idx", *sides)
    n = base.count()
    levels = [base]
    while -(-n // fan ** (len(levels) - 1)) > fan:
        up = levels[-1].groupBy(F.expr(f"idx div {fan}").alias("idx")).agg(*[(F.min if s.startswith("lo") else F.max)(s).alias(s) for s in sides])
        levels.append(written(up, "boxes"))
    top = -(-n // fan ** (len(levels) - 1))  # at most `fan` intervals
    pairs = spark.createDataFrame([(a, b) for a in range(top) for b in range(a, top)], "a long, b long")
    gaps = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"x_lo_{k}") - F.col(f"y_hi_{k}"), F.col(f"y_lo_{k}") - F.col(f"x_hi_{k}")), F.lit(2)) for k in range(box)), F.lit(0.0))
    for depth, level in reversed(list(enumerate(levels))):
        step = 1 if depth == len(levels) - 1 else fan
        x, y = (level.select(F.expr(f"idx div {step}").alias(up), F.col("idx").alias(to), *[F.col(s).alias(f"{name}_{s}") for s in sides]) for up, to, name in (("a", "i", "x"), ("b", "j", "y")))
        met = pairs.join(x, "a").join(y, "b").filter((F.col("i") <= F.col("j")) & (gaps <= eps * eps + SLACK))
        pairs = written(met.select(F.col("i").alias("a"), F.col("j").alias("b")), "pairs")
    return pairs


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, of links u[k], v[k] among n nodes."""
    label = np.arange(n)
    while len(u):
        least = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        label = label[label]
        if (label == before).all():
            break
    return label


class _Block:
    """A block's unit vectors and counts, their leading dimensions, and a vector whose dot products bound theirs from above."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray, turn: np.ndarray, first: int) -> None:
        self.x, self.n, self.first = units(rows), counts, first
        self.lead = self.x @ turn[:, :BOX]
        rest = np.sqrt(np.maximum(0, 1 - (self.lead * self.lead).sum(axis=1)))
        self.above = np.c_[self.lead, rest].astype(np.float32)
        self.links = np.zeros(len(rows), np.int64)


class _Join:
    """The recursion inside pairs of blocks, over the nodes of a task."""

    def __init__(self, least: float, leaf: int) -> None:
        self.least, self.leaf, self.limit = least, leaf, 2 - 2 * least + SLACK
        self.u: list[np.ndarray] = []
        self.v: list[np.ndarray] = []

    def join(self, x: _Block, y: _Block, i: int, ii: int, j: int, jj: int) -> None:
        if x is y and i >= jj:
            return
        a, b = x.lead[i:ii], y.lead[j:jj]
        gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
        if gap @ gap > self.limit:
            return
        if max(ii - i, jj - j) > self.leaf:
            im, jm = (i + ii) // 2, (j + jj) // 2
            for p, q in ((i, im), (im, ii)) if ii - i > self.leaf else ((i, ii),):
                for r, s in ((j, jm), (jm, jj)) if jj - j > self.leaf else ((j, jj),):
                    self.join(x, y, p, q, r, s)
            return
        may = x.above[i:ii] @ y.above[j:jj].T >= self.least - ROUNDING
        if x is y:
            may &= np.arange(i, ii)[:, None] < np.arange(j, jj)[None, :]
        rows, columns = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if not len(rows):
            return
        near = (x.x[i:ii][rows] @ y.x[j:jj][columns].T >= self.least) & may[np.ix_(rows, columns)]
        rows, columns = rows + i, columns + j
        x.links[rows] += near @ y.n[columns]
        y.links[columns] += near.T @ x.n[rows]
        u, v = np.nonzero(near)
        # Of a leaf's links only a forest is kept.
        low = forest(u, v + len(rows), len(rows) + len(columns))
        node = np.concatenate([rows + x.first, columns + y.first])
        own = np.flatnonzero(low != np.arange(len(low)))
        self.u.append(node[own])
        self.v.append(node[low[own]])


def linked(packed: DataFrame, pairs: DataFrame, turn: np.ndarray, kind: str, least: float, leaf: int, span: int) -> DataFrame:
    """(did, links, root): for each vector of a task that has links, their number and a linked vector of its component.

    A task has the pairs between two intervals of `span` blocks.
    """
    width, dtype = len(turn), np.float64 if "double" in kind else np.float32

    def run(table: pa.Table, between: pa.Table) -> pa.Table:
        held: dict[int, _Block] = {}
        dids, total = [], 0
        for r in table.select(["idx", "dids", "counts", "vectors"]).to_pylist():
            dids.append(np.frombuffer(r["dids"], np.int64))
            held[r["idx"]] = _Block(np.frombuffer(r["vectors"], dtype).reshape(-1, width), np.frombuffer(r["counts"], np.int64), turn, total)
            total += len(dids[-1])
        join = _Join(least, leaf)
        for a, b in zip(between["a"].to_pylist(), between["b"].to_pylist(), strict=True):
            join.join(held[a], held[b], 0, len(held[a].x), 0, len(held[b].x))
        ids, links = np.concatenate(dids), np.concatenate([x.links for x in held.values()])
        low = forest(np.concatenate(join.u), np.concatenate(join.v), len(ids)) if join.u else np.arange(len(ids))
        own = np.flatnonzero(links)
        return pa.table([pa.array(ids[own]), pa.array(links[own]), pa.array(ids[low[own]])], names=["did", "links", "root"])

    tasks = pairs.select(F.expr(f"a div {span}").alias("ta"), F.expr(f"b div {span}").alias("tb"), "a", "b")
    needed = tasks.select(F.col("ta").alias("sa"), F.col("tb").alias("sb"), F.explode(F.array("a", "b")).alias("idx")).distinct()
    both = needed.join(packed.select("idx", "dids", "counts", "vectors"), "idx")
    return both.groupBy("sa", "sb").cogroup(tasks.groupBy("ta", "tb")).applyInArrow(run, "did long, links long, root long")


def links_of(vectors: DataFrame, kind: str, width: int, least: float, block: int, fan: int, leaf: int, most: int) -> DataFrame:
    """linked() of distinct vectors (did, embedding, n) of one length."""
    eps = float(np.sqrt(2 - 2 * least))
    turn = principal(vectors, width)
    packed = written(blocks(in_grid_order(vectors, turn, eps), turn, block), "blocks")
    pairs = near_pairs(packed, eps, fan, min(BOX, width))
    n = packed.count()
    span = max(1, min(-(-n // SIDES), most // block))
    return written(linked(packed, pairs, turn, kind, least, leaf, span), "links")


def near_vectors(vectors: DataFrame, least: float = 0.95, block: int = 1024, fan: int = 16, leaf: int = 512, most: int = 1 << 16) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vector."""
    rows = only(vectors, "vec_id", "embedding").withColumn("usable", usable())
    kind = dict(rows.dtypes)["embedding"]
    same = rows.filter("usable").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    distinct = written(same.withColumn("did", F.monotonically_increasing_id()).withColumn("width", F.size("embedding")), "vectors")
    found = distinct.select("did", F.lit(0).cast("long").alias("links"), F.col("did").alias("root")).limit(0)
    for r in distinct.groupBy("width").count().filter("count > 1").collect():  # one row for each length
        found = found.union(links_of(distinct.filter(F.col("width") == r["width"]), kind, r["width"], least, block, fan, leaf, most))
    counts = found.groupBy("did").agg(F.sum("links").alias("links"))
    joined = written(components(found.filter("did <> root").select(F.col("did").alias("a"), F.col("root").alias("b"))), "components")
    named = joined.join(distinct.select(F.col("did").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("low"))
    member = joined.join(named, "component").select(F.col("node").alias("did"), "low")
    each = distinct.join(counts, "did", "left").join(member, "did", "left")
    each = each.select(F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("low", "rep").alias("low"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("low", "vec_id"))
    kept = F.coalesce("vec_id", F.lit(0)).eqNullSafe(F.coalesce(component, F.lit(0)))
    out = rows.filter("usable").join(each, F.col("embedding") == F.col("_e"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
    # Vectors that link with nothing take no part in the join, however many.
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)
