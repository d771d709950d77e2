"""What the corpus operators share: written intermediates, row numbers and connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='framefold-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_open: ContextVar[list[str] | None] = ContextVar("open", default=None)
#: What was written outside temporary() and staged(), and not deleted since.
_left: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df into the shared folder and read it again: lineage ends here and survives lost executors.

    What a query returns may read such tables, so they stay until cleared() or the end of the driver's Python; within
    temporary() they go when it ends.
    """
    path = f"{shared_folder(df.sparkSession)}/framefold-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    paths = _open.get()
    (_left if paths is None else paths).append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._framefold_path = path  # for discard()
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete what written() made, once nothing reads it any more."""
    path = getattr(df, "_framefold_path", None)
    if path:
        removed(df.sparkSession, path)
        for paths in (_left, _open.get() or []):
            if path in paths:
                paths.remove(path)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now: its cleaner waits for the driver's garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def rested(spark: SparkSession) -> None:
    """Executors collect their garbage and return heap to the system, which a stage before may have grown to its limit:
    the Python workers of the next one need it.  One short task a core; those that share an executor do no harm.
    """
    cores = spark.sparkContext.defaultParallelism
    collected = F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("gc")
    spark.range(0, cores, 1, cores).select(collected).write.format("noop").mode("overwrite").save()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all that was written() inside.  What is to stay is written after it, or by other means."""
    token = _open.set([])
    try:
        yield
    finally:
        paths = _open.get() or []
        _open.reset(token)
        for path in paths:
            removed(spark, path)


def cleared(spark: SparkSession) -> None:
    """Delete all tables that the session's queries wrote and that are left, once no result that reads them is needed."""
    while _left:
        removed(spark, _left.pop())


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _left:
        with suppress(Exception):  # the JVM may be gone
            cleared(spark)


atexit.register(_at_exit)


#: What the last stage of a pipeline wrote for itself.
_staged: list[str] = []


def _read_by(df: DataFrame) -> str:
    """The folders that a plan reads, one a line."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for k in range(leaves.size()):
        if leaves.apply(k).getClass().getSimpleName() == "LogicalRelation" and leaves.apply(k).relation().getClass().getSimpleName() == "HadoopFsRelation":
            found.append(leaves.apply(k).relation().location().rootPaths().mkString("\n"))
    return "\n".join(found)


@contextmanager
def staged(spark: SparkSession, docs: DataFrame) -> Iterator[None]:
    """For a stage of a pipeline, whose result is written and read again before the next stage begins: what the last
    stage wrote for itself goes now, but for tables that docs read.
    """
    read = _read_by(docs)
    for path in [p for p in _staged if p.rsplit("/", 1)[1] not in read]:
        removed(spark, path)
        _staged.remove(path)
    swept(spark)
    rested(spark)
    outer, own = _open.get(), []
    token = _open.set(own)
    try:
        yield
    finally:
        _open.reset(token)
        (_staged if outer is None else outer).extend(own)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that the Python values of few texts exist at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns, so that whatever else a table carries can't clash with an operator's own names."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def ranked(df: DataFrame, group: list[str], salt: Column, salts: int, order: list[Column], name: str) -> DataFrame:
    """Gapless row numbers from 0 in each group, without gathering a group in one task.

    A group is dealt into `salts` parts; rows are numbered in their part, and a part starts where the
    parts before it end.  The table of part sizes has at most `salts` rows a group.
    """
    from pyspark.sql import Window as W

    part = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    local = part.withColumn("_rn", F.row_number().over(W.partitionBy(*group, "_salt").orderBy(*order)) - 1)
    sizes = part.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return local.join(starts, [*group, "_salt"]).withColumn(name, F.col("_rn") + F.col("_start")).drop("_salt", "_rn", "_start")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a long, b long): rows (node, component), component the least node.

    Alternating large and small stars (Kiveris et al. 2014) with joins and minima only: nothing is
    collected, and a round's links are written to the shared folder.  Nodes without links don't occur.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        # Large star: every larger neighbour of a node goes to the least of the node and its neighbours.
        low = edges.groupBy("u").agg(F.min("v").alias("m"))  # nodes that have a smaller neighbour
        down = edges.join(low.select(F.col("u").alias("v"), F.col("m")), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = down.distinct()
        # Small star: a node and its smaller neighbours go to the least of these.
        best = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(best, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = written(small, "links")
        # Done when every node has one smaller neighbour and no such neighbour has one itself.
        state = after.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("k")).first()
        inner = after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        discard(edges)
        edges = after
        if state["n"] == state["k"] and not inner:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
