"""Progress and cancellation of jobs.  (progress events, the cancel token, O2)"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that start inside end when cancel() is called with the tag, from any thread."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> list[str]:
    return spark.interruptTag(tag)


def counted(df: DataFrame, name: str, **measures) -> tuple[DataFrame, Observation]:
    """df, and an observation that holds its row count and other measures once an action has run over it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in measures.items()]), seen


def selected(files: DataFrame, all_: bool) -> DataFrame:
    """O2: everything of a pane, or nothing."""
    return files if all_ else files.limit(0)


def may_run(inputs: DataFrame, busy: bool) -> bool:
    """Whether a step is open: it has inputs, and nothing else runs."""
    return not busy and not inputs.isEmpty()
