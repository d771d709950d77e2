"""Numbering rows in order without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts that a group is numbered in.
PARTS = 64


def sorting(order: list[str]) -> list[Column]:
    """Columns by name, falling where the name begins with a minus."""
    return [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order]


def numbered(rows: DataFrame, group: list[str], order: list[str], place: str = "place", total: str | None = None, parts: int = PARTS) -> DataFrame:
    """rows plus their place in the group's order, from 0, and the group's size (total).

    The first column of the order, a number, is cut at its approximate quantiles over the whole table, one row that is
    broadcast.  Rows are numbered in their part of their group; a part starts where the
    parts before it end.  So a group that holds most rows is spread over as many tasks as there are parts.
    """
    lead, falling = order[0].removeprefix("-"), order[0].startswith("-")
    shares = [k / parts for k in range(1, parts)]
    cuts = rows.agg(F.array_distinct(F.percentile_approx(F.col(lead), shares, 10 * parts)).alias("_cuts"))  # one row
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(lead))), F.lit(0))
    cut = rows.crossJoin(F.broadcast(cuts)).withColumn("_part", -part if falling else part).drop("_cuts")
    within = F.row_number().over(W.partitionBy(*group, "_part").orderBy(*sorting(order))) - 1
    by = W.partitionBy(*group)
    sizes = cut.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_size"))  # `parts` rows a group at most
    before = F.coalesce(F.sum("_size").over(by.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_part").alias("_start_part"), before.alias("_start"), F.sum("_size").over(by).alias("_total"))
    same = F.col("_part") == F.col("_start_part")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    joined = cut.withColumn("_within", within).join(starts, same)
    out = [(F.col("_start") + F.col("_within")).cast("long").alias(place)]
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *out, *([F.col("_total").alias(total)] if total else []))
