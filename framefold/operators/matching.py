"""Nearest descriptors of consecutive frames, and the best matches.  (J5-J7, T3-T5)

Descriptors of a pair of frames meet in one task as packed matrices, because a frame has a bounded number of
keypoints (5000 at most); numpy compares them in strips, so no pair of descriptors becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Descriptors compared at a time.
STRIP = 1024


def consecutive(keypoints: DataFrame, group: list[str]) -> DataFrame:
    """Each frame's keypoints twice: as `train` of the pair with the next frame, and as `query` of that with the one before.

    Frames are numbered within the group by a window over frames, not keypoints.
    """
    by = W.partitionBy(*group).orderBy("img")
    seq = keypoints.select(*group, "img").distinct().withColumn("seq", F.row_number().over(by))
    rows = keypoints.join(seq, [*group, "img"])
    both = F.array(F.struct((F.col("seq") + 1).alias("pair"), F.lit("train").alias("side")), F.struct(F.col("seq").alias("pair"), F.lit("query").alias("side")))
    return rows.withColumn("e", F.explode(both)).select("*", "e.pair", "e.side").drop("e", "seq")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number descriptors, exact in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.astype(np.int64).view(np.uint64)[:, None, :] ^ b.astype(np.int64).view(np.uint64)[None, :, :]).sum(axis=2, dtype=np.int64)


def _nearest(a: np.ndarray, b: np.ndarray, distance: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a the first nearest row of b, and its distance."""
    at, far = [], []
    for i in range(0, len(a), STRIP):
        d = distance(a[i : i + STRIP], b)
        k = d.argmin(axis=1)
        at.append(k)
        far.append(d[np.arange(len(k)), k])
    return np.concatenate(at), np.concatenate(far)


def nearest(pairs: DataFrame, group: list[str], binary: bool = False, mutual: bool = False) -> DataFrame:
    """(group..., query_img, query_id, train_id, dist): for each query descriptor its nearest train descriptor, the one with the least kp_id among equals.

    dist is the squared Euclidean distance, or for binary descriptors (arrays of 64-bit codes) the Hamming
    distance.  mutual keeps a match only if the train descriptor's nearest is the query in turn.
    """
    distance = hamming if binary else squared
    schema = pairs.select(*group).schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("kp_id")
        query, train = (table.filter(pa.compute.equal(table["side"], s)) for s in ("query", "train"))
        names = [*group, "query_img", "query_id", "train_id", "dist"]
        kinds = [pa.int64()] * 4
        if not len(query) or not len(train):
            return pa.table([pa.array([], table[g].type) for g in group] + [pa.array([], k) for k in kinds], names=names)
        a, b = (np.stack(t["desc"].to_numpy()) for t in (query, train))
        at, far = _nearest(a, b, distance)
        keep = np.ones(len(a), bool)
        if mutual:
            back, _ = _nearest(b, a, distance)
            keep = back[at] == np.arange(len(a))
        q, t = query["kp_id"].to_numpy(), train["kp_id"].to_numpy()
        columns = [query["img"].to_numpy()[keep], q[keep], t[at][keep], far[keep].astype(np.int64)]
        first = [pa.array([table[g][0].as_py()] * int(keep.sum()), table[g].type) for g in group]
        return pa.table(first + [pa.array(c.astype(np.int64)) for c in columns], names=names)

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields) + ", query_img long, query_id long, train_id long, dist long"
    return pairs.groupBy(*group, "pair").applyInArrow(lambda table: run(table), out)


def best_matches(matches: DataFrame, group: list[str], share: float = 0.5, least: int = 20) -> DataFrame:
    """The nearest floor(share * n) matches of a pair of frames, but `least` where there are so many."""
    by = W.partitionBy(*group)
    ranked = matches.withColumn("rn", F.row_number().over(by.orderBy("dist", "query_id"))).withColumn("n", F.count(F.lit(1)).over(by))
    return ranked.filter(F.col("rn") <= F.least(F.greatest(F.floor(F.col("n") * share), F.lit(least)), F.col("n"))).drop("n")


def strongest(keypoints: DataFrame, most: int = 3000) -> DataFrame:
    """T5: a frame's strongest keypoints with their own descriptors."""
    by = W.partitionBy("img").orderBy(F.desc("response"), "kp_id")
    return keypoints.withColumn("_rn", F.row_number().over(by)).filter(F.col("_rn") <= most).drop("_rn")
