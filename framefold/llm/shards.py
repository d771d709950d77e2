"""Sharding over fixed virtual slots, in DataFrame functions only.

A record's id and text decide its virtual slot, for ever.  The bytes of each slot are added up, and a versioned map,
stored under a path of the caller's, says which shard holds a slot.  deal() writes version 1: the slots, largest first,
each to the shard that is lightest so far.  add_shard() adds a version that moves only as many slots as the new shard
needs, so no record moves between two old shards.  A version holds only the slots that it moved; the map in force
takes the latest row of each slot up to that version.  placed_by() places any records by a stored map, those too that
came after it was dealt.

The law is `bytes`: shards are near equal in bytes (as near as the largest slot allows).  The map has
`slots` rows a version at most, whatever the input, so it may be broadcast.

Defined cases: a null text counts as no bytes, so its row has size 1; a null doc_id is hashed with its text like any
other, and so are rows with one doc_id twice; rows equal in both share a slot, in any order; a very long text is one
record; an empty table gives an empty result and a map all the same; other columns aren't read, so their names can't
clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framefold.llm.common import only, ranked, shared_folder, written

SLOTS = 4096
#: Rows of a slot that are numbered in one task, about.
PART = 100_000


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot: all that sharding needs of a document."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones too."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["bytes", "n"])


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: (version, virtual_slot, shard).  One row of `slots` entries is folded."""
    items = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))).alias("items"))
    lightest = "array_position(a.loads, array_min(a.loads)) - 1"
    step = f"named_struct('loads', transform(a.loads, (l, k) -> if(k = {lightest}, l - x.less, l)), 'owners', array_append(a.owners, int({lightest})))"
    fold = f"aggregate(items, named_struct('loads', array_repeat(0L, {shards}), 'owners', cast(array() as array<int>)), (a, x) -> {step}, a -> a.owners)"
    dealt = items.select("items", F.expr(fold).alias("owners"))
    return dealt.select(F.explode(F.arrays_zip("items", "owners")).alias("e")).select(F.lit(1).alias("version"), F.col("e.items.virtual_slot").alias("virtual_slot"), F.col("e.owners").alias("shard"))


def in_force(slot_map: DataFrame, version: int) -> DataFrame:
    """(virtual_slot, shard) by the latest row of each slot up to that version."""
    return slot_map.filter(F.col("version") <= version).groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))


def grown(slot_map: DataFrame, sizes: DataFrame, version: int, shards: int) -> DataFrame:
    """The rows of version + 1, which adds shard number `shards`: each old shard gives slots up to what it has over the new mean."""
    now = in_force(slot_map, version).join(sizes, "virtual_slot")
    by = W.partitionBy("shard")
    own = now.withColumn("load", F.sum("bytes").over(by)).withColumn("given", F.sum("bytes").over(by.orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(W.unboundedPreceding, 0)))
    mean = sizes.agg((F.sum("bytes") / (shards + 1)).alias("mean"))
    # Small slots first: what is given stays under the surplus, and comes close to it.
    own = own.withColumn("given", F.col("load") - F.col("given") + F.col("bytes"))
    return own.crossJoin(F.broadcast(mean)).filter((F.col("given") <= F.col("load") - F.col("mean")) & (F.col("bytes") > 0)).select(F.lit(version + 1).alias("version"), "virtual_slot", F.lit(shards).alias("shard"))


def placed(rows: DataFrame, sizes: DataFrame, slot_map: DataFrame, version: int) -> DataFrame:
    """rows (with `row`, a number of their own) plus shard and slot: the row's place in its shard, gapless from 0.

    A slot's rows start where the shard's slots before it end, so rows are numbered slot by slot, and those of a large
    slot in parts of some PART rows.
    """
    held = in_force(slot_map, version).join(sizes, "virtual_slot")
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"))
    parts = (sizes.agg(F.max("n")).first()[0] or 0) // PART + 1
    order = [F.col(c) for c in ("doc_id", "text_crc32", "size", "row")]
    numbered = ranked(rows, ["virtual_slot"], F.xxhash64("row"), parts, order, "_nr")
    return numbered.join(F.broadcast(starts), "virtual_slot").withColumn("slot", (F.col("_nr") + F.col("_from")).cast("long")).drop("_nr", "_from")


def _sized(docs: DataFrame, slots: int) -> tuple[DataFrame, DataFrame]:
    """Written: the rows with a number each, and the slots' sizes."""
    rows = written(sized(only(docs, "doc_id", "text"), slots).withColumn("row", F.monotonically_increasing_id()), "sized")
    return rows, written(slot_sizes(rows, slots).coalesce(1), "slots")


def _version(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/version={version}"


def _dealt(sizes: DataFrame, path: str, shards: int) -> None:
    first_map(sizes, shards).drop("version").coalesce(1).write.parquet(_version(path, 1))


def _grown(sizes: DataFrame, path: str) -> int:
    stored = sizes.sparkSession.read.parquet(path)
    version, shards = stored.agg(F.max("version"), F.max("shard") + 1).first()
    # A version without rows is none to Spark's readers: a shard that needs no slot gets an empty one.
    more = grown(stored, sizes, version, shards).drop("version")
    if more.isEmpty():
        spare = sizes.orderBy("bytes", "virtual_slot").limit(1)
        more = spare.select("virtual_slot", F.lit(shards).cast("int").alias("shard"))
    more.coalesce(1).write.parquet(_version(path, version + 1))
    return version + 1


def deal(docs: DataFrame, path: str, shards: int = 8, slots: int = SLOTS) -> None:
    """Version 1 of the map, by the bytes of docs, under path; an error if there is one."""
    _dealt(_sized(docs, slots)[1], path, shards)


def add_shard(docs: DataFrame, path: str) -> int:
    """Adds a version with one more shard, by the bytes of docs, to the map under path; its number."""
    return _grown(_sized(docs, docs.sparkSession.read.parquet(path).agg(F.max("virtual_slot")).first()[0] + 1)[1], path)


def placed_by(docs: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot, map_version by the map under path, the latest version if none is named."""
    slot_map = docs.sparkSession.read.parquet(path)
    last, top = slot_map.agg(F.max("version"), F.max("virtual_slot")).first()
    rows, sizes = _sized(docs, top + 1)
    return placed(rows, sizes, slot_map, version or last).drop("row").withColumn("map_version", F.lit(version or last))


def sharded(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null by this law), virtual_slot, map_version, next_shard.

    Deals a map for docs and stores it under path (one of its own in the shared folder if none is named), with a
    version 2 that has one more shard; next_shard is where that holds the row.
    """
    path = path or f"{shared_folder(docs.sparkSession)}/framefold-slot-map-{uuid.uuid4().hex}"
    rows, sizes = _sized(docs, slots)
    _dealt(sizes, path, shards)
    _grown(sizes, path)
    both = docs.sparkSession.read.parquet(path)
    nxt = in_force(both, 2).select("virtual_slot", F.col("shard").alias("next_shard"))
    out = placed(rows, sizes, both, 1).join(F.broadcast(nxt), "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("map_version"), "next_shard")
