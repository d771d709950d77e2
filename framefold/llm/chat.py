"""Conversations from reply trees, formatted with loss spans, in DataFrame functions only.

Messages form trees: (conv_id, node_id, parent_id, role, text, score).  Iterative self-joins double each
node's jump towards its root, so a tree of depth d takes log2(d) joins.  That gives every leaf the score of
its branch (the sum of its messages' scores).  Branches are ranked in their tree, and the jumps, taken in
falling order, enumerate the messages of each chosen branch once.  Texts join only then.

Defined cases: null role or text is empty; null score is 0; a parent that doesn't exist makes its child a
root; messages on a parent cycle, or below one, belong to no root-to-leaf path and are left out; messages
of one tree need distinct node_ids (linear() makes them); empty tables give empty results.

A very long text is formatted whole; paths with equal scores rank by their leaf; columns beside those named aren't
read, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framefold.llm.common import discard, only, written


@dataclass(frozen=True)
class Template:
    """Marks around a turn.  All begin with `<|`, which a formatted text holds nowhere else."""

    start: str = "<|start|>"
    middle: str = "<|message|>"
    end: str = "<|end|>"

    def __post_init__(self) -> None:
        if not all(x.startswith("<|") and x.endswith("|>") for x in (self.start, self.middle, self.end)):
            raise ValueError("marks are written <|...|>")


def escaped(col: Column) -> Column:
    """Backslashes twice, then <| as <\\|: so no mark can occur inside, and unescaped() undoes it."""
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def linear(rows: DataFrame) -> DataFrame:
    """Conversations without branches as reply trees: each turn replies to the one before.

    rows: (conv_id, turn, role, text).  Equal turns are ordered by role and text; a null turn comes first.
    A conversation is one row in the end, so its turns meet in one task here too.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    plain = only(rows, "conv_id", "turn", "role", "text").select("conv_id", "turn", role, text)
    numbered = plain.withColumn("node_id", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return numbered.select("conv_id", "node_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables (conv_id, node, up) of 1, 2, 4, ... steps, and for each rooted node its depth and branch score."""
    ids = nodes.select(F.col("conv_id").alias("pc"), F.col("node").alias("pn"))
    known = nodes.join(ids, nodes.conv_id.eqNullSafe(F.col("pc")) & (nodes.parent == F.col("pn")), "left")
    step = written(known.select("conv_id", "node", F.col("pn").alias("up"), F.when(F.col("pn").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), "score"), "jump")
    tables, open_before = [], -1
    while True:
        left = step.filter("up is not null").count()
        if left in (0, open_before):  # none goes on, or only cycles do
            return tables, step.filter("up is null")
        open_before = left
        tables.append(step)
        # Only nodes that haven't met their root go on, so a round costs what is deeper than its jump.
        active, done = step.filter("up is not null"), step.filter("up is null")
        on = step.select(F.col("conv_id").alias("oc"), F.col("node").alias("on"), F.col("up").alias("oup"), F.col("depth").alias("odepth"), F.col("score").alias("oscore"))
        joined = active.join(on, active.conv_id.eqNullSafe(F.col("oc")) & (active.up == F.col("on")))
        moved = joined.select("conv_id", "node", F.col("oup").alias("up"), (F.col("depth") + F.col("odepth")).alias("depth"), (F.col("score") + F.col("oscore")).alias("score"))
        step = written(moved.union(done), "jump")


def branches(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(conv_id, leaf, rank, score, node, depth): the messages of the `best` branches of each tree (None: of all)."""
    nodes = written(messages.select("conv_id", F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "nodes")
    tables, rooted = _jumps(nodes)
    parents = nodes.filter("parent is not null").select(F.col("conv_id").alias("pc"), F.col("parent").alias("pn")).distinct()
    leaves = rooted.join(parents, rooted.conv_id.eqNullSafe(F.col("pc")) & (rooted.node == F.col("pn")), "left_anti")
    order = W.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("depth"), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if best is not None:
        ranked = ranked.filter(F.col("rank") <= best)
    path = written(ranked.select("conv_id", F.col("node").alias("leaf"), "rank", "score", "node", "depth"), "path")
    for k in reversed(range(len(tables))):
        hop = tables[k].filter("up is not null").select(F.col("conv_id").alias("hc"), F.col("node").alias("hn"), "up")
        moved = path.join(hop, path.conv_id.eqNullSafe(F.col("hc")) & (path.node == F.col("hn")))
        more = moved.select("conv_id", "leaf", "rank", "score", F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        longer = written(path.union(more), "path")
        discard(path)
        discard(tables[k])
        path = longer
    return path


def formatted(messages: DataFrame, best: int | None = 1, template: Template = Template(), learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each chosen branch: conv_id, leaf, rank, score, text, and loss, the spans (begin, length) that are learned.

    Spans count code points from 0 and cover the escaped texts of the learned roles, not the marks.
    """
    texts = messages.select(F.col("conv_id").alias("tc"), F.col("node_id").alias("tn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    path = branches(messages, best)
    turns = path.join(texts, path.conv_id.eqNullSafe(F.col("tc")) & (path.node == F.col("tn"))).drop("tc", "tn")
    head = F.concat(F.lit(template.start), escaped(F.col("role")), F.lit(template.middle))
    turns = turns.withColumn("head", F.length(head)).withColumn("body", escaped(F.col("text"))).withColumn("piece", F.concat(head, "body", F.lit(template.end)))
    before = W.partitionBy("conv_id", "leaf").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("begin", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("head"))
    span = F.when(F.col("role").isin(*learned), F.struct(F.col("begin").cast("long").alias("begin"), F.length("body").cast("long").alias("length")))
    gathered = turns.groupBy("conv_id", "leaf").agg(F.first("rank").alias("rank"), F.first("score").alias("score"), F.sort_array(F.collect_list(F.struct("depth", "piece"))).alias("p"), F.sort_array(F.collect_list(span)).alias("loss"))
    return gathered.select("conv_id", "leaf", "rank", "score", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), "loss")


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """chats plus turns, an array of (role, text) taken from the formatted text, and learned, the unescaped texts under the spans."""

    def quoted(x: str) -> str:
        return "\\Q" + x + "\\E"

    parts = F.filter(F.split("text", quoted(template.start), -1), lambda x, i: i > 0)
    inner = F.transform(parts, lambda x: F.split(F.left(x, F.length(x) - len(template.end)), quoted(template.middle), -1))
    turns = F.transform(inner, lambda x: F.struct(unescaped(x[0]).alias("role"), unescaped(x[1]).alias("text")))
    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), (s["begin"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.withColumn("turns", turns).withColumn("learned", learned)


def digests(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id and what read_back() finds, as counts and SHA-256 digests."""
    back = read_back(chats, template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )
