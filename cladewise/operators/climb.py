"""Walks along pointers, in rounds of doubling.

A table of pointers follows itself a few times in a round and is written once, so
a chain of any length ends after a number of rounds that grows with the logarithm
of its length, whatever the shape of the tree. Each join has one row for each
pointer's end on one side; where many rows point at one, the skew-join rule
splits the other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cladewise.operators.numbering import numbered
from cladewise.plans.storage import Written, written

#: How often a table of pointers follows itself in a round: a round covers 1 + STEPS times the way of the one before.
STEPS = 3


def _told(df: DataFrame, flag: str, name: str) -> tuple[Written, int]:
    """``df`` written, and how many of its rows have the flag (counted as they are written)."""
    seen = Observation()
    table = written(df.observe(seen, F.count_if(F.col(flag)).alias("n")), name)
    return table, seen.get["n"]


def followed(pointers: DataFrame, longest: int | None = None) -> DataFrame:
    """``at, to`` and sums, with ``to`` followed until it names no row (or is null), and all other columns added up on the way.

    Pointers on a circle never end: with ``longest``, the rounds end where a way of so many steps has; rows that still point at a row are on a circle.
    """
    sums = [c for c in pointers.columns if c not in ("at", "to")]
    now = written(pointers.select("at", "to", *sums, F.lit(True).alias("moved")), "pointers")
    way, on = 1, F.col("_at").isNotNull()
    while longest is None or way < longest:
        other = now.df.select(F.col("at").alias("_at"), F.col("to").alias("_to"), *[F.col(c).alias(f"_{c}") for c in sums])
        step = now.df.select("at", "to", *sums, F.lit(False).alias("moved"))
        for _ in range(STEPS):
            added = [(F.col(c) + F.when(on, F.col(f"_{c}")).otherwise(0)).alias(c) for c in sums]
            step = step.join(other, step["to"] == other["_at"], "left").select("at", F.when(on, F.col("_to")).otherwise(F.col("to")).alias("to"), *added, (F.col("moved") | on).alias("moved"))
        after, moved = _told(step, "moved", "pointers")
        now.drop()
        now, way = after, way * (1 + STEPS)
        if not moved:
            break
    return now.df.select("at", "to", *sums)


def up(nodes: DataFrame, n: str = "1L") -> DataFrame:
    """The pointers ``at, to, n`` from each node of ``node_id, parent_id`` to its parent; ``n`` is an expression."""
    return nodes.filter("parent_id is not null").select(F.col("node_id").alias("at"), F.col("parent_id").alias("to"), F.expr(n).alias("n"))


def depths(nodes: DataFrame) -> DataFrame:
    """``node_id, depth`` below the root."""
    found = followed(up(nodes)).select(F.col("at").alias("node_id"), F.col("n").cast("int").alias("depth"))
    return nodes.select("node_id").join(found, "node_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def at_or_above(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """``node_id`` of the kept nodes and all above them.

    A marked node marks what its pointer names, and pointers double: after k rounds all ancestors less than 2^k steps up are marked.
    """
    kept = keep.select("node_id", F.lit(True).alias("_kept")).distinct()
    start = nodes.join(kept, "node_id", "left").select("node_id", F.col("parent_id").alias("up"), F.col("_kept").isNotNull().alias("marked"))
    now, live = _told(start.withColumn("live", F.expr("marked and up is not null")), "live", "marks")
    while live:
        other = now.df.select(F.col("node_id").alias("_n"), F.col("up").alias("_up"))
        hit = now.df.filter("live").select(F.col("up").alias("_hit")).distinct()
        both = now.df.join(other, F.col("up") == F.col("_n"), "left").join(hit, F.col("node_id") == F.col("_hit"), "left")
        step = both.select("node_id", F.col("_up").alias("up"), (F.col("marked") | F.col("_hit").isNotNull()).alias("marked"))
        after, live = _told(step.withColumn("live", F.expr("marked and up is not null")), "live", "marks")
        now.drop()
        now = after
    return now.df.filter("marked").select("node_id")


def nearest(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """``node_id, top_id``: the first of ``tops`` at or above each node that has one."""
    chosen = nodes.join(tops.select("node_id").distinct(), "node_id", "left_semi").select("node_id")
    ends = followed(up(nodes.join(chosen, "node_id", "left_anti"))).select(F.col("at").alias("node_id"), F.col("to").alias("top_id"))
    return ends.join(chosen.select(F.col("node_id").alias("top_id")), "top_id", "left_semi").select("node_id", "top_id").union(chosen.select("node_id", F.col("node_id").alias("top_id")))


def pairs_below(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """``top_id, node_id`` of every node at or below each of ``tops``, each pair once.

    Nodes find their nearest top; the tops above one another are a tree of their own, whose pairs come from pairs up to 2^k steps and pointers of just 2^k.
    """
    near = written(nearest(nodes, tops), "nearest").df
    chosen = near.filter("node_id = top_id").select("node_id")
    parents = nodes.join(chosen, "node_id", "left_semi").filter("parent_id is not null").select(F.col("node_id").alias("low"), "parent_id")
    step, left = _told(parents.join(near.select(F.col("node_id").alias("parent_id"), F.col("top_id").alias("high")), "parent_id").select("low", "high", F.lit(True).alias("on")), "on", "steps")
    pairs, first = step.df.select("low", "high"), step
    while left:
        of = step.df.select(F.col("low").alias("_low"), F.col("high").alias("_high"))
        more = written(pairs.join(of.select(F.col("_low").alias("l"), F.col("_high").alias("low")), "low").select(F.col("l").alias("low"), "high"), "pairs").df
        further = step.df.join(of, step.df["high"] == of["_low"]).select("low", F.col("_high").alias("high"), F.lit(True).alias("on"))
        pairs = pairs.union(more)
        before = step
        step, left = _told(further, "on", "steps")
        if before is not first:
            before.drop()
    found = near.join(pairs.select(F.col("low").alias("top_id"), "high"), "top_id").select(F.col("high").alias("top_id"), "node_id")
    return near.select("top_id", "node_id").union(found)


def rooted(edges: DataFrame, root) -> DataFrame:
    """``node, parent, length, depth`` of the tree of undirected edges ``u, v, length`` that holds ``root``, as seen from it. What isn't tied to the root is left out.

    A tour passes every edge both ways: after an edge into a node comes the edge that follows its reverse around that node. Ranks along the tour say which way came first.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)["u"]
    top = spark.createDataFrame([(root,)], f"node {kind}")
    out = top.select("node", F.lit(None).cast(kind).alias("parent"), F.lit(0.0).alias("length"), F.lit(0).alias("depth"))
    both = edges.select(F.col("u").alias("tail"), F.col("v").alias("head"), "length").union(edges.select("v", "u", "length"))
    arcs = written(numbered(both, ["tail", "head"], "at"), "arcs").df
    size = arcs.agg(F.count("*").alias("n"), F.min(F.when(F.col("tail") == F.lit(root), F.col("at"))).alias("start")).first()
    if size["start"] is None:
        return out
    ahead = arcs.join(arcs.select((F.col("at") - 1).alias("at"), F.col("tail").alias("_next")), "at", "left")
    first = arcs.groupBy("tail").agg(F.min("at").alias("turn"))
    turn = ahead.filter("_next = tail").select("at", (F.col("at") + 1).alias("turn")).union(ahead.filter("_next is null or _next <> tail").join(first, "tail").select("at", "turn"))
    back = arcs.select(F.col("head").alias("tail"), F.col("tail").alias("head"), F.col("at").alias("back"))
    tour = written(arcs.join(back, ["tail", "head"]).join(turn.withColumnRenamed("at", "back"), "back").select("at", "tail", "head", "length", "back", F.when(F.col("turn") != size["start"], F.col("turn")).alias("to")), "tour").df
    ranks = followed(tour.select("at", "to", F.lit(1).cast("long").alias("n")), size["n"]).filter("to is null").select("at", "n")
    other = ranks.select(F.col("at").alias("back"), F.col("n").alias("_n"))
    down = written(tour.join(ranks, "at").join(other, "back").filter("n > _n").select(F.col("head").alias("node_id"), F.col("tail").alias("parent_id"), "length"), "down").df
    found = down.join(followed(up(down)).select(F.col("at").alias("node_id"), F.col("n").cast("int").alias("depth")), "node_id")
    return out.union(found.select(F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), F.col("length").cast("double"), "depth"))

