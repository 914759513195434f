"""Connected components of an edge table, by alternating stars.

Each round replaces the edges by edges to the smallest neighbour, first over
larger neighbours and then over smaller ones. The edge set shrinks to one star
for each component after O(log^2 n) rounds. Every step is a join with one row
for each node on one side, so a hub with a third of all edges is split by the
skew-join rule, and no neighbour list is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.plans.storage import Written, written

MAX_ROUNDS = 200


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges here point from the larger node ``u`` to the smaller ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def star_forest(edges: DataFrame, src: str = "src", dst: str = "dst") -> Written | None:
    """``(node, component)`` for every node of an edge that isn't its component's smallest.

    Null ends and loops count as no edge. Returns None where no edge is left.
    The caller drops the returned table.
    """
    plain = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).alias("a"), F.col(dst).alias("b"))
        .filter("a is not null and b is not null and a <> b")
        .select("u", "v")
        .distinct()
    )
    now = written(plain, "edges")
    state = _state(now.df)
    if state[0] == 0:
        now.drop()
        return None
    for _ in range(MAX_ROUNDS):
        new = written(_small_star(_large_star(now.df)), "edges")
        now.drop()
        now, was, state = new, state, _state(new.df)
        if state == was:
            now.df = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def components(nodes: DataFrame, edges: DataFrame, node: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """``nodes`` with a column ``component``: the smallest node reachable, itself included."""
    forest = star_forest(edges, src, dst)
    if forest is None:
        return nodes.withColumn("component", F.col(node))
    found = forest.df.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return nodes.join(found, F.col(node) == F.col("_node"), "left").withColumn("component", F.coalesce("_component", node)).drop("_node", "_component")
