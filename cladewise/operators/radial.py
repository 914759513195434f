"""A radial layout in which every subtree has a fan of its own.

From the deepest level up, a node's fan (how far it reaches, half its angle) is
made of its children's fans as the node sees them, beside one another with an arc
between them: sums and maxima by parent, so that a node of very many children is
an aggregate and never one group. The arc is the longest at which no fan exceeds
half a turn, found by ``FOLDS`` folds of ``ARCS`` arcs each, every time between the
best arc so far and the next.

From the root down, a node's angle is the sum of its ancestors' offsets and its
place the sum of their links; both follow parent pointers in rounds of doubling.
Only the folds go level by level: a tree that is drawn has few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.operators import climb
from cladewise.operators.numbering import running
from cladewise.plans.storage import written

FOLDS, ARCS = 3, 8
#: The first fold's arcs, as powers of SPREAD times a first guess.
SPREAD = 4.0
#: Sizes of leaves and of inner nodes where ``nodes`` has none.
LEAF, INNER = 1.0, 0.01


def clean_length(length: Column) -> Column:
    """Negative and undefined lengths are 0."""
    return F.when(length.isNull() | F.isnan(length) | (length < 0), 0.0).otherwise(length)


def text_hash(text: Column) -> Column:
    """A signed 32-bit hash of a text's letters, each 31 times the one before."""
    whole = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(whole >= 2**31, whole - 2**32).otherwise(whole)


def _measured(nodes: DataFrame) -> DataFrame:
    """``node_id, parent_id, link, size, parent_size, depth``, by depth."""
    inner = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    size = F.when(F.col("children").isNull(), LEAF).otherwise(INNER)
    sized = nodes.join(inner, "node_id", "left").withColumn("_size", F.coalesce("size", size) if "size" in nodes.columns else size)
    sized = written(sized.select("node_id", "parent_id", clean_length(F.col("length")).alias("link"), F.col("_size").alias("size"), F.coalesce("children", F.lit(0)).alias("children")), "sized").df
    above = sized.select(F.col("node_id").alias("parent_id"), F.col("size").alias("parent_size"))
    return written(sized.join(climb.depths(nodes), "node_id").join(above, "parent_id", "left").orderBy("depth"), "measured").df


def _fans(measured: DataFrame, deepest: int, arcs: list[float], r0: float, power: float) -> list[DataFrame]:
    """The fans of each level's nodes for each arc, from the deepest level up: ``no, node_id, parent_id, angle`` (of the children, half), ``width`` (of the whole), and ``far, turn`` as the parent sees it."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(x).alias("arc")) for i, x in enumerate(arcs)])).alias("a")
    levels: list[DataFrame] = []
    for d in range(deepest, -1, -1):
        rows = measured.filter(F.col("depth") == d).select("*", each).select("node_id", "parent_id", "link", "size", "parent_size", "children", "a.no", "a.arc")
        if levels:
            below = levels[-1].groupBy("no", F.col("parent_id").alias("node_id")).agg(F.max("far").alias("reach"), F.sum(F.col("turn") + F.col("arc") / F.col("far")).alias("angle"))
            rows = rows.join(below, ["no", "node_id"], "left")
        else:
            rows = rows.withColumns({"reach": F.lit(None).cast("double"), "angle": F.lit(None).cast("double")})
        rows = rows.withColumns({"reach": F.coalesce("reach", F.lit(0.0)), "angle": F.coalesce("angle", F.lit(0.0)), "own": r0 * F.pow("size", F.lit(power))})
        rows = rows.withColumns({"own_angle": F.asin(F.least(F.lit(1.0), F.col("arc") * F.pow("size", F.lit(power)) / r0)), "whole": F.greatest("own", "reach")})
        rows = rows.withColumn("width", F.greatest("angle", F.col("own") * F.col("own_angle") / F.col("whole")))
        rows = rows.withColumns({"half": F.least("width", F.lit(math.pi)), "off": r0 * F.sqrt(F.coalesce("parent_size", F.lit(1.0))) + F.col("link")})
        # A fan that opens backwards is seen as the circle around its node, another by its outer corner.
        back = F.cos(math.pi - F.col("half")) > F.col("whole") / F.col("off")
        x, y = F.col("whole") * F.cos("half") + F.col("off"), F.col("whole") * F.sin("half")
        far = F.when(back, F.col("off")).otherwise(F.greatest(F.sqrt(x * x + y * y), "off", "whole"))
        turn = F.when(back, F.asin(F.col("whole") / F.col("off"))).otherwise(F.atan2(y, x))
        levels.append(written(rows.select("no", "arc", "node_id", "parent_id", "link", "parent_size", "children", "angle", "width", far.alias("far"), turn.alias("turn")), "fans").df)
    return levels


def fit(measured: DataFrame, deepest: int, r0: float, guess: float, power: float) -> tuple[float, DataFrame]:
    """The longest arc at which no fan exceeds half a turn (the shortest one tried, if none does), and the fans at it."""
    arcs = [guess * SPREAD ** (i - ARCS // 2 + 1) for i in range(ARCS)]
    for fold in range(FOLDS):
        levels = _fans(measured, deepest, arcs, r0, power)
        all_levels = levels[0]
        for level in levels[1:]:
            all_levels = all_levels.union(level)
        widest = {r["no"]: r["width"] for r in all_levels.groupBy("no").agg(F.max("width").alias("width")).collect()}
        fits = [i for i in range(ARCS) if widest[i] <= math.pi]
        best = max(fits, default=0)
        if fold == FOLDS - 1:
            return arcs[best], all_levels.filter(F.col("no") == best)
        low, high = arcs[best], arcs[min(best + 1, ARCS - 1)] if fits else arcs[0]
        arcs = [low * (high / low) ** (i / ARCS) for i in range(ARCS)]
    raise AssertionError


def radial_layout(nodes: DataFrame, link_scale: float = 500.0, power: float = 0.5) -> DataFrame:
    """``node_id, x, y`` of a tree ``node_id, parent_id, length`` (and ``size``, if it has sizes), the root at 0, 0. Of more than two, siblings go by a hash of their names."""
    measured = _measured(nodes)
    row = measured.agg(F.max("depth").alias("deepest"), F.max(F.when(F.col("parent_id").isNotNull(), F.col("link"))).alias("longest"), F.sum("size").alias("size")).first()
    if row["deepest"] is None:
        return nodes.select("node_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    r0 = (row["longest"] or link_scale / 2) / link_scale * 2
    arc, fans = fit(measured, row["deepest"], r0, r0 * math.pi / row["size"], power)
    fans = written(fans, "fitted").df
    above = fans.select(F.col("node_id").alias("parent_id"), F.col("angle").alias("parent_angle"), F.col("children").alias("siblings"), F.col("parent_id").isNull().alias("from_root"))
    rows = fans.filter("parent_id is not null").join(above, "parent_id")
    gap = F.when(F.col("from_root"), F.greatest(F.lit(0.0), (math.pi - F.col("parent_angle")) / F.col("siblings"))).otherwise(0.0)
    rows = rows.withColumns({"room": F.col("turn") + arc / F.col("far"), "key": F.when(F.col("siblings") > 2, text_hash(F.col("node_id").cast("string"))).otherwise(0)})
    rows = rows.withColumn("wide", 2 * (F.col("room") + gap)).select("node_id", "parent_id", "parent_angle", "from_root", "key", "room", "wide", (F.col("link") + r0 * F.sqrt("parent_size")).alias("off"))
    placed = written(running(rows, ["parent_id", "key", "node_id"], "wide", "run"), "placed").df
    first = placed.groupBy("parent_id").agg(F.min("run").alias("first"))
    offset = F.col("run") - F.col("first") + F.col("room") - F.when(F.col("from_root"), 0.0).otherwise(F.col("parent_angle"))
    offsets = placed.join(first, "parent_id").select("node_id", "parent_id", "off", offset.alias("offset"))
    angles = climb.followed(offsets.select(F.col("node_id").alias("at"), F.col("parent_id").alias("to"), "offset")).select(F.col("at").alias("node_id"), F.col("offset").alias("angle"))
    links = offsets.join(angles, "node_id").select(F.col("node_id").alias("at"), F.col("parent_id").alias("to"), (F.col("off") * F.cos("angle")).alias("x"), (F.col("off") * F.sin("angle")).alias("y"))
    found = climb.followed(links).select(F.col("at").alias("node_id"), "x", "y")
    return nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
