"""Rectangles of a layout as ranges of a space-filling key.

Positions are scaled to ``BITS`` bits an axis and their bits interleaved, so nodes
that lie together have keys near one another. A layout is written sorted by key; a
rectangle becomes a few ranges of keys, by which the scan leaves out whole files and
row groups before the exact test of the positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16
#: Ranges of a rectangle, at most about; cells that are cut further would make more.
RANGES = 32
# How far the bits of a number are spread, and what is left of them.
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(n: Column) -> Column:
    """The bits of a number of 16 bits with a gap after each."""
    for shift, mask in SPREAD:
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
    return n


def _cell(value: Column, low: Column, high: Column) -> Column:
    """A position as a whole number of BITS bits."""
    span = F.greatest(high - low, F.lit(1e-300))
    return F.least(F.greatest(F.floor((value - low) / span * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def write_layout(layout: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write ``layout`` (with ``x`` and ``y``) sorted by key to ``path/nodes``, and the box of all positions to ``path/box``."""
    box = layout.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    box.write.parquet(f"{path}/box")
    placed = layout.crossJoin(F.broadcast(layout.sparkSession.read.parquet(f"{path}/box")))  # one row
    key = _spread(_cell(F.col("x"), F.col("x0"), F.col("x1"))).bitwiseOR(F.shiftleft(_spread(_cell(F.col("y"), F.col("y0"), F.col("y1"))), 1))
    keyed = placed.withColumn("z", key).select(*layout.columns, "z")
    dealt = keyed.repartitionByRange(partitions, "z") if partitions else keyed.repartitionByRange("z")
    dealt.sortWithinPartitions("z").write.parquet(f"{path}/nodes")


def key_ranges(x0: int, y0: int, x1: int, y1: int, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of keys (both ends included) that hold all cells of a rectangle (ends included): squares wholly inside it, and of those that it cuts the larger ones are cut further as long as ``most`` allows."""
    whole, cut = [], [(0, 0, BITS)]
    while cut:
        nxt = []
        for cx, cy, size in cut:
            if cx > x1 or cy > y1 or cx + (1 << size) - 1 < x0 or cy + (1 << size) - 1 < y0:
                continue
            if cx >= x0 and cy >= y0 and cx + (1 << size) - 1 <= x1 and cy + (1 << size) - 1 <= y1:
                whole.append((cx, cy, size))
            else:
                nxt.append((cx, cy, size))
        if not nxt or nxt[0][2] == 0 or len(whole) + 4 * len(nxt) > most:
            whole += nxt
            break
        half = nxt[0][2] - 1
        cut = [(cx + (a << half), cy + (b << half), half) for cx, cy, _ in nxt for b in (0, 1) for a in (0, 1)]
    key = lambda cx, cy: sum((((cx >> i) & 1) << (2 * i)) | (((cy >> i) & 1) << (2 * i + 1)) for i in range(BITS))
    out: list[list[int]] = []
    for low, size in sorted((key(cx, cy), size) for cx, cy, size in whole):
        high = low + (1 << (2 * size)) - 1
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def read_rectangle(spark: SparkSession, path: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Nodes of a written layout at x in [x0, x1) and y in [y0, y1)."""
    nodes, box = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/box").first()
    exact = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    if box is None or box["x0"] is None or x1 <= box["x0"] or y1 <= box["y0"] or x0 > box["x1"] or y0 > box["y1"]:
        return nodes.drop("z").limit(0)

    def cell(value: float, low: float, high: float, step: int) -> int:
        # One cell more at either side, for what rounding may have done.
        return min(max(int((value - low) / max(high - low, 1e-300) * (1 << BITS)) + step, 0), (1 << BITS) - 1) if abs(value - low) < max(high - low, 1e-300) * 2 else (0 if value < low else (1 << BITS) - 1)

    ranges = key_ranges(cell(x0, box["x0"], box["x1"], -1), cell(y0, box["y0"], box["y1"], -1), cell(x1, box["x0"], box["x1"], 1), cell(y1, box["y0"], box["y1"], 1))
    near = F.lit(False)
    for a, b in ranges:
        near = near | F.col("z").between(a, b)
    return nodes.filter(near).filter(exact).drop("z")
