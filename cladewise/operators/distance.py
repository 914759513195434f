"""All-pairs distances of packed profiles, block by block.

Rows fall into blocks by a hash of their id, and a numpy kernel computes the
distances of each pair of blocks at once. A block holds about BLOCK rows, so the
work spreads over (n / BLOCK)^2 / 2 pairs, and none grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.functions.kernels import Each, distances
from cladewise.model import DistanceSpec
from cladewise.operators.profile import complete_loci, unpack
from cladewise.plans.storage import written

#: Rows of a block, about.
BLOCK = 1024
#: Blocks that a task holds on one side of its pairs.
HELD = 64
#: Tasks for each core, about.
WAVES = 6


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


#: What a pair of blocks gives: from the rows of the sources and of the targets, their distances, and whether both are one block.
Made = Callable[[pa.Table, pa.Table, np.ndarray, bool], pa.Table]


def by_blocks(packed: DataFrame, spec: DistanceSpec, made: Made, schema: str, node: str = "sample", carry: tuple[str, ...] = (), each: Each | None = None) -> DataFrame:
    """What ``made`` gives for each pair of blocks; for both directions where the distance is directed.

    The rows that it gets have ``id`` and the columns of ``carry``; ``each``: what is made of every distance first. The
    distances themselves are stored nowhere. A block is one row of a table; tasks take some of its rows by others of
    them as they read both, so a row of the input is shuffled twice, however many blocks there are.
    """
    n = packed.count()
    blocks = max(1, -(-n // BLOCK))
    loci = np.array(complete_loci(packed), int) if (spec.matrix, spec.missing) == ("symmetric", "complete_delete") else None
    presence = presence_weights(packed, n) if spec.matrix == "asymmetric_wgMLST" else None
    directed = spec.directed

    def pair(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        x, y = _matrix(left.column("alleles")), _matrix(right.column("alleles"))
        u, v = left.drop_columns(["alleles"]), right.drop_columns(["alleles"])
        turns = ((x, y, u, v), (y, x, v, u))[: 2 if directed and not same else 1]
        return pa.concat_tables([made(f, g, distances(p, q, spec, loci, presence, each), same) for p, q, f, g in turns])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("one"), batch.column("two")
            for k in range(len(batch)):
                left, right = (pa.Table.from_struct_array(batch.column(side)[k].values) for side in ("left", "right"))
                yield from pair(left, right, one[k] == two[k]).combine_chunks().to_batches()

    block = F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int")
    table = written(packed.groupBy(block.alias("one")).agg(F.collect_list(F.struct(F.col(node).alias("id"), "alleles", *carry)).alias("left")), "profiles-by-block").df
    # Each block meets half of the others, so that all have as much to do; each task holds a few blocks on the one side.
    meet = F.pmod(F.col("two") - F.col("one"), F.lit(blocks)) * 2
    mine = (meet < blocks) | ((meet == blocks) & (F.col("one") < F.col("two")))
    cores = packed.sparkSession.sparkContext.defaultParallelism
    few = max(1, -(-blocks // HELD))
    lefts = table.repartition(min(blocks, max(1, -(-WAVES * cores // few))))
    rights = table.select(F.col("one").alias("two"), F.col("left").alias("right")).repartition(few)
    return lefts.join(rights.hint("shuffle_replicate_nl"), mine).select("one", "left", "two", "right").mapInArrow(kernel, schema)


def pairs(packed: DataFrame, spec: DistanceSpec, node: str = "sample", below: float | None = None, each: Each | None = None) -> DataFrame:
    """``src, dst, d`` of all pairs: both directions where the distance is directed, else src < dst. With ``below``, only of nearer ones. ``each``: what is made of the distances, as by rounding.

    Identical ids are taken as one row, so callers give distinct ids. Fewer than two rows give none.
    """
    kind = dict(packed.dtypes)[node]
    directed = spec.directed

    def made(left: pa.Table, right: pa.Table, d: np.ndarray, same: bool) -> pa.Table:
        kind_, u, v = left.column("id").type, left.column("id").to_numpy(), right.column("id").to_numpy()
        src, dst, d = np.repeat(u, len(v)), np.tile(v, len(u)), d.ravel()
        if same or below is not None:
            keep = (src != dst if directed else src < dst) if same else np.ones(len(d), bool)
            if below is not None:
                keep &= d < below
            src, dst, d = src[keep], dst[keep], d[keep]
        if not directed:
            src, dst = np.minimum(src, dst), np.maximum(src, dst)
        return pa.table({"src": pa.array(src, kind_), "dst": pa.array(dst, kind_), "d": pa.array(d, pa.float64())})

    return by_blocks(packed, spec, made, f"src {kind}, dst {kind}, d double", node, each=each)


def presence_weights(packed: DataFrame, n: int) -> np.ndarray:
    """m (m - 1) / (n (n - 1)) of each locus, m being the samples that have it. (As long as a profile is wide.)"""
    rows = unpack(packed, packed.columns[0]).groupBy("locus").agg(F.sum((F.col("allele") > 0).cast("long")).alias("m")).orderBy("locus").collect()
    m = np.array([r["m"] for r in rows], float)
    return m * (m - 1) / max(1.0, float(n) * (n - 1))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected pair in both directions."""
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d"))


def link_lengths(edges: DataFrame, packed: DataFrame, policy: str = "pair_delete", node: str = "rep") -> DataFrame:
    """``src, dst, length``: loci at which the ends of each edge differ (both present, unless missing is an allele)."""
    side = lambda end: packed.select(F.col(node).alias(end), F.col("alleles").alias(f"_{end}"))
    differ = "x <> y" if policy == "as_allele" else "x <> y and x > 0 and y > 0"
    both = edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")
    return both.select("src", "dst", F.expr(f"cast(size(filter(zip_with(_src, _dst, (x, y) -> {differ}), t -> t)) as bigint)").alias("length"))


def normalised(edges: DataFrame, reps: DataFrame, loci: int, spec: DistanceSpec) -> DataFrame:
    """Distances of all members: divided by the number of loci where the distance is scaled; members of one group are at the group's own distance, 0 (0.01 / (loci + 0.01) where none is missing would be the same to 6 digits only for equal profiles)."""
    scale = float(loci) if spec.scaled else 1.0
    full = edges if spec.directed else both_ways(edges)
    full = full.union(reps.select(F.col("rep").alias("src"), F.col("rep").alias("dst"), F.lit(0.0).alias("d")))
    side = lambda end: reps.select(F.col("rep").alias(end), F.explode("members").alias(f"{end}_member"))
    return full.join(side("src"), "src").join(side("dst"), "dst").select(F.col("src").alias("src_rep"), F.col("dst").alias("dst_rep"), F.col("src_member").alias("src"), F.col("dst_member").alias("dst"), (F.col("d") / scale).alias("d"))


def member_totals(reps: DataFrame, loci: int, spec: DistanceSpec) -> DataFrame:
    """``src, total, farthest, n`` of each member: the sum of its ``normalised`` distances, the largest (to 6 digits) and how many there are, its own included.

    Members of one group are alike, so distances are taken of the groups alone and weighed by their sizes; no pair of members is made.
    """
    kind, scale = dict(reps.dtypes)["rep"], float(loci) if spec.scaled else 1.0

    def made(left: pa.Table, right: pa.Table, d: np.ndarray, same: bool) -> pa.Table:
        each = d / scale
        if same:
            np.fill_diagonal(each, 0)
        turns = [(left, right, each)] + ([(right, left, each.T)] if not spec.directed and not same else [])
        parts = [pa.table({"rep": u.column("id"), "s": pa.array((x * v.column("size").to_numpy()[None, :]).sum(axis=1), pa.float64()), "far": pa.array(x.max(axis=1, initial=0.0), pa.float64())}) for u, v, x in turns]
        return pa.concat_tables(parts)

    rows = reps.select("rep", "alleles", "size")
    found = by_blocks(rows, spec, made, f"rep {kind}, s double, far double", "rep", ("size",)).groupBy("rep").agg(F.sum("s").alias("total"), F.round(F.max("far"), 6).alias("farthest"))
    n = reps.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long")).first()[0]
    return reps.select("rep", F.explode("members").alias("src")).join(found, "rep").select("src", "total", "farthest", F.lit(n).cast("long").alias("n"))
