"""Near pairs of profiles by bands of loci, without all pairs of blocks.

Two profiles that differ at no more than k loci are equal in at least one of any
k + 1 bands of loci. Rows meet in a group for each band and its alleles, and only
there are distances taken. Where a locus that the target lacks doesn't count, a
band counts only if the target lacks none of it; a target with fewer than k + 1
such bands (``hard``) is compared with all sources by pairs of blocks instead, so
nothing is lost whatever is missing.

Small groups share a task, some ``BLOCK`` rows together; a group of more rows falls
into blocks, and each pair of its blocks is a task. No task grows with the input.
Where the groups would hold as many pairs as there are (bands too narrow to part
the rows), all pairs of blocks are compared instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions.kernels import distances
from cladewise.model import DistanceSpec
from cladewise.operators.distance import _matrix, by_blocks
from cladewise.plans.storage import written

#: Rows of a group, or of a block of a large group, about.
BLOCK = 512

#: What a group gives: sources, targets, their distances, and which pairs are near and belong to this group.
Made = Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], pa.Table]


def bands(loci: int, n: int) -> list[tuple[int, int]]:
    """``n`` stretches of loci, as even as can be: (first, after the last)."""
    cuts = [loci * i // n for i in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _whole(lo: int, hi: int) -> Column:
    """Whether no locus of a band is missing."""
    return F.forall(F.slice("alleles", lo + 1, hi - lo), lambda a: a > 0)


def _chosen(packed: DataFrame, loci: int, most: int, lacking: bool) -> list[tuple[int, int]]:
    """The fewest bands that leave at most a hundredth of the targets hard, of k + 1, 3/2, 2 and 4 times as many; else those that leave the fewest."""
    least = most + 1
    if least > loci:
        return []
    if not lacking:
        return bands(loci, least)
    choices = [bands(loci, n) for n in sorted({min(loci, math.ceil(least * x)) for x in (1, 1.5, 2, 4)})]
    hard = lambda cut: F.count_if(sum((_whole(lo, hi).cast("int") for lo, hi in cut), F.lit(0)) < least)
    row = packed.agg(F.count("*").alias("n"), *[hard(cut).alias(f"h{i}") for i, cut in enumerate(choices)]).first()
    left = [row[f"h{i}"] for i in range(len(choices))]
    return next((cut for cut, h in zip(choices, left, strict=True) if 100 * h <= row["n"]), choices[int(np.argmin(left))])


def near_groups(packed: DataFrame, spec: DistanceSpec, below: float, made: Made, schema: str, node: str = "rep", carry: tuple[str, ...] = ()) -> DataFrame:
    """What ``made`` gives for each group of rows that hold pairs nearer than ``below``; every such pair belongs to one group.

    ``spec``: a distance of which each locus that differs adds 1 at least: directed ones without weights, and symmetric ones with missing as an allele.
    The rows that ``made`` gets have ``id`` and the columns of ``carry``. Undirected pairs come once.
    """
    lacking = spec.matrix == "asymmetric"
    if not lacking and (spec.matrix, spec.missing) != ("symmetric", "as_allele"):
        raise ValueError(f"no bands for {spec.matrix}, {spec.missing}")
    rows = written(packed.select(F.col(node).alias("id"), "alleles", *carry), "rows").df
    first = rows.select(F.size("alleles").alias("loci")).first()
    most = math.ceil(below) - 1
    cut = _chosen(rows, first["loci"] if first else 0, most, lacking)
    whole = [_whole(lo, hi) if lacking else F.lit(True) for lo, hi in cut]
    easy = sum((w.cast("int") for w in whole), F.lit(0)) > most
    each, groups = _grouped(rows, cut, whole) if cut else (None, None)
    if not cut or _narrow(groups, rows.count()):
        return _all(rows, spec, below, made, schema, carry)
    found = _by_bands(rows.withColumn("easy", easy), spec, below, cut, each, groups, made, schema, carry)
    return found.unionByName(_rest(rows, rows.filter(~easy), spec, below, made, schema, carry)) if lacking else found


def _all(rows: DataFrame, spec: DistanceSpec, below: float, made: Made, schema: str, carry: tuple[str, ...]) -> DataFrame:
    """All pairs, by pairs of blocks."""

    def near(left: pa.Table, right: pa.Table, d: np.ndarray, same: bool) -> pa.Table:
        mine = d < below
        if same:
            mine &= ~np.eye(len(d), dtype=bool) if spec.directed else np.triu(np.ones(d.shape, bool), 1)
        return made(left, right, d, mine)

    return by_blocks(rows, spec, near, schema, "id", carry)


def _narrow(groups: DataFrame, n: int) -> bool:
    """Whether groups hold as many pairs together as all rows."""
    return groups.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0))).first()[0] >= float(n) * n


def _grouped(rows: DataFrame, cut: list[tuple[int, int]], whole: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The bands of each row, and the groups of two rows at least that are equal in one, with their sizes."""
    keys = [F.when(w, F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("alleles", lo + 1, hi - lo)).alias("key"))) for i, ((lo, hi), w) in enumerate(zip(cut, whole, strict=True))]
    each = rows.select("id", F.explode(F.array_compact(F.array(*keys))).alias("b")).select("id", "b.band", "b.key")
    return each, written(each.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"), "groups").df


def _by_bands(rows: DataFrame, spec: DistanceSpec, below: float, cut: list[tuple[int, int]], each: DataFrame, groups: DataFrame, made: Made, schema: str, carry: tuple[str, ...]) -> DataFrame:
    """Pairs of easy targets, in groups of equal bands."""
    bins = max(1, (groups.agg(F.sum("n")).first()[0] or 0) // BLOCK)
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    alone = F.col("n") <= BLOCK
    # Small groups go to a bin together; a large one is a bin of its own, in pairs of blocks.
    placed = each.join(groups, ["band", "key"]).withColumn("block", F.when(alone, 0).otherwise(F.pmod(F.xxhash64("id", F.lit("block")), parts).cast("int")))
    others = F.when(alone, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), parts - 1))
    bin_ = F.when(alone, F.pmod(F.xxhash64("band", "key"), F.lit(bins))).otherwise(F.xxhash64("band", "key", F.lit("bin")))
    spread = placed.select("id", "band", "key", "block", bin_.alias("bin"), F.explode(others).alias("other"))
    spread = spread.select("id", "band", "key", "block", "bin", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))

    def kernel(table: pa.Table) -> pa.Table:
        # Not by the order of the rows, but by band, key and block.
        table = table.sort_by([(c, "ascending") for c in ("band", "key", "block")])
        facts, alleles = table.select(["id", *carry]), _matrix(table.column("alleles"))
        band, key, block, easy = (table.column(c).to_numpy() for c in ("band", "key", "block", "easy"))
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        edge = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (key[1:] != key[:-1]), [True]]))
        out = [made(facts.slice(0, 0), facts.slice(0, 0), np.zeros((0, 0)), np.zeros((0, 0), bool))]
        for p, q in zip(edge[:-1], edge[1:], strict=True):
            a, b = (np.arange(p, q)[block[p:q] == x] for x in (one, two))
            for u, v in ((a, b), (b, a))[: 2 if spec.directed and one != two else 1]:
                if len(u) and len(v):
                    d = distances(alleles[u], alleles[v], spec)
                    mine = d < below
                    if spec.directed:
                        mine &= easy[v][None, :]
                    if one == two:
                        mine &= ~np.eye(len(u), dtype=bool) if spec.directed else np.triu(np.ones((len(u), len(u)), bool), 1)
                    # A pair belongs to the first band in which it is equal.
                    for lo, hi in cut[: band[p]]:
                        mine &= ~((alleles[u][:, None, lo:hi] == alleles[v][None, :, lo:hi]).all(axis=2) & _present(alleles[v][:, lo:hi], spec)[None, :]) if mine.any() else True
                    if mine.any():
                        out.append(made(facts.take(pa.array(u)), facts.take(pa.array(v)), d, mine))
        return pa.concat_tables(out)

    return spread.join(rows, "id").groupBy("bin", "one", "two").applyInArrow(kernel, schema)


def _present(alleles: np.ndarray, spec: DistanceSpec) -> np.ndarray:
    """Whether a band of each row may be a key."""
    return (alleles > 0).all(axis=1) if spec.directed else np.ones(len(alleles), bool)


def _rest(rows: DataFrame, hard: DataFrame, spec: DistanceSpec, below: float, made: Made, schema: str, carry: tuple[str, ...]) -> DataFrame:
    """Pairs of all sources and the hard targets, by pairs of blocks."""
    counts = [max(1, -(-x.count() // BLOCK)) for x in (rows, hard)]
    side = lambda x, mine, other, name: x.select("id", "alleles", *carry, F.lit(name).alias("side"), F.pmod(F.xxhash64("id"), F.lit(mine)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("met"))
    sources = side(rows, counts[0], counts[1], "source").withColumnsRenamed({"own": "one", "met": "two"})
    targets = side(hard, counts[1], counts[0], "target").withColumnsRenamed({"own": "two", "met": "one"})

    def kernel(table: pa.Table) -> pa.Table:
        of = table.column("side").to_numpy() == "source"
        facts, alleles = table.select(["id", *carry]), _matrix(table.column("alleles"))
        u, v = np.flatnonzero(of), np.flatnonzero(~of)
        left, right = facts.take(pa.array(u)), facts.take(pa.array(v))
        if not len(u) or not len(v):
            return made(left.slice(0, 0), right.slice(0, 0), np.zeros((0, 0)), np.zeros((0, 0), bool))
        d = distances(alleles[u], alleles[v], spec)
        a, b = (x.column("id").to_numpy()[:, None] for x in (left, right))
        mine = (d < below) & ((a != b.T) if spec.directed else (a < b.T))
        return made(left, right, d, mine)

    return sources.unionByName(targets).groupBy("one", "two").applyInArrow(kernel, schema)


def near_pairs(packed: DataFrame, spec: DistanceSpec, below: float, node: str = "rep") -> DataFrame:
    """``src, dst, d`` of all pairs nearer than ``below``: both directions where the distance is directed, else src < dst."""
    kind = dict(packed.dtypes)[node]

    def made(left: pa.Table, right: pa.Table, d: np.ndarray, mine: np.ndarray) -> pa.Table:
        u, v = np.nonzero(mine)
        src, dst = left.column("id").take(pa.array(u)), right.column("id").take(pa.array(v))
        return pa.table({"src": src, "dst": dst, "d": pa.array(d[mine].astype(float))})

    found = near_groups(packed, spec, below, made, f"src {kind}, dst {kind}, d double", node)
    return found if spec.directed else found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "d")


def near_counts(packed: DataFrame, spec: DistanceSpec, below: float, node: str = "rep") -> DataFrame:
    """``dst, n, nearest``: how many sources each target has nearer than ``below``, and how far the nearest is; targets without any have no row.

    A group sends on one row for each of its targets, however many pairs are near.
    """
    kind = dict(packed.dtypes)[node]

    def ends(ids: pa.ChunkedArray, d: np.ndarray, mine: np.ndarray) -> pa.Table:
        n = mine.sum(axis=0) if len(mine) else np.zeros(len(ids), np.int64)
        at = np.flatnonzero(n)
        return pa.table({"dst": ids.take(pa.array(at)), "n": pa.array(n[at], pa.int64()), "nearest": pa.array(np.where(mine, d, np.inf).min(axis=0, initial=np.inf)[at], pa.float64())})

    def made(left: pa.Table, right: pa.Table, d: np.ndarray, mine: np.ndarray) -> pa.Table:
        one = ends(right.column("id"), d, mine)
        return one if spec.directed else pa.concat_tables([one, ends(left.column("id"), d.T, mine.T)])

    found = near_groups(packed, spec, below, made, f"dst {kind}, n bigint, nearest double", node)
    return found.groupBy("dst").agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"))


def best_sources(nodes: DataFrame, ranks: DataFrame, spec: DistanceSpec, below: float) -> DataFrame:
    """``src, dst, d``: for each target the better-ranked source nearer than ``below`` of least d + rank / n, as each group finds it; a target may have several groups.

    A group sends on one row for each of its targets, however many pairs are near.
    """
    kind, n = dict(nodes.dtypes)["rep"], nodes.count()

    def made(left: pa.Table, right: pa.Table, d: np.ndarray, mine: np.ndarray) -> pa.Table:
        wu, wv = (x.column("rank").to_numpy().astype(np.int64) for x in (left, right))
        cost = np.where(mine & (wu[:, None] < wv[None, :]), d + wu[:, None] / n, np.inf) if mine.size else np.zeros((0, len(wv)))
        # Of equal costs the better rank.
        order = np.argsort(wu, kind="stable")
        best = order[cost[order].argmin(axis=0)] if cost.size else np.zeros(0, int)
        at = np.flatnonzero(np.isfinite(cost[best, np.arange(len(best))])) if cost.size else np.zeros(0, int)
        return pa.table({"src": left.column("id").take(pa.array(best[at])), "dst": right.column("id").take(pa.array(at)), "d": pa.array(d[best[at], at].astype(float))})

    return near_groups(nodes.select("rep", "alleles").join(ranks, "rep"), spec, below, made, f"src {kind}, dst {kind}, d double", "rep", ("rank",))
