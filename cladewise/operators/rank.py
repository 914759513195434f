"""Tie-break ranks of nodes, and the cost of an edge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.model import DistanceSpec
from cladewise.operators.distance import by_blocks
from cladewise.operators.numbering import numbered
from cladewise.plans.storage import written


def harmonic(full: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rep, rank``: by n / sum of 1 / (d + 0.1) (a node's own distance 0 included), then larger groups, then idx.

    ``full`` has both directions. Weights are compared to 9 digits, so that the order of a sum can't swap ties.
    """
    return _by_sums(full.groupBy(F.col("src").alias("rep")).agg(F.sum(1 / (F.col("d") + 0.1)).alias("s")), nodes)


def _by_sums(sums: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.count()
    weight = F.round(n / (F.coalesce("s", F.lit(0.0)) + 10), 9)
    return _placed(nodes.join(sums, "rep", "left").select("rep", weight.alias("w"), "size", "idx"), ["w", F.desc("size"), "idx"])


def _placed(rows: DataFrame, order: list) -> DataFrame:
    """``rep, rank`` from 0 in an order."""
    return numbered(rows, order, "place").select("rep", (F.col("place") - 1).cast("int").alias("rank"))


def eburst(full: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rep, rank``: by the most nodes at distance 1, then 2, and so on, at last by those at 0 with the group's size; then idx."""
    return _by_bins(full.groupBy(F.col("src").alias("rep"), F.floor("d").cast("int").alias("bin")).agg(F.count("*").alias("n")), nodes)


def _by_bins(bins: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lists of (distance, -count), nearest first, compare as the counts at every distance would: of two lists the one that goes on has more where the other has none, so each ends behind all distances."""
    last = 2**31 - 1
    far = F.array_sort(F.collect_list(F.when(F.col("bin") >= 1, F.struct("bin", (-F.col("n")).alias("n")))))
    lists = bins.groupBy("rep").agg(far.alias("far"), F.sum(F.when(F.col("bin") == 0, F.col("n")).otherwise(0)).alias("same"))
    end = F.array(F.struct(F.lit(last).alias("bin"), (-(F.coalesce("same", F.lit(0)) + 1 + F.col("size"))).alias("n")))
    none = F.array().cast("array<struct<bin:int,n:bigint>>")
    return _placed(nodes.join(lists, "rep", "left").select("rep", F.concat(F.coalesce("far", none), end).alias("key"), "idx"), ["key", "idx"])


def _ends(left: pa.Table, right: pa.Table, d: np.ndarray, same: bool, directed: bool) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The sources of a pair of blocks with their rows of distances; undirected ones count from both sides."""
    yield left.column("id").combine_chunks(), d
    if not directed and not same:
        yield right.column("id").combine_chunks(), d.T


def ranks(nodes: DataFrame, spec: DistanceSpec, heuristic: str) -> DataFrame:
    """``rep, rank`` straight from the profiles: each pair of blocks gives sums or counts by row, never the distances."""
    kind = dict(nodes.dtypes)["rep"]

    def sums(left: pa.Table, right: pa.Table, near: np.ndarray, same: bool) -> pa.Table:
        if same:
            np.fill_diagonal(near, 0)
        found = list(_ends(left, right, near, same, spec.directed))
        return pa.table({"rep": pa.chunked_array([x for x, _ in found]), "s": pa.chunked_array([pa.array(x.sum(axis=1), pa.float64()) for _, x in found])})

    def counts(left: pa.Table, right: pa.Table, whole: np.ndarray, same: bool) -> pa.Table:
        if same:
            np.fill_diagonal(whole, -1)
        wide, out = int(whole.max(initial=0)) + 2, []
        place = lambda x: np.arange(1, len(x) * wide + 1, wide, dtype=np.int64 if len(x) * wide >= 2**31 else np.int32)
        # By row, and undirected ones by column too.
        turns = [(left.column("id").combine_chunks(), place(left)[:, None])] + ([] if spec.directed or same else [(right.column("id").combine_chunks(), place(right)[None, :])])
        for ids, at in turns:
            n = np.bincount((at + whole).ravel(), minlength=len(ids) * wide)
            cells = np.flatnonzero(n)
            cells = cells[cells % wide > 0]
            out.append(pa.table({"rep": ids.take(pa.array(cells // wide)), "bin": pa.array(cells % wide - 1, pa.int32()), "n": pa.array(n[cells], pa.int64())}))
        return pa.concat_tables(out)

    rows = nodes.select("rep", "alleles")
    if heuristic == "harmonic":
        found = by_blocks(rows, spec, sums, f"rep {kind}, s double", "rep", each=lambda d: 1 / (d + 0.1))
        return _by_sums(found.groupBy("rep").agg(F.sum("s").alias("s")), nodes)
    bins = written(by_blocks(rows, spec, counts, f"rep {kind}, bin int, n bigint", "rep", each=lambda d: np.floor(d).astype(np.int32)).groupBy("rep", "bin").agg(F.sum("n").alias("n")), "bins")
    return _by_bins(bins.df, nodes)


def cost(d: Column, rank: Column) -> Column:
    """An edge's cost: the distance rounded half to even, then the source's rank (as a pair of whole numbers, so that no digits are lost)."""
    return F.struct(F.rint(d).cast("long").alias("r"), rank.alias("w"))
