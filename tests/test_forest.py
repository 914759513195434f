"""Spanning trees: forests over arrays, edges within reach, and rounds of tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions import kernels
from cladewise.model import DistanceSpec
from cladewise.operators import distance, mst, rank
from tests.test_blocks import profiles


def kruskal(edges, n):
    """Of edges in order those that close no cycle."""
    part, out = list(range(n)), []
    for k, (u, v) in enumerate(edges):
        if part[u] != part[v]:
            a, b = part[u], part[v]
            part = [a if x == b else x for x in part]
            out.append(k)
    return out


@pytest.mark.parametrize("n, m", [(1, 0), (2, 3), (9, 12), (40, 60), (40, 700)])
def test_least_forest(n, m):
    for seed in range(20):
        rng = np.random.default_rng(seed)
        u, v = rng.integers(0, n, (2, m))
        assert mst.least_forest(u, v, n).tolist() == kruskal(zip(u.tolist(), v.tolist(), strict=True), n)


@pytest.mark.parametrize("spec, scale", [(DistanceSpec(), 1), (DistanceSpec("blockwise"), 10000), (DistanceSpec(missing="as_allele"), 1), (DistanceSpec(missing="complete_delete"), 1)])
def test_edges_within_reach_make_the_whole_tree(spark, monkeypatch, spec, scale):
    """With a small hub, blocks and several rounds of tasks: the tree is that of all edges."""
    monkeypatch.setattr(distance, "BLOCK", 17)
    monkeypatch.setattr(mst, "HUB", 12)
    nodes = mst.ready(profiles(spark, 120, loci=9, kinds=4, seed=5))
    ranks = rank.ranks(nodes, spec, "eBurst").localCheckpoint()
    rows = nodes.join(ranks, "rep").orderBy("idx").collect()
    a, w, names = np.array([r["alleles"] for r in rows]), [r["rank"] for r in rows], [r["rep"] for r in rows]
    loci = np.flatnonzero((a > 0).all(axis=0))
    r = np.rint(kernels.distances(a, a, spec, loci) * scale).astype(int)
    edges = sorted((r[i, j], min(w[i], w[j]), i, j) for i in range(len(a)) for j in range(i + 1, len(a)))
    wanted = [edges[k] for k in kruskal([e[2:] for e in edges], len(a))]
    forests = mst.block_forests(nodes, ranks, spec, scale)
    for most in (mst.MAX_KRUSKAL, 200):
        monkeypatch.setattr(mst, "MAX_KRUSKAL", most)
        got = mst.spanning_tree(forests).select("u", "v", "key.*").collect()
        assert sorted((x.r, x.w, x.i, x.j) for x in got) == sorted(wanted)
        assert all({x.u, x.v} == {names[x.i], names[x.j]} for x in got)


def test_few_edges_are_put_in_order(spark, monkeypatch):
    """Most pairs lie beyond their ends' reach."""
    rng = np.random.default_rng(1)
    near = rng.integers(1, 6, (40, 1, 24))
    a = np.where(rng.random((40, 30, 24)) < 0.15, rng.integers(1, 6, (40, 30, 24)), near).reshape(-1, 24)
    a = np.unique(np.where(rng.random(a.shape) < 0.3, 1, a), axis=0)
    nodes = mst.ready(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "sample long, alleles array<int>"))
    reach = mst._reach(nodes, DistanceSpec(), 1)(a)
    r = np.rint(kernels.distances(a, a, DistanceSpec()))
    assert (r <= np.maximum(reach[:, None], reach[None, :])).mean() < 0.5
    assert nodes.filter(F.size("alleles") != 24).count() == 0
