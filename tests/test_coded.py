"""Trees on the driver of matrices as codes: the same trees, in little memory."""

import tracemalloc

import numpy as np
import pytest

from cladewise.functions import kernels
from cladewise.functions.coded import Coded
from cladewise.model import DistanceSpec, TreeSpec
from cladewise.operators import mst
from cladewise.plans import catalog


def matrix(n, spec, seed=0, loci=24):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 6, (2 * n, loci)), axis=0)
    a = a[(a > 0).any(axis=1)][rng.permutation(len(a) - 1)[:n]]
    d = kernels.distances(a, a, spec)
    np.fill_diagonal(d, 0)
    values, codes = np.unique(d, return_inverse=True)
    return d, Coded(codes.reshape(d.shape).astype(np.uint16), values), rng.permutation(len(a))


@pytest.mark.parametrize("n, loci", [(3, 4), (30, 3), (200, 24)])
def test_same_trees(n, loci):
    for seed in range(3):
        d, coded, rank = matrix(n, DistanceSpec("asymmetric"), seed, loci)
        tree = kernels.directed_tree(coded, rank)
        assert tree == kernels.directed_tree(d, rank)
        assert kernels.recraft(tree, coded, rank, loci) == kernels.recraft(tree, d, rank, loci)
        d, coded, _ = matrix(n, DistanceSpec(), seed, loci)
        for weighted in (False, True):
            assert kernels.neighbour_joining(coded, weighted) == kernels.neighbour_joining(d, weighted)


def test_directed_tree_keeps_no_matrix_of_numbers():
    _, coded, rank = matrix(1000, DistanceSpec("asymmetric"))
    tracemalloc.start()
    tree = kernels.directed_tree(coded, rank)
    kernels.recraft(tree, coded, rank, 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(tree) == 999 and peak < 8 * 1000 * 1000


def test_the_matrix_on_the_driver_is_codes(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, [int(x) for x in rng.integers(0, 4, 12)]) for i in range(150)], "sample long, alleles array<int>")
    for spec in (DistanceSpec("asymmetric"), DistanceSpec()):
        nodes, _, ranks = mst._ranked(rows, TreeSpec("MSTree", spec))
        names, d, _ = mst.dense(nodes, spec, ranks)
        assert d.codes.itemsize == 1
        alleles = np.array([r["alleles"] for r in nodes.orderBy("idx").collect()])
        whole = kernels.distances(alleles, alleles, spec)
        np.fill_diagonal(whole, 0)
        assert (d.part(slice(None)) == whole).all() and len(names) == len(whole)


def test_checks_of_the_directed_tree(spark):
    row = catalog.QUERIES["mstree_v2_checks"](spark, "/root/testdata/sf0.01").first()
    edges = catalog.QUERIES["mstree_v2_edges"](spark, "/root/testdata/sf0.01")
    assert (row.n_edges, row.n_nodes, row.n_roots, row.n_wrong_lengths) == (149, 150, 1, 0) and edges.count() == 149


@pytest.mark.parametrize("weighted", [False, True])
def test_neighbour_joining_looks_at_few_rows(monkeypatch, weighted):
    looked, whole = [], kernels._best_of
    monkeypatch.setattr(kernels, "_best_of", lambda rows, some, *rest: looked.append(len(some)) or whole(rows, some, *rest))
    _, coded, _ = matrix(1200, DistanceSpec())
    assert len(kernels.neighbour_joining(coded, weighted)) == 2 * 1200 - 3
    assert sum(looked) < 80 * 1200


def test_neighbour_joining_takes_no_ranks(spark, monkeypatch):
    monkeypatch.setattr(mst, "node_ranks", lambda *_: pytest.fail("ranks"))
    assert catalog.QUERIES["nj_tree"](spark, "/root/testdata/sf0.001").first().newick.count(":") > 10
