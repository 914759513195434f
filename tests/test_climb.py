"""Climbs along pointers against plain walks, on random trees and on a chain of 100,000 nodes."""

import random
import time
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cladewise.operators import climb, tree
from cladewise.plans import catalog, catalog_more, storage  # noqa: F401  (the second adds to the first)
from tests.oracle import same

CHAIN = 100_000


def random_tree(rng, n, wide):
    """node → parent; ``wide`` children of one node are likelier the smaller it is."""
    return {i: None if i == 0 else rng.randrange(max(0, i - wide), i) for i in range(n)}


def above(parent, v):
    out = []
    while v is not None:
        out.append(v)
        v = parent[v]
    return out


def frame(spark, parent, hypo=()):
    rows = [(f"v{i}", None if p is None else f"v{p}", float(i % 5), i in hypo) for i, p in parent.items()]
    return spark.createDataFrame(rows, "node_id string, parent_id string, length double, is_hypo boolean")


def ids(spark, chosen):
    return spark.createDataFrame([(f"v{i}",) for i in chosen], "node_id string")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), n=st.integers(1, 60), wide=st.sampled_from([1, 3, 60]))
def test_random_trees(spark, seed, n, wide):
    rng = random.Random(seed)
    parent = random_tree(rng, n, wide)
    nodes, chosen = frame(spark, parent), rng.sample(range(n), min(n, 4))
    name = lambda pairs: sorted((f"v{a}", f"v{b}") for a, b in pairs)
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(climb.depths(nodes)) == sorted((f"v{i}", len(above(parent, i)) - 1) for i in parent)
    assert got(climb.at_or_above(nodes, ids(spark, chosen))) == sorted({(f"v{a}",) for c in chosen for a in above(parent, c)})
    assert got(climb.pairs_below(nodes, ids(spark, chosen))) == name((c, i) for c in chosen for i in parent if c in above(parent, i))
    assert got(climb.nearest(nodes, ids(spark, chosen))) == name((i, next(a for a in above(parent, i) if a in chosen)) for i in parent if set(above(parent, i)) & set(chosen))
    assert got(tree.tagged(nodes, ids(spark, chosen)).filter("tagged").select("node_id")) == sorted((f"v{i}",) for i in parent if set(above(parent, i)[1:]) & set(chosen))
    assert got(tree.tracked(nodes, ids(spark, chosen))) == name({(parent[a], a) for c in chosen for a in above(parent, c) if parent[a] is not None})


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), n=st.integers(2, 50), wide=st.sampled_from([1, 3, 50]))
def test_rooting(spark, seed, n, wide):
    rng = random.Random(seed)
    parent = random_tree(rng, n, wide)
    edges = [(i, p, 0.5 + i) if rng.random() < 0.5 else (p, i, 0.5 + i) for i, p in parent.items() if p is not None]
    root, near = rng.randrange(n), {}
    for u, v, x in edges:
        near.setdefault(u, []).append((v, x))
        near.setdefault(v, []).append((u, x))
    want, stack = [], [(root, None, 0.0, 0)]
    while stack:
        row = stack.pop()
        want.append(row)
        stack += [(v, row[0], x, row[3] + 1) for v, x in near[row[0]] if v != row[1]]
    # Another tree beside it is left out.
    apart = [(1000, 1001, 1.0), (1001, 1002, 1.0), (1001, 1003, 1.0)]
    found = climb.rooted(spark.createDataFrame(edges + apart, "u long, v long, length double"), root)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_root_alone(spark):
    none = spark.createDataFrame([], "u long, v long, length double")
    assert [tuple(r) for r in climb.rooted(none, 3).collect()] == [(3, None, 0.0, 0)]


def jobs(spark, work):
    """The jobs that some work takes, and its seconds."""
    group, began = uuid.uuid4().hex, time.time()
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), time.time() - began


def test_deep_chain(spark):
    """A chain of 100,000 nodes: rounds by the logarithm, counted as the tables that are written."""

    nodes = spark.range(CHAIN).selectExpr("concat('v', id) node_id", "if(id = 0, null, concat('v', id - 1)) parent_id", "1.0D length", f"id % 50000 <> 0 and id <> {CHAIN - 1} is_hypo")
    nodes = storage.written(nodes).df
    for work, want in (
        (lambda: climb.depths(nodes).agg({"depth": "max"}).first()[0], CHAIN - 1),
        (lambda: tree.descendants(nodes, ids(spark, [0, 99_000, 99_990])).count(), CHAIN + 1000 + 10),
        (lambda: sorted((r["node_id"], r["parent_id"], r["length"]) for r in tree.induced(nodes, nodes.filter("not is_hypo")).collect()), [("v0", None, None), ("v50000", "v0", 50000.0), (f"v{CHAIN - 1}", "v50000", 49999.0)]),
    ):
        with storage.made() as tables:
            found, n, seconds = jobs(spark, work)
        assert found == want
        assert len(tables) < 40, (len(tables), n, seconds)


@pytest.mark.parametrize("name", ["rooted_nodes", "rooted_tree", "descendants", "subtree_keep", "collapse_groups", "tagged_nodes", "tracked_links", "highlighted_groups", "all_ids"])
def test_queries(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], "/root/testdata/sf0.01")
