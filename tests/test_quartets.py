"""Counts of shared quartets against their enumeration."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladewise.functions import quartets
from cladewise.operators import evaluate
from cladewise.plans import catalog, catalog_more  # noqa: F401  (the second adds to the first)
from tests.oracle import same


def random_tree(rng, leaves, bushy):
    """(node, parent, name) of a tree that parts the leaves at random."""
    rows, stack = [("root", None, None)], [("root", list(leaves))]
    while stack:
        v, some = stack.pop()
        if len(some) == 1:
            rows.append((f"leaf {some[0]}", v, some[0]))
            continue
        parts = [[] for _ in range(rng.randint(2, bushy))]
        for x in some:
            rng.choice(parts).append(x)
        for part in parts:
            if len(part) == len(some) or len(part) == 1:
                rows += [(f"leaf {x}", v, x) for x in part]
            elif part:
                inner = f"n{len(rows)}-{rng.random()}"
                rows.append((inner, v, None))
                stack.append((inner, part))
    return rows


def listed(rows):
    """Quartet → pairing, by all clades."""
    up, name = {v: p for v, p, _ in rows}, {v: x for v, _, x in rows}
    clades = {v: set() for v in up}
    for v, x in name.items():
        if x is not None:
            while v is not None:
                clades[v].add(x)
                v = up[v]
    leaves = sorted(x for x in name.values() if x is not None)
    out = {}
    for i, a in enumerate(leaves):
        for j, b in enumerate(leaves[i + 1 :], i + 1):
            for k, c in enumerate(leaves[j + 1 :], j + 1):
                for d in leaves[k + 1 :]:
                    for some in clades.values():
                        inside = frozenset({a, b, c, d} & some)
                        if len(inside) == 2:
                            out[a, b, c, d] = frozenset([inside, frozenset({a, b, c, d}) - inside])
    return out


def enumerated(one, two):
    truth, found = listed(one), listed(two)
    tp = sum(found.get(q) == p for q, p in truth.items())
    return tp, sum(q in found and found[q] != p for q, p in truth.items()), len(truth) - tp


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 13), st.integers(2, 6), st.sampled_from([0, 3, 64]))
def test_counts(seed, n, bushy, narrow):
    rng = random.Random(seed)
    one, two = (random_tree(rng, range(n), bushy) for _ in range(2))
    a, b = quartets.shape(one), quartets.shape(two)
    at = {x: i for i, x in enumerate(b.leaves)}
    before, quartets.NARROW = quartets.NARROW, narrow
    try:
        alike, otherwise = quartets.compare_nodes(a, list(range(len(a.nodes))), quartets.Counter(b), np.array([at[x] for x in a.leaves], int))
    finally:
        quartets.NARROW = before
    assert (alike // 2, otherwise // 4, quartets.resolved(a) - alike // 2) == enumerated(one, two)
    assert alike % 2 == otherwise % 4 == 0


def test_25_leaves_and_different_sets(spark):
    rng = random.Random(7)
    for left, right in ((range(25), range(25)), (range(14), range(4, 18))):
        one, two = random_tree(rng, [f"s{i}" for i in left], 4), random_tree(rng, [f"s{i}" for i in right], 3)
        frames = [spark.createDataFrame(x, "node_id string, parent_id string, name string") for x in (one, two)]
        assert tuple(evaluate.quartet_counts(*frames).first()) == enumerated(one, two)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_too_few_leaves(spark, n):
    rows = [("root", None, None)] + [(f"l{i}", "root", f"l{i}") for i in range(n)]
    frame = spark.createDataFrame(rows, "node_id string, parent_id string, name string")
    assert tuple(evaluate.quartet_counts(frame, frame).first()) == (0, 0, 0)


def test_query(spark):
    same(spark, catalog.QUERIES["quartet_counts"], catalog.ORACLE_SQL["quartet_counts"], "/root/testdata/sf0.01")
