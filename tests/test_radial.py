"""The radial layout against plain recursion: fans, the fitted arc, and places."""

import math
import random

import pytest

from cladewise.operators import radial, tree
from cladewise.plans import catalog, catalog_more  # noqa: F401  (the second adds to the first)
from tests.oracle import same


def hashed(text):
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


class Plain:
    """The layout of a dict node → (parent, link), by recursion."""

    def __init__(self, nodes, scale=500.0):
        self.nodes, self.kids = nodes, {v: [] for v in nodes}
        for v, (p, _) in nodes.items():
            if p is not None:
                self.kids[p].append(v)
        self.kids = {v: sorted(some, key=hashed if len(some) > 2 else None) for v, some in self.kids.items()}
        self.size = {v: 0.01 if self.kids[v] else 1.0 for v in nodes}
        self.r0 = max(x for p, x in nodes.values() if p is not None) / scale * 2
        self.guess = self.r0 * math.pi / sum(self.size.values())

    def fans(self, v, arc, out):
        """(reach, width) of a node's fan; ``out`` takes each node's (angle of children, width) and each child's (far, turn)."""
        reach = angle = 0.0
        for c in self.kids[v]:
            whole, width = self.fans(c, arc, out)
            half, off = min(width, math.pi), self.r0 * math.sqrt(self.size[v]) + self.nodes[c][1]
            if math.cos(math.pi - half) > whole / off:
                far, turn = off, math.asin(whole / off)
            else:
                x, y = whole * math.cos(half) + off, whole * math.sin(half)
                far, turn = max(math.hypot(x, y), off, whole), math.atan2(y, x)
            out[c, "seen"] = far, turn
            reach, angle = max(reach, far), angle + turn + arc / far
        own = self.r0 * math.sqrt(self.size[v])
        whole = max(own, reach)
        width = max(angle, own * math.asin(min(1, arc * math.sqrt(self.size[v]) / self.r0)) / whole)
        out[v, "fan"] = angle, width
        return whole, width

    def widest(self, arc):
        out = {}
        self.fans(next(v for v, (p, _) in self.nodes.items() if p is None), arc, out)
        return max(w for (_, kind), (_, w) in out.items() if kind == "fan"), out

    def places(self, arc):
        _, out = self.widest(arc)
        root = next(v for v, (p, _) in self.nodes.items() if p is None)
        at, stack = {root: (0.0, 0.0)}, [(root, 0.0)]
        while stack:
            v, turned = stack.pop()
            angle = out[v, "fan"][0]
            now, gap = (0.0, max(0.0, (math.pi - angle) / len(self.kids[v]))) if v == root and self.kids[v] else (-angle, 0.0)
            for c in self.kids[v]:
                far, turn = out[c, "seen"]
                here, off = turned + now + turn + arc / far, self.nodes[c][1] + self.r0 * math.sqrt(self.size[v])
                now += 2 * (turn + arc / far + gap)
                at[c] = at[v][0] + off * math.cos(here), at[v][1] + off * math.sin(here)
                stack.append((c, here))
        return at


@pytest.mark.parametrize(("seed", "n", "wide"), [(1, 40, 40), (2, 30, 6), (3, 3, 3)])
def test_against_recursion(spark, seed, n, wide):
    rng = random.Random(seed)
    nodes = {f"v{i}": (None, 0.0) if i == 0 else (f"v{rng.randrange(max(0, i - wide), i)}", float(rng.randrange(0, 9))) for i in range(n)}
    nodes["v1"] = ("v0", 3.0)
    plain = Plain(nodes)
    frame = spark.createDataFrame([(v, p, x) for v, (p, x) in nodes.items()], "node_id string, parent_id string, length double")
    measured = radial._measured(frame)
    arc, fans = radial.fit(measured, measured.agg({"depth": "max"}).first()[0], plain.r0, plain.guess, 0.5)
    widest, out = plain.widest(arc)
    assert widest <= math.pi + 1e-9
    # A slightly longer arc fits no more, unless all that were tried fit.
    longest = plain.guess * radial.SPREAD ** (radial.ARCS // 2)
    step = radial.SPREAD ** (1 / radial.ARCS ** (radial.FOLDS - 1))
    assert arc == pytest.approx(longest) or plain.widest(arc * step * 1.0001)[0] > math.pi
    assert {r["node_id"]: (r["angle"], r["width"]) for r in fans.collect()} == {v: pytest.approx(out[v, "fan"]) for v in nodes}
    want = plain.places(arc)
    got = {r["node_id"]: (r["x"], r["y"]) for r in tree.radial_layout(frame).collect()}
    assert got == {v: pytest.approx(want[v], abs=1e-6) for v in nodes}
    # Every link is drawn at its length, and a little more.
    for v, (p, x) in nodes.items():
        if p:
            assert math.dist(got[v], got[p]) == pytest.approx(x + plain.r0 * math.sqrt(plain.size[p]), abs=1e-6)


def test_small_trees(spark):
    schema = "node_id string, parent_id string, length double"
    assert tree.radial_layout(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in tree.radial_layout(spark.createDataFrame([("r", None, None)], schema)).collect()] == [("r", 0.0, 0.0)]
    flat = tree.radial_layout(spark.createDataFrame([("r", None, None), ("a", "r", 0.0), ("b", "r", -1.0)], schema)).collect()
    assert all(math.isfinite(r["x"]) and math.isfinite(r["y"]) for r in flat)


def test_query(spark):
    same(spark, catalog.QUERIES["radial_layout"], catalog.ORACLE_SQL["radial_layout"], "/root/testdata/sf0.01")
