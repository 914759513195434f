"""Rectangles by key ranges find what a full scan does, and read a part of the files."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladewise.operators import tree, zorder
from cladewise.plans import catalog
from tests.oracle import same

SIDE = (1 << zorder.BITS) - 1


def interleaved(x, y):
    return sum((((x >> i) & 1) << (2 * i)) | (((y >> i) & 1) << (2 * i + 1)) for i in range(zorder.BITS))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, SIDE), st.integers(0, SIDE), st.integers(0, SIDE), st.integers(0, SIDE), st.integers(4, 64), st.lists(st.tuples(st.integers(0, SIDE), st.integers(0, SIDE)), max_size=20))
def test_ranges_hold_the_rectangle(a, b, c, d, most, points):
    x0, x1, y0, y1 = min(a, b), max(a, b), min(c, d), max(c, d)
    ranges = zorder.key_ranges(x0, y0, x1, y1, most)
    assert 1 <= len(ranges) <= max(most, 4) and all(p <= q for p, q in ranges) and all(q + 1 < p for (_, q), (p, _) in zip(ranges, ranges[1:]))
    for x, y in [*points, (x0, y0), (x1, y1), (x0, y1)]:
        if x0 <= x <= x1 and y0 <= y <= y1:
            assert any(p <= interleaved(x, y) <= q for p, q in ranges)


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    points = np.random.default_rng(3).normal(size=(4000, 2))
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(5000, None, 1.0), (5001, 0.0, 0.0)]
    df, path = spark.createDataFrame(rows, "node_id int, x double, y double"), str(tmp_path_factory.mktemp("layout"))
    zorder.write_layout(df, path, 40)
    return df, path


@pytest.mark.parametrize("box", [(-0.1, 0.0, 0.1, 0.2), (-9, -9, 9, 9), (1.5, 1.5, 9, 9), (5, 5, 6, 6), (0, 0, 0, 1), (-9, 0.5, 9, 0.6), (0, 0, 1e-9, 1e-9), (1, 1, 0, 0)])
def test_rectangles(spark, layout, box):
    df, path = layout
    got = lambda x: sorted(tuple(r) for r in x.collect())
    assert got(zorder.read_rectangle(spark, path, *box)) == got(tree.in_rectangle(df, *box))


def test_files_are_left_out(spark, layout):
    _, path = layout
    found = zorder.read_rectangle(spark, path, 0.9, 0.9, 1.0, 1.0)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(z,", found._jdf.queryExecution().executedPlan().toString())
    files = spark.read.parquet(f"{path}/nodes").groupBy(F.input_file_name().alias("f")).agg(F.min("z").alias("a"), F.max("z").alias("b")).collect()
    box = spark.read.parquet(f"{path}/box").first()
    cell = lambda v, lo, hi: int((v - lo) / (hi - lo) * (1 << zorder.BITS))
    ranges = zorder.key_ranges(*(cell(v, box[f"{c}0"], box[f"{c}1"]) for v, c in ((0.9, "x"), (0.9, "y"), (1.0, "x"), (1.0, "y"))))
    read = [r["f"] for r in files if any(p <= r["b"] and q >= r["a"] for p, q in ranges)]
    assert len(files) == 40 and len(read) < 10


def test_query(spark):
    same(spark, catalog.QUERIES["rectangle_selection"], catalog.ORACLE_SQL["rectangle_selection"], "/root/testdata/sf0.01")
