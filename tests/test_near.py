"""Near pairs by bands against all pairs, whatever is missing and however large a group is."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladewise.functions import kernels
from cladewise.model import DistanceSpec
from cladewise.operators import mst, near
from cladewise.plans import catalog
from tests.oracle import same


def clones(rng, n, loci, missing, changes=4):
    """Rows that differ from one of a few founders at some loci, some of them missing."""
    founders = rng.integers(1, 9, (4, loci))
    rows = founders[rng.choice(4, n, p=[0.7, 0.1, 0.1, 0.1])]
    for row in rows:
        at = rng.choice(loci, rng.integers(0, changes), replace=False)
        row[at] = rng.integers(1, 99, len(at))
    rows[rng.random(rows.shape) < missing] = 0
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows.tolist())], "rep long, alleles array<int>")


@pytest.mark.parametrize(("missing", "block", "spec"), [(0.0, 512, DistanceSpec("asymmetric")), (0.05, 16, DistanceSpec("asymmetric")), (0.4, 32, DistanceSpec("asymmetric", "absolute_distance")), (0.1, 16, DistanceSpec(missing="as_allele"))])
def test_against_all_pairs(spark, monkeypatch, missing, block, spec):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = clones(np.random.default_rng(3), 150, 20, missing)
    rows[7] = 0
    rows[7, 3] = 2
    d = kernels.distances(rows, rows, spec)
    want = {(i, j): d[i, j] for i in range(len(rows)) for j in range(len(rows)) if d[i, j] < 3 and (i != j if spec.directed else i < j)}
    found = near.near_pairs(table(spark, rows), spec, 3).collect()
    assert len(found) == len({(r["src"], r["dst"]) for r in found})
    assert {(r["src"], r["dst"]): r["d"] for r in found} == pytest.approx(want)


@pytest.mark.parametrize("missing", [0.0, 0.08])
def test_best_sources(spark, monkeypatch, missing):
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = clones(rng, 120, 20, missing)
    rank = rng.permutation(len(rows))
    ranks = spark.createDataFrame([(i, int(r)) for i, r in enumerate(rank)], "rep long, rank int")
    spec = DistanceSpec("asymmetric")
    want = sorted(kernels.shortcuts(kernels.distances(rows, rows, spec), rank))
    found = mst.shortcuts(near.best_sources(table(spark, rows), ranks, spec, kernels.cutoff(len(rows)) + 1), ranks, len(rows))
    assert sorted((r["src"], r["dst"], r["length"]) for r in found.collect()) == want


def test_few_rows(spark):
    spec = DistanceSpec("asymmetric")
    for rows in (np.zeros((0, 5), int), np.ones((1, 5), int)):
        assert near.near_pairs(table(spark, rows), spec, 3).count() == 0
    two = near.near_pairs(table(spark, np.array([[1, 2], [3, 4]])), spec, 3).collect()
    assert sorted((r["src"], r["dst"], r["d"]) for r in two) == [(0, 1, 2.0), (1, 0, 2.0)]
    with pytest.raises(ValueError, match="no bands"):
        near.near_pairs(table(spark, np.ones((2, 5), int)), DistanceSpec(), 3)


def test_work_follows_groups(spark, monkeypatch):
    """Of 6,000 rows that have few near ones, far fewer groups than the pairs of blocks, and far fewer distances than pairs."""
    monkeypatch.setattr(near, "BLOCK", 64)
    rng = np.random.default_rng(1)
    rows = rng.integers(1, 500, (6000, 12))
    rows[1::2, :8] = rows[::2, :8]
    schema = "pairs long"
    made = lambda left, right, d, mine: pa.table({"pairs": pa.array([d.size] if d.size else [], pa.int64())})
    work = near.near_groups(table(spark, rows), DistanceSpec("asymmetric"), 5, made, schema).agg(F.count("*"), F.sum("pairs")).first()
    assert work[1] < 6000 * 6000 / 50
    assert near.near_pairs(table(spark, rows), DistanceSpec("asymmetric"), 5).count() >= 6000


@pytest.mark.parametrize("name", ["near_pairs", "near_targets", "shortcuts"])
def test_queries(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], "/root/testdata/sf0.01")
