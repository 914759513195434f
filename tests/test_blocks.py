"""Work over pairs of blocks: what it gives, and what it doesn't make."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions import kernels
from cladewise.model import DistanceSpec
from cladewise.operators import distance
from cladewise.operators.profile import dedup
from cladewise.plans import catalog
from tests.oracle import same

SF = "/root/testdata/sf0.01"


def profiles(spark, n, loci=6, kinds=3, seed=1, distinct=True):
    """Random packed profiles with missing alleles, none empty."""
    rng, rows = random.Random(seed), {}
    while len(rows) < n:
        alleles = [rng.randint(0, kinds) for _ in range(loci)]
        if any(alleles):
            rows[tuple(alleles) if distinct else len(rows)] = alleles
    ids = rng.sample(range(10 * n), n)
    return spark.createDataFrame(list(zip(ids, rows.values(), strict=True)), "sample long, alleles array<int>")


@pytest.mark.parametrize("spec", [DistanceSpec(), DistanceSpec(missing="absolute_distance"), DistanceSpec("asymmetric")])
def test_member_totals(spark, monkeypatch, spec):
    monkeypatch.setattr(distance, "BLOCK", 16)
    reps = dedup(profiles(spark, 300, loci=3, distinct=False)).cache()
    assert reps.count() < 100
    each = distance.normalised(distance.pairs(reps.select("rep", "alleles"), spec, "rep"), reps, 3, spec)
    wanted = each.groupBy("src").agg(F.round(F.sum("d"), 4), F.max(F.round("d", 6)), F.count("*"))
    got = distance.member_totals(reps, 3, spec).select("src", F.round("total", 4), "farthest", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_normalised_makes_no_pairs_of_members(spark, monkeypatch):
    monkeypatch.setattr(distance, "normalised", lambda *_: pytest.fail("all pairs of members"))
    same(spark, catalog.QUERIES["dist_normalised"], catalog.ORACLE_SQL["dist_normalised"], SF)


def test_rounded_as_spark_does(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 10**7, 400) / 1e7 + 5e-7, (rng.integers(0, 25, 400) + 0.01) * 24 / (rng.integers(0, 25, 400) + 0.01), rng.random(400) * 30, [0.0, 0.0000005, 1.0000005, 2.5e-7, 24.0]])
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", F.round("x", 6).alias("r")).orderBy("i").collect()
    assert kernels.rounded(x).tolist() == [r.r for r in rows]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["dist_symmetric_pair_delete", "dist_symmetric_as_allele", "dist_symmetric_absolute", "dist_symmetric_complete_delete", "dist_asymmetric", "dist_asymmetric_wgmlst", "dist_blockwise", "dist_embeddings"])
def test_no_rows_are_shuffled_for_pairs_of_blocks(spark, monkeypatch, name):
    """Rows aren't spread over all blocks that they meet, nor grouped by pairs of blocks."""
    monkeypatch.setattr(distance, "BLOCK", 32)
    df = catalog.QUERIES[name](spark, SF)
    assert "FlatMapGroups" not in plan_of(df) and "Generate" not in plan_of(df)
    same(spark, lambda *_: df, catalog.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("missing", ["pair_delete", "absolute_distance"])
def test_each_pair_once(spark, monkeypatch, missing):
    """However many blocks, an even or an odd number, each pair comes once and as if it were the only one."""
    rows = profiles(spark, 60, loci=8)
    for directed in (False, True):
        spec = DistanceSpec("asymmetric" if directed else "symmetric", missing)
        found = []
        for block in (100, 30, 20, 7):
            monkeypatch.setattr(distance, "BLOCK", block)
            found.append(sorted(map(tuple, distance.pairs(rows, spec).collect())))
        assert len(found[0]) == 60 * 59 // (1 if directed else 2) and all(x == found[0] for x in found)
