"""Near pairs where bands part the rows, and where they don't."""

import pytest
from pyspark.sql import functions as F

from cladewise.model import DistanceSpec
from cladewise.operators import near
from cladewise.operators.distance import pairs
from cladewise.plans import catalog
from tests.oracle import same
from tests.test_blocks import SF, plan_of, profiles


@pytest.mark.parametrize("kinds", [2, 60])
@pytest.mark.parametrize("spec", [DistanceSpec("asymmetric"), DistanceSpec(missing="as_allele")])
def test_counts_of_near_pairs(spark, kinds, spec):
    rows = profiles(spark, 150, loci=12, kinds=kinds, seed=9).withColumnRenamed("sample", "rep")
    below = 5 if kinds == 2 else 10
    every = pairs(rows, spec, "rep", below)
    every = every if spec.directed else every.union(every.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d"))
    wanted = every.groupBy("dst").agg(F.count("*"), F.min("d"))
    got = near.near_counts(rows, spec, below)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert wanted.count() > 5
    found = near.near_pairs(rows, spec, below)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs(rows, spec, "rep", below).collect()))


def test_bands_that_part_nothing_are_left(spark):
    """Rows aren't spread over bands of one or two loci, whose groups hold more pairs than there are."""
    df = catalog.QUERIES["near_targets"](spark, SF)
    assert "FlatMapGroups" not in plan_of(df)
    same(spark, lambda *_: df, catalog.ORACLE_SQL["near_targets"], SF)
