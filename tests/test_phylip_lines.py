"""PHYLIP lines straight from the profiles."""

import pytest

from cladewise.model import DistanceSpec
from cladewise.operators import distance
from cladewise.operators.profile import dedup
from cladewise.plans import catalog
from cladewise.sources import sinks
from tests.oracle import same
from tests.test_blocks import SF, plan_of, profiles


@pytest.mark.parametrize("spec", [DistanceSpec(), DistanceSpec(missing="absolute_distance"), DistanceSpec("asymmetric"), DistanceSpec("asymmetric_wgMLST"), DistanceSpec("blockwise"), DistanceSpec(missing="complete_delete")])
@pytest.mark.parametrize("block, size", [(1024, 1 << 25), (16, 3000)])
def test_lines(spark, monkeypatch, spec, block, size):
    """The lines of all pairs of members, whatever the blocks, with names longer than ten letters."""
    monkeypatch.setattr(distance, "BLOCK", block)
    monkeypatch.setattr(sinks, "LINE_BYTES", size)
    rows = profiles(spark, 90, loci=4, distinct=False).selectExpr("concat('sample ', sample * 1001) as sample", "alleles")
    reps = dedup(rows).localCheckpoint()
    each = distance.normalised(distance.pairs(reps.select("rep", "alleles"), spec, "rep"), reps, 4, spec)
    wanted = sorted(map(tuple, sinks.phylip_rows(each).collect()))
    assert sorted(map(tuple, sinks.phylip_lines(reps, 4, spec).collect())) == wanted and len(wanted) == 90


def test_query_shuffles_no_distances(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 40)
    df = catalog.QUERIES["phylip_rows"](spark, SF)
    assert "Aggregate [src" not in plan_of(df) and "MapInArrow" in plan_of(df).splitlines()[0] + plan_of(df).splitlines()[1]
    same(spark, lambda *_: df, catalog.ORACLE_SQL["phylip_rows"], SF)
