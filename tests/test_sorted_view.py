"""A view in runs equals a whole sort after any edits, and leaves untouched runs alone."""

import random

from cladewise.operators.sorted_view import sorted_view
from cladewise.plans import catalog, catalog_more  # noqa: F401  (the second adds to the first)
from tests.oracle import same

SCHEMA = "id int, name string, x double"


def table(spark, rows):
    return spark.createDataFrame([(i, *v) for i, v in rows.items()], SCHEMA)


def in_order(rows):
    return sorted(rows.items(), key=lambda r: (r[1][0] is not None, r[1][0] or "", r[0]))


def check(view, rows):
    want = [(i, name, x, place) for place, (i, (name, x)) in enumerate(in_order(rows), 1)]
    assert sorted((tuple(r) for r in view.rows().collect()), key=lambda r: r[3]) == want
    assert sum(run.rows for run in view.runs) == len(rows)
    for number, size in ((0, 7), (3, 11), (100, 5)):
        assert [tuple(r) for r in view.page(number, size).collect()] == want[number * size : (number + 1) * size]


def test_edits(spark):
    rng = random.Random(2)
    value = lambda: (None if rng.random() < 0.1 else rng.choice("abcdefgh") * rng.randint(1, 3), float(rng.randint(0, 9)))
    rows = {i: value() for i in range(90)}
    view = sorted_view(table(spark, rows), ["name"], "id", run_rows=20)
    assert 4 <= len(view.runs) <= 6
    check(view, rows)
    for _ in range(3):
        changed = {i: value() for i in rng.sample(range(120), 8)}
        gone = rng.sample(sorted(rows), 5)
        rows = {i: v for i, v in (rows | changed).items() if i not in gone}
        view = view.edited(table(spark, changed), spark.createDataFrame([(i,) for i in gone], "id int"))
        check(view, rows)
    # Many rows at one place make new runs.
    more = {i: ("c", 0.0) for i in range(200, 280)}
    rows |= more
    view = view.edited(table(spark, more))
    check(view, rows)
    assert max(run.rows for run in view.runs) <= 60


def test_untouched_runs_stay(spark):
    rows = {i: (f"n{i:03d}", 0.0) for i in range(100)}
    view = sorted_view(table(spark, rows), ["name"], "id", run_rows=10)
    after = view.edited(table(spark, {5: ("n005", 1.0)}))
    assert len(set(view.runs) & set(after.runs)) >= len(view.runs) - 1
    check(after, rows | {5: ("n005", 1.0)})


def test_from_nothing_and_to_nothing(spark):
    view = sorted_view(table(spark, {1: ("a", 0.0)}).limit(0), ["name"], "id")
    assert view.runs == () and view.rows().count() == 0 and view.page(0, 5).count() == 0
    view = view.edited(table(spark, {2: ("b", 0.0), 1: (None, 1.0)}))
    check(view, {2: ("b", 0.0), 1: (None, 1.0)})
    view = view.edited(deleted=spark.createDataFrame([(1,), (2,)], "id int"))
    assert view.runs == () and view.rows().count() == 0


def test_query(spark):
    same(spark, catalog.QUERIES["sorted_view"], catalog.ORACLE_SQL["sorted_view"], "/root/testdata/sf0.01")
