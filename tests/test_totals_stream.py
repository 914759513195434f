"""Totals of a stream of changes equal those of the rows that are left, after every batch."""

import random

from cladewise.operators import grid
from cladewise.streaming.totals import totals_stream


def test_totals_follow_changes(spark, tmp_path):
    rng = random.Random(6)
    row = "struct<a:string,b:string,v:string>"
    schema, source, folder = f"id int, before {row}, after {row}", str(tmp_path / "in"), str(tmp_path / "out")
    now: dict[int, tuple] = {}
    make = lambda: (rng.choice("xyz"), rng.choice(["p", "q", None]), rng.choice(["1", "2", "2.5", "-4", "none", None]))
    for number in range(4):
        changes = []
        for i in range(40):
            old, new = now.get(i), make() if rng.random() < (0.9 if number == 0 else 0.5) and number < 3 else None
            if rng.random() < 0.6 or number == 3:
                changes.append((i, old, new))
                if new is None:
                    now.pop(i, None)
                else:
                    now[i] = new
            if number == 3 and i > 20:  # a last batch deletes some groups whole
                break
        spark.createDataFrame(changes, schema).coalesce(1).write.mode("append").parquet(source)
        totals_stream(spark.readStream.schema(schema).parquet(source), ["a", "b"], "v", folder).awaitTermination()
        left = spark.createDataFrame(list(now.values()) or [("x", "p", "1")], "a string, b string, v string").filter(str(bool(now)))
        numbers = left.withColumn("v", grid.number("v"))
        want = grid.group_levels(numbers, ["a", "b"], {"v": ("sum", "min", "max", "n")})
        key = lambda rows, *columns: sorted(tuple(r[c] for c in columns) for r in rows)
        got = spark.read.parquet(f"{folder}/v{number}").collect()
        assert key(got, "level", "group_key", "n", "valued") == key(want.collect(), "level", "group_key", "n", "n_v"), number
        parts = {(r["level"], r["group_key"]): (r["sum_value"], r["min_value"], r["max_value"]) for r in got}
        assert parts == {(r["level"], r["group_key"]): (r["sum_v"], r["min_v"], r["max_v"]) for r in want.collect()}
