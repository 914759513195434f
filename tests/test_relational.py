"""Metadata, grid, sinks and streams beyond the registered queries."""

import json

import pytest

from cladewise.model import DistanceSpec, TreeSpec
from cladewise.operators import evaluate, grid, metadata, profile, rank
from cladewise.operators.components import components
from cladewise.plans.storage import shared_dir, sweep, written
from cladewise.sources import sinks, trees
from cladewise.streaming.upsert import upsert_stream


def test_specs():
    assert TreeSpec().resolved() == TreeSpec("MSTree", DistanceSpec("asymmetric"), "harmonic", True)
    assert TreeSpec(distance=DistanceSpec("blockwise")).resolved().method == "MSTree" and not TreeSpec("MSTree", DistanceSpec("blockwise"), recraft=True).resolved().recraft
    for bad in (lambda: DistanceSpec("x"), lambda: DistanceSpec(missing="x"), lambda: TreeSpec("x"), lambda: TreeSpec(heuristic="x")):
        with pytest.raises(ValueError):
            bad()


def test_components_of_chains_hubs_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(20, 60)] + [(3, 3), (None, 4), (5, None), (9, 8), (8, 9)]
    df = spark.createDataFrame(edges, "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in (3, 4, 5, 7, 8, 9, 20, 59, 100, 140, 200)], "n int")
    got = {r["n"]: r["component"] for r in components(nodes, df, "n").collect()}
    assert got == {3: 3, 4: 4, 5: 5, 7: 7, 8: 8, 9: 8, 20: 7, 59: 7, 100: 100, 140: 100, 200: 200}
    assert components(nodes, df.limit(0), "n").filter("n <> component").count() == 0


def test_shared_tables(spark):
    table = written(spark.range(5))
    assert table.path.startswith(shared_dir(spark)) and table.df.count() == 5
    table.drop()
    written(spark.range(1))
    assert sweep(spark) >= 1 and sweep(spark) == 0


def test_half_even_costs(spark):
    df = spark.createDataFrame([(0.5, 1), (1.5, 1), (2.5, 1)], "d double, r int")
    assert [r["c"]["r"] for r in df.select(rank.cost(df.d, df.r).alias("c")).collect()] == [0, 2, 2]


def test_typed_order(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "10"), (3, "9"), (4, "a"), (5, "9")], "id int, v string")
    assert [r["id"] for r in rows.orderBy(*metadata.typed_order("v")).collect()] == [3, 5, 2, 4, 1]
    assert [r["id"] for r in rows.orderBy(*metadata.typed_order("v", True)).collect()] == [1, 4, 2, 3, 5]


def test_blanks_and_categories(spark):
    rows = spark.createDataFrame([("a", "0"), ("b", ""), ("c", None), ("d", "NaN"), ("e", "x")], "ID string, v string")
    from cladewise.model import CategorySpec

    counts = metadata.category_counts(rows, CategorySpec("v"))
    assert {r["value"] for r in counts.collect()} == {"0", "x"}
    members = rows.selectExpr("ID as node_id", "'g' as group_id")
    assert {r["value"]: r["n"] for r in metadata.composition(members, rows, "v").collect()} == {"missing": 4, "x": 1}
    coloured = {r["value"]: r["colour"] for r in metadata.top_and_others(counts, 1, custom={"0": "#123456"}).collect()}
    assert coloured == {"0": "#123456", "Others": metadata.NO_COLOUR}


def test_search_with_many_records_and_bad_patterns(spark):
    rows = spark.createDataFrame([("n", "x"), ("n", "Yes"), ("m", None)], "ID string, v string")
    assert [r["ID"] for r in metadata.search(rows, "yes").collect()] == ["n"]
    assert metadata.search(rows, "(").count() == 0 and metadata.column_filter(rows, {"v": "("}).count() == 3


def test_columns(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert metadata.moved_column(rows, "a", 1).columns == ["b", "a", "c"] and metadata.moved_column(rows, "c", 5).columns == ["a", "b", "c"]
    assert metadata.distinct_columns(["A", "a", "B"]) == ["A", "B"]


def test_grid(spark):
    rows = spark.createDataFrame([(1, "x", "1"), (2, "y", None), (3, "x", "NaN"), (4, "x", "q")], "id int, g string, v string")
    total = {r["g"]: (r["avg_v"], r["sum_v"], r["n_v"]) for r in grid.group_levels(rows, ["g"], {"v": ("avg", "sum", "n")}).collect()}
    assert total == {"x": (1.0, 1.0, 1), "y": (None, None, 0)}
    assert grid.clamp_page(25, 9, 10) == 2 and grid.clamp_page(0, 3, 10) == 0 and grid.clamp_page(5, 1, 0) == 0
    assert grid.page(rows, [rows.id.desc()], 0, 0).count() == 4
    more = grid.insert(rows, spark.createDataFrame([(4, "z", "1"), (None, "z", "1")], rows.schema))
    assert {r["id"] for r in grid.bad_ids(more).collect()} == {4, None}


def test_rounding_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 49.9, 50.0, 149.0, 1949.0, 1950.0, 1951.0)], "m double")
    assert [r[0] for r in df.select(evaluate.distance_bin(df.m)).collect()] == [0, 0, 100, 100, 1900, 1900, 2000]


def test_scores_without_cases(spark):
    r = evaluate.scores(spark.createDataFrame([("m", 0, 0, 0)], "method string, tp int, fp int, fn int"), ["method"]).first()
    assert r["precision"] == r["sensitivity"] == r["f1"] == -1.0


def test_call_alleles(spark):
    df = spark.createDataFrame([(1, "a", "AAAA" + "C" * 6), (2, "b", "AAAT" + "C" * 6), (3, "c", "AAAA" + "G" * 6)], "ord int, sample string, sequence string")
    got = {(r["sample"], r["locus"]): r["allele"] for r in profile.call_alleles(df, 4, 5).collect()}
    assert got == {("a", 0): 1, ("b", 0): 2, ("c", 0): 1, ("a", 1): 1, ("b", 1): 1, ("c", 1): 2}


def test_complete_delete(spark):
    df = spark.createDataFrame([("a", [1, 0, 2]), ("b", [1, 3, 2])], "sample string, alleles array<int>")
    assert [r["alleles"] for r in profile.complete_delete(df).orderBy("sample").collect()] == [[1, 2], [1, 2]]


def test_written_tables(spark, tmp_path):
    sinks.write_table(spark.createDataFrame([("a", None, 1)], "ID string, v string, secret int"), str(tmp_path / "t"), without=("secret",))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "ID\tv"


def test_upsert_stream(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ID string, a string, b string"
    spark.createDataFrame([("1", "x", None), ("2", "y", "z")], schema).coalesce(1).write.parquet(source)
    for _ in range(1):
        upsert_stream(spark.readStream.schema(schema).parquet(source), folder).awaitTermination()
    spark.createDataFrame([("1", None, "new"), ("3", "q", None)], schema).coalesce(1).write.mode("append").parquet(source)
    upsert_stream(spark.readStream.schema(schema).parquet(source), folder).awaitTermination()
    rows = {r["ID"]: (r["a"], r["b"]) for r in spark.read.parquet(f"{folder}/v1").collect()}
    assert rows == {"1": ("x", "new"), "2": ("y", "z"), "3": ("q", None)}


def test_run_names_and_consecutive_rows(spark):
    df = spark.createDataFrame([(1, "/a/MSTree_0.05.txt"), (2, "NJ.txt"), (3, "x_7_b.txt")], "i int, p string")
    assert [tuple(r["r"]) for r in df.select(evaluate.run_parts(df.p).alias("r")).collect()] == [("MSTree", 0.05), ("NJ", None), ("x", 7.0)]
    assert [tuple(r) for r in evaluate.consecutive(df, "i", "i").orderBy("place").collect()] == [(1, 1, 2), (2, 3, None)]


def test_share_payload(spark):
    nodes = spark.createDataFrame([("r", None, None, True), ("x", "r", 1.0, True), ("a", "x", 2.0, False), ("b", "x", 3.0, False), ("c", "r", 4.0, False)], "node_id string, parent_id string, length double, is_hypo boolean")
    rows = spark.createDataFrame([("a", "1.5", "2", "y2001", "u"), ("c", "", "", "-3", "v"), ("z", "", "", "", "")], "ID string, Latitude string, Longitude string, `Collection Year` string, k string")
    text, table = sinks.share_payload(nodes, rows, {"k": {"u": "#000000"}})
    assert text == "(a:3,c:4);"
    assert {r["ID"]: (r["year"], r["k__colour"]) for r in table.collect()} == {"a": ("2001", "#000000"), "c": ("", "#FFFFFF")}


def test_server(spark):
    import threading
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import urlopen

    from cladewise.server import serve

    server = serve(spark, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def status(path, form=None):
        try:
            with urlopen(base + path, urlencode(form).encode() if form is not None else None) as r:
                return r.status, r.read().decode()
        except HTTPError as e:
            return e.code, ""

    assert [status(p)[0] for p in ("/", "/maketree", "/nowhere")] == [200, 405, 404]
    assert status("/maketree", {"method": "MSTree"})[0] == 204
    assert status("/maketree", {"profile": "#S\tL1\na\t1\nb\t2\n", "method": "MSTree"})[1].endswith(";")
    assert status("/maketree", {"profile": "#S\tL1\na\t1\n", "method": "__import__('os')"})[0] == 500
    shared = status("/sendToMicroReact", {"tree": "((a:1,b:2):1,c:3);", "metadata": "ID\tLat\tKind\na\t1\tx\nc\t2\ty\n", "colors": '{"Kind": {"x": "#ff0000"}}', "name": "n"})
    assert shared[0] == 200 and json.loads(shared[1])["name"] == "n"
    assert sorted(r[2] for r in trees.parse_newick(json.loads(shared[1])["tree"]) if r[2]) == ["a", "c"]
    assert "#ff0000" in json.loads(shared[1])["data"] and len(json.loads(shared[1])["data"].splitlines()) == 3
    assert status("/sendToMicroReact", {"tree": "((a", "metadata": "ID\na\n"})[0] == 500
    server.shutdown()


def test_numbers_across_partitions(spark):
    from pyspark.sql import functions as F

    from cladewise.operators.numbering import numbered

    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 5003).alias("k")).repartition(9)
    got = [(r["place"], r["k"]) for r in numbered(rows, [F.desc("k")]).orderBy("place").collect()]
    assert got == [(i, k) for i, k in enumerate(sorted((i * 7919 % 5003 for i in range(5000)), reverse=True), 1)]
    assert numbered(rows.limit(0), ["k"]).collect() == []
