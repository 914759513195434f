"""Indexed searches find what a full scan does, and read only what they must."""

import random
import re

import pytest

from cladewise.operators import metadata, search_index
from cladewise.plans import catalog, catalog_more  # noqa: F401  (the second adds to the first)
from tests.oracle import same

PATTERNS = ["abc", "^abc", "abc$", "a.c", "(abc)+d", "abc|bcd", "(?:abc)(bcd)?", "ab{2,3}c", "[ab]cdab", "abcda", "ABC", "\\babc\\b", "a\\.bc", "abc*", "abcd*a", "(?i)abc", "\\Qabc\\E", "\\p{L}bcd", "ab", "", "(", "éab", "ÉAB", "bcd(?=a)", "(abc|dab)cda", "a\\d+bcd", "(ab(cd)a)"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice("abcdAB.é 1") for _ in range(rng.randint(0, 14)))
    return spark.createDataFrame([(f"k{i % 150}", text(), text(), i) for i in range(200)] + [(None, "abcd", "x", 0)], "ID string, one string, two string, three int")


def test_every_pattern(spark, rows, tmp_path):
    search_index.build(rows, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    got = lambda df: sorted(r["ID"] for r in df.collect() if r["ID"] is not None)
    for pattern in PATTERNS:
        for column in (None, "one"):
            assert got(search_index.indexed_search(rows, index, pattern, column)) == got(metadata.search(rows, pattern, column)), pattern


@pytest.mark.parametrize(("pattern", "want"), [
    ("^Build", ["bui", "ild", "uil"]), ("ab", []), ("abc|abd", []), ("(abc)d", ["abc", "bcd"]), ("(abc)+d", ["abc"]), ("(abc)?bcd", ["bcd"]), ("a.bcd", ["bcd"]), ("a\\.bc", [".bc", "a.b"]), ("(?x)abc", []), ("\\Qabc\\E", []), ("[abc]def", ["def"]), ("abc{0,2}", []), ("(", []),
])
def test_what_is_certain(pattern, want):
    assert search_index.certain(pattern) == want


def test_what_is_certain_holds():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice("abcAB.1 ") for _ in range(rng.randint(0, 10)))
        for pattern in PATTERNS:
            try:
                if re.search(pattern, text, re.I):
                    assert all(g in text.lower() for g in search_index.certain(pattern)), (pattern, text)
            except re.error:
                pass


def test_the_scan_is_pruned(spark, rows, tmp_path):
    search_index.build(rows, str(tmp_path / "index"))
    plan = search_index.postings(spark.read.parquet(str(tmp_path / "index")), ["abc"], "one")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket[^\]]*= \d+", plan) and "EqualTo(gram,abc)" in plan and "EqualTo(column,one)" in plan
    assert len({f.split("bucket=")[1].split("/")[0] for f in spark.read.parquet(str(tmp_path / "index")).inputFiles()}) > 10


def test_query(spark):
    same(spark, catalog.QUERIES["indexed_search"], catalog.ORACLE_SQL["indexed_search"], "/root/testdata/sf0.01")
