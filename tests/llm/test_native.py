"""op1, op4 and op9: SQL at a small size, brute force, and dirty tables."""

import re
import time

import duckdb
import pytest

from cladewise.llm import op1_url_filter as op1
from cladewise.llm import op4_license_scan as op4
from cladewise.llm import op9_quality_rules as op9
from cladewise.llm import queries
from tests.llm.helpers import LONG, dirty, empty, lower, tuples, words
from tests.oracle import duck
from tests.oracle import rows as rows_of
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def page(i, url, html=""):
    return (i, url, html, "extra", None)


def judged(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op1.judge(df, **more).collect()}


def test_rules_and_parts(spark):
    got = judged(spark, [page(1, "http://A.Example.COM/en/71?x#y"), page(2, "https://example.com/en/6"), page(3, "x.net/de/8"), page(4, None), page(5, "http://example.net/de/8"), page(6, "http://a.net?/de/"), page(7, "http://org/es/"), page(8, "http://notorg/es/1"), page(9, "://h#f"), page(10, "")])
    assert got == {
        1: ("a.example.com", "/en/71", "example.com/en/7", "allow"), 2: ("example.com", "/en/6", "com/en/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("example.net", "/de/8", "example.net/de/8", "block"),
        6: ("a.net", "", None, "allow"), 7: ("org", "/es/", "org/es/", "block"), 8: ("notorg", "/es/1", None, "allow"), 9: ("h", "", None, "allow"), 10: ("", "", None, "allow"),
    }


def test_redirects_spread_blocks_and_allows_come_first(spark):
    link = lambda u: f'<head><LINK href="{u}" rel=canonical></head>'
    refresh = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    rows = [
        page(1, "http://a.site/x", link("http://b.site/y")), page(2, "http://b.site/y", refresh("http://c.com/en/1")),  # chain to a blocked target that is no page
        page(3, "http://d.site/", link("http://example.com/en/7")), page(4, "http://e.site/", link("http://d.site")), page(5, "http://f.org/es/1", link("http://d.site/")),  # an allowed member
        page(6, "http://g.site/p/q", link("../r")), page(7, "http://g.site/p/../r", refresh("/s?a=1&amp;b=2")), page(8, "http://g.site/s?a=1&b=2", link("//net/de/1")), page(9, "http://h.site/", link("mailto:x@y")),
    ]
    got = {k: v[3] for k, v in judged(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "block", 8: "block", 9: "allow"}


def linked_pages():
    """Each page's reference leads to a target; the last urls carry block rules."""
    head = lambda tag: f"<html><head>{tag}</head><body>x</body></html>"
    link = lambda u: head(f'<link rel="alternate canonical" href="{u}">')
    rows = [
        page(1, "http://g.site/p/q", link("../r")), page(2, "http://g.site/r", head("<META content='0; URL=\"./y\"' http-equiv=Refresh>")), page(3, "http://g.site/y", link("?x=1")), page(4, "http://g.site/y?x=1", link("/a/./b/../../net")),
        page(5, "http://g.site/net", link("//Net/de/1")), page(6, "http://h.site/", link("mailto:x@y")), page(7, "http://h.site/c", head("<!-- <link rel=canonical href=http://net/de/1> --><script>'<link rel=canonical href=http://net/de/1>'</script>")),
        page(8, "http://i.site/a/b", head('<base href="http://j.site/sub/page"><link href="deep" rel="canonical">')), page(9, "http://j.site/sub/deep", link("http://org/es/1?a=1&amp;b=&#50;&#x33;")), page(10, "http://org/es/1?a=1&b=23"),
        page(11, "http://k.site/x", head('<base href="../q/"><link rel=canonical href="./z/..">')), page(12, "http://k.site/q/", link("http://l.com/en/")), page(13, "http://m.site", link("http://n.site/../u#f")), page(14, "http://n.site/u", link("http://o.com/en/1")),
        page(15, "http://p.site/", link("#top")), page(16, "http://q.site/", link("")), page(17, None, link("http://net/de/1")), page(18, "http://r.site/ü/x", link("é?q=&lt;&#8364;&bogus;&")), page(19, "http://r.site/ü/é?q=<€&bogus;&", link("http://net/de/1")),
        page(20, "http://s.site/", head('<link data-href="http://net/de/1" rel="canonical-not" href="http://net/de/1">')), page(21, "http://t.site/", None),
        # Quotes open after = alone, and hold what they like; a tag that never closes is none.
        page(22, "http://u1.site/", head('<link title="a>b" rel="canonical" href="http://net/de/1">')), page(23, "http://u2.site/", head("<link title=it's rel=canonical href=http://net/de/1>")), page(24, "http://u3.site/", '<link rel=canonical href="http://net/de/1 <p>'),
        page(25, "http://u4.site/", head("<link rel=canonical href= >")), page(26, "http://u5.site/", head("<link rel=canonical href=http://net/de/1 title= >")), page(27, "http://u6.site/", "<link a<link rel=canonical href=http://net/de/1>"), page(28, "http://u7.site/", "<link rel=canonical href=http://net/de/1 <p>"),
        page(29, "http://u8.site/", head("<meta content='0;url=http://net/de/1' name='>' http-equiv = \n refresh>")), page(30, None, None), page(None, None, ""),
    ]
    return rows


def test_references_resolve_in_full(spark):
    got = {k: v[3] for k, v in judged(spark, linked_pages()).items()}
    assert {k for k, v in got.items() if v == "block"} == {1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13, 14, 18, 19, 22, 23, 26, 27, 29}


@pytest.mark.parametrize("tag", ['<link ', '<link a="', "<meta a='<base b=\"", '<base = ', '<link rel=canonical href=x ', '<!-- <link ', '<link a="b" ', '<link ' + ' ' * 50])
def test_tags_that_never_close(spark, tag):
    """A page of 100,000 of them is searched once, and the link before them is kept."""
    df = spark.createDataFrame([page(1, "http://a.site/", "<link rel=canonical href=http://net/de/1>" + tag * 100_000)], "page_id long, url string, html string, host string, verdict string")
    began = time.time()
    assert op1.links(df).count() >= 1
    assert time.time() - began < 5


def test_sql_of_linked_pages(spark, tmp_path):
    spark.createDataFrame(linked_pages(), "page_id long, url string, html string, host string, verdict string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    df = op1.op1_url_filter(spark, str(tmp_path))
    rel = duckdb.connect().sql(op1.OP1_SQL.replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')"))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_many_rules_are_a_table(spark):
    many = (*op1.RULES, *[("block", f"h{i}.site", "/") for i in range(300)], ("allow", "h7.site", "/"))
    rows = [*linked_pages(), page(30, "http://h5.site/x"), page(31, "http://a.h7.site/"), page(32, "http://h7.site/", '<link rel=canonical href="http://v.site/">'), page(33, "http://v.site/")]
    assert judged(spark, rows, rules=many) == judged(spark, rows, rules=spark.createDataFrame(many, "verdict string, rule_host string, rule_path string"))
    got = judged(spark, rows, rules=many)
    assert got[30][2:] == ("h5.site/", "block") and got[31][2:] == ("h7.site/", "allow") and got[33][2:] == (None, "allow") and got[1][3] == "block"


def test_hub_and_long_chain(spark):
    rows = [page(i, f"http://s{i}.site/", f'<link rel="canonical" href="http://s{i + 1 if i < 20 else 0}.site/">') for i in range(60)] + [page(99, "http://s7.site/", '<link rel="canonical" href="http://x.org/es/1">')]
    assert {v[3] for v in judged(spark, rows).values()} == {"block"}


def test_more_edges_and_rule_tables(spark):
    edges = spark.createDataFrame([("http://a.site/", "http://c.com/en/1"), (None, "http://a.site/")], "src string, dst string")
    assert judged(spark, [page(1, "http://a.site/"), page(2, "http://b.site/")], edges=edges)[1][3] == "block"
    df = spark.createDataFrame([(1, "example.com", "/en/71"), (2, "b.example.com", "/en/6"), (3, "x.y", "/")], "k int, host string, path string")
    rules = spark.createDataFrame(op1.RULES, "verdict string, rule_host string, rule_path string")
    assert tuples(op1.match_table(df, rules, "k"), "k", "rule", "rule_verdict") == tuples(op1.match(df), "k", "rule", "rule_verdict")


def test_no_pages(spark):
    assert judged(spark, []) == {}


def test_licenses_of_dirty_tables(spark):
    texts = ["Released UNDER the-MIT\nlicense. under the mit license", "Apache License, Version 2.0; cc by nc", "this work is licensed under the gnu general public license version 3", "under the kmit license", "permission is hereby granted, free of any charge to any person obtaining a copy of this software and the associated documentation files"]
    df = dirty(spark, [(20 + i, t) for i, t in enumerate(texts)])
    got = {}
    for r in op4.scan(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert {k: len(v) for k, v in got.items()}[6] == 2 and sum(map(len, got.values())) == df.count()
    one = lambda i: (got[i][0]["n_base"], got[i][0]["first_word"], got[i][0]["last_word"], got[i][0]["base_labels"], got[i][0]["labels"])
    assert one(20) == (2, 1, 5, "mit", "mit") and one(21) == (2, 0, 5, "apache-2,cc-by-nc", "apache-2,cc-by-nc")
    assert one(22) == (0, None, None, "", "gpl-3") and one(23) == (0, None, None, "", "") and one(24)[4] == "mit"
    assert one(1) == (0, None, None, "", "") and got[1][0]["n_words"] == 0 and got[1][0]["score"] == 0.0
    count = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)))
    assert all(r["n_words"] == count(r0) for i, r0 in ((4, LONG), (7, "ÉÀ ß 日本 😀\x00\x1f")) for r in got[i])
    assert all(0 <= r["score"] <= 1 for v in got.values() for r in v)
    assert op4.scan(empty(spark)).count() == 0


HEADERS = {
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2": "This file is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or later",
    "agpl": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "mit": "// SPDX-License-Identifier: MIT",
    "apache-2": "# SPDX-License-Identifier: Apache-2.0 OR WTFPL",
    "cc-by-sa": "This photo is CC BY-SA 4.0.",
    "gpl-3 ": "Distributed under the GNU General Public Licence v3.",
    "cc0": "To the extent possible under law, Ann Example has waived all copyright and related or neighboring rights to this work.",
    "bsd": "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following terms are met:",
    "cc-by": "Creative Commons Attribution 4.0 International",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def test_license_headers_and_plain_documents(spark, monkeypatch):
    rows = [(i, f"Some text before it. {t} And after.") for i, t in enumerate(HEADERS.values())]
    plain = [t for (t,) in duck("/root/testdata/sf0.01").sql("select text from documents where not regexp_matches(lower(text), 'licen|cc by|cc-by|rights reserved|permission is hereby')").fetchall()]
    assert len(plain) > 500
    rows += [(1000 + i, t) for i, t in enumerate(plain)] + [(3000, "the general public may use version 3 of the license of this program under the terms of the law"), (3001, "she will license the software to any person for free under the terms of the deal")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in op4.scan(df).collect()}
    assert [got[i] for i in range(len(HEADERS))] == [x.strip() for x in HEADERS]
    assert {v for k, v in got.items() if k >= 1000} == {""}
    # Masks of any width give the same.
    few = df.filter("doc_id < 30")
    one = tuples(op4.scan(few), "doc_id", "labels", "score")
    monkeypatch.setattr(op4, "WIDE", 7)
    assert tuples(op4.scan(few), "doc_id", "labels", "score") == one


NAMES = {
    "MIT License": "mit", "the MIT licence.": "mit", "GPLv3": "gpl-3", "gplv2,": "gpl-2", "LGPLv3": "lgpl", "AGPLv3": "agpl", "BSD 3-Clause License": "bsd", "2-clause BSD": "bsd", "Mozilla Public License, v. 2.0": "mpl", "MPL 2.0": "mpl", "CC0 1.0": "cc0", "GNU GPL version 1": "gpl-1", "ISC License": "isc",
    "Eclipse Public License - v 1.0": "epl", "SPDX-License-Identifier: EPL-1.0": "epl", "SPDX-License-Identifier: GPL-1.0-or-later": "gpl-1", "SPDX-License-Identifier: CC-BY-SA-3.0": "cc-by,cc-by-sa", "SPDX-License-Identifier: Apache-1.1": "apache-1",
    "gplv 3": "", "mit": "", "license mit": "", "MIT, a license": "", "v3 GPL": "", "3 clause": "", "GPLv3GPLv3": "",
}


def test_short_names(spark):
    rows = [(i, t) for i, t in enumerate(NAMES)] + [(100 + i, f"word {t} word") for i, t in enumerate(NAMES)] + [(200, "GPLv3"), (201, "gplv3 gplv3 MIT License gplv2 MIT License"), (202, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in op4.scan(df).collect()}
    cc = lambda x: x.replace("cc-by,cc-by-sa", "cc-by-sa")
    assert {t: cc(got[i][0]) for i, t in enumerate(NAMES)} == {t: cc(x) for t, x in NAMES.items()} == {t: cc(got[100 + i][0]) for i, t in enumerate(NAMES)}
    assert got[201] == ("gpl-2,gpl-3,mit", 1.0) and got[202] == ("", 0.0)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    rel = con.sql(op4.OP4_SQL)
    out = op4.scan(df).drop("copy")
    assert rows_of(out.columns, [tuple(r) for r in out.collect()]) == rows_of(list(rel.columns), rel.fetchall())


def test_notices_longer_than_a_mask(spark):
    text = next(t for label, t in op4.TEMPLATES if label == "mit" and len(t.split()) > op4.WIDE + 2)
    ws = text.split()
    edited = " ".join(w for k, w in enumerate(ws) if k % 12 != 7)
    found = op4.spans(spark.createDataFrame([(1, text), (2, edited), (3, " ".join(ws[10:40]))], "doc_id long, text string")).filter(f"len = {len(ws)}")
    got = {r["doc_id"]: r for r in found.orderBy("covered").collect()}  # the longest span of each
    assert (got[1]["covered"], got[1]["found"]) == (len(ws), True) and got[2]["found"] and not got[3]["found"] and got[3]["covered"] == 30


def repeated(ws):
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_quality_of_dirty_tables(spark):
    texts = ["a b c a b c a b", "x\nx\n\nx \ny", "# $% <a> | & *", "A!! B!! " * 40, "ha " * 60, "fine words make a text " * 3]
    df = dirty(spark, [(20 + i, t) for i, t in enumerate(texts)])
    rows = op9.ledger(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] >= 20:
            t = texts[r["doc_id"] - 20]
            ws, lines = words(t), [x for x in t.split("\n") if words(x)]
            want = (len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated(ws))
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
    assert {r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert op9.ledger(empty(spark)).count() == 0


def test_policies_and_ablations(spark):
    rows = op9.ledger(dirty(spark)).cache()
    kept = {p: op9.apply_policy(rows, p).filter("kept").count() for p in op9.POLICIES}
    assert kept["v1"] <= kept["base"]
    for r in op9.ablations(rows).collect():
        bit = next(1 << b for b, n, _ in op9.RULES if n == r["rule"])
        bits = [x["fail_bits"] for x in rows.select("fail_bits").collect()]
        assert (r["n_failed"], r["n_only"], r["n_kept_without"]) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))
    assert {r["n_failed"] for r in op9.ablations(op9.ledger(empty(spark))).collect()} == {0}
    whole = op9.keep_rows(dirty(spark))
    assert whole.columns == dirty(spark).columns and whole.filter("doc_id = 4").count() == 1 == whole.count()
