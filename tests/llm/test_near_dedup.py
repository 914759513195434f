"""op6 and the pipeline: brute force over all pairs, large groups, and dirty tables."""

import duckdb
import numpy as np
import pytest

from cladewise.llm import op3_decontaminate as op3
from cladewise.llm import op4_license_scan as op4
from cladewise.llm import op6_near_dedup as op6
from cladewise.llm import op9_quality_rules as op9
from cladewise.plans import storage
from tests.llm.helpers import dirty, empty, lower, words
from tests.oracle import duck


def brute(rows):
    """(doc_id, size, component, kept) of each row, by comparing all pairs of different sets."""
    sets = {}
    for i, text in rows:
        ws = words(lower(text))
        sets.setdefault(frozenset(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else []), []).append(i)
    keys = [s for s in sets if s]
    up = list(range(len(keys)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if 4 * min(len(keys[a]), len(keys[b])) >= 3 * max(len(keys[a]), len(keys[b])):
                common = len(keys[a] & keys[b])
                if 100 * common >= 75 * (len(keys[a]) + len(keys[b]) - common):
                    up[root(a)] = root(b)
    least = {}
    for k, s in enumerate(keys):
        least[root(k)] = min([least.get(root(k), 1 << 60), *[i for i in sets[s] if i is not None]])
    out = []
    for s, ids in sets.items():
        for i in ids:
            c = least[root(keys.index(s))] if s and i is not None else i
            out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in op6.near_duplicates(df).collect()), key=repr)


def test_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = duck(sf).sql("select doc_id, text from documents").fetchall()
    assert got(spark.read.parquet(f"{sf}/documents.parquet")) == brute(rows)


def copies(seed, n, size, common, edits):
    """Texts around one base, with more and more words replaced, some of them around a shared passage."""
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(size)]
    passage = [f"p{k}" for k in range(common)]
    out = []
    for i in range(n):
        ws = list(base)
        for k in rng.choice(size, int(rng.integers(0, edits)), replace=False):
            ws[k] = f"u{i}x{k}"
        out.append((1000 + i, " ".join(ws)))
        out.append((5000 + i, " ".join(passage + [f"o{i}y{k}" for k in range(int(rng.integers(1, 2 * common // 3)))])))
    return out


@pytest.mark.parametrize("size,common,edits", [(60, 40, 6), (140, 60, 9), (400, 150, 20)])
def test_groups_longer_than_a_hot_list(spark, size, common, edits):
    rows = copies(size, 60, size, common, edits)
    rows += [(9000 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(df) == brute(rows)


def by_sql(rows):
    """What OP6_SQL says of the rows."""
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    rel = con.sql(op6.OP6_SQL)
    at = [rel.columns.index(c) for c in ("doc_id", "n_shingles", "component_id", "kept")]
    return sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("size,edits", [(60, 6), (140, 9), (400, 20)])
def test_ids_of_several_texts(spark, size, edits):
    rng = np.random.default_rng(size)
    near = []
    for i in range(40):
        ws = [f"b{k}" for k in range(size)]
        for k in rng.choice(size, int(rng.integers(0, edits)), replace=False):
            ws[k] = f"u{i}x{k}"
        near.append((1000 + i, " ".join(ws)))
    # The same ids once more, with texts of equal size and other words; two ids tie their groups; an id of an empty and a linked text.
    rows = near + [(i, " ".join(f"z{i}y{k}" for k in range(size))) for i, _ in near]
    rows += [(7, near[0][1]), (7, f"c {near[0][1]}"), (3, ""), (3, near[1][1]), (4, "alone one two three four five"), (4, None), (4, "other words that stand alone here")]
    before = set(storage._kept)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == by_sql(rows)
    # Only what the result still reads is left.
    assert sorted(x.rsplit("/", 1)[1].split("-")[1] for x in storage._kept - before) == ["members", "several", "sketches"]


def test_ways_beyond_the_bounds_agree(spark, monkeypatch):
    rows = copies(2, 40, 90, 50, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = got(df)
    monkeypatch.setattr(op6, "MAX_HOT", 0)
    monkeypatch.setattr(op6, "MAX_BROADCAST_IDS", 0)
    assert got(df) == one == brute(rows)


def test_dirty(spark):
    df = dirty(spark, [(20, "one two three four five six"), (21, "ONE two\nthree four  five six"), (22, "one two three four"), (23, "one two three")])
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = [(i, n, c, True if i is None else k) for i, n, c, k in brute(rows)]
    assert got(df) == sorted(want, key=repr)
    assert got(empty(spark)) == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.written(stage(spark, docs, sf), name).df
        seen[name] = docs
    first = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "decontamination", "bpe"]
    assert all(seen[n].columns == first.columns for n in list(seen)[:-1])
    counts = [first.count()] + [x.count() for x in seen.values()]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    before, after = ([(r["doc_id"], r["text"]) for r in seen[n].collect()] for n in ("toxicity", "near_dedup"))
    assert {i for i, _ in after} == {i for i, _, _, k in brute(before) if k}
    assert pipeline.run(spark, sf).count() == counts[-1]


def test_dirty_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    text = " ".join(f"a{i} of the{i}" for i in range(40))
    leak = " ".join(f"leak{i}" for i in range(20))
    rows = [(1, text), (1, text), (2, text + " more"), (None, text.replace("a1 ", "z ")), (3, text.replace("a", "q")), (None, f"{text.replace('a', 'r')} {leak}"), (4, f"{text.replace('a', 's')} {leak}"), (5, None), (None, None)]
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 3]


def test_rows_of_one_id_with_different_texts(spark, tmp_path):
    import corpus_pipeline as pipeline

    text = lambda c: " ".join(f"{c}{i} of the{i}" for i in range(40))
    leak = " ".join(f"leak{i}" for i in range(20))
    # 5: a copy of 3, a document of its own (twice), one with a leak, and a near copy of that of its own.
    rows = [(3, text("a")), (5, text("a") + " more"), (5, text("b")), (5, text("b")), (5, f"{text('c')} {leak}"), (5, text("b") + " more"), (7, text("b") + " again"), (8, text("d")), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = pipeline.near_dedup(spark, docs, str(tmp_path))
    found = [(r["doc_id"], r["text"]) for r in left.collect()]
    own = [t for i, t in found if i == 5 and t in (text("b"), text("b") + " more")]
    assert len(own) == 1 and len(found) == 6
    assert set(found) == {(3, text("a")), (5, own[0]), (5, f"{text('c')} {leak}"), (8, text("d")), (8, None), (8, "")}
    clean = [(r["doc_id"], r["text"]) for r in pipeline.decontamination(spark, left, str(tmp_path)).collect()]
    assert sorted(clean, key=repr) == sorted([x for x in found if leak not in (x[1] or "")], key=repr)


@pytest.mark.parametrize("case", [False, True])
def test_columns_of_any_name(spark, tmp_path, case):
    """Names that the stages use themselves, and, where Spark can read them at all, names that differ only in case."""
    import corpus_pipeline as pipeline

    names = ["_key", "key", "row", "label", "h", "id", "digest", "rep", "value", "kept", "score", "a.b", "word s", "part", "copies"] + (["Doc_ID", "TEXT"] if case else [])
    text = lambda c: " ".join(f"{c}{i} of the{i}" for i in range(40))
    leak = " ".join(f"leak{i}" for i in range(20))
    texts = [(1, text("a")), (2, text("a") + " more"), (3, text("b")), (3, text("c")), (3, text("c")), (4, f"{text('d')} {leak}"), (5, None), (None, text("e")), (6, "few words")]
    rows = [(i, t, "x", *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(texts)]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.caseSensitive", str(case).lower())
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
        for name, stage in pipeline.STAGES[:-1]:
            out = pipeline.written(stage(spark, docs, str(tmp_path)), name).df
            assert out.columns == docs.columns
            docs = out
        # Of the two equal rows the first by its other columns stays.
        assert sorted(map(tuple, docs.collect()), key=repr) == sorted((rows[k] for k in (0, 2, 3, 7)), key=repr)
        assert pipeline.bpe(spark, docs, str(tmp_path)).count() == 4
        for query in (op6.near_duplicates(docs), op4.scan(docs), op9.ledger(docs), op3.leaks(docs, spark.createDataFrame([(1, text("b"))], "item_id long, text string"))):
            assert query.count()
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_run_leaves_what_it_reads(spark):
    import corpus_pipeline as pipeline

    before = set(storage._kept)
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    # One table: the last stage writes its rows, and what these were made of goes.
    left = [x.rsplit("/", 1)[1] for x in storage._kept - before]
    assert len(left) == 1 and all(left[0] in f for f in out.inputFiles()) and left[0].split("-")[1] == "bpe"


def test_pipeline_stages_keep_map_columns(spark):
    """Maps can't be compared, but rows that hold them can be kept; of rows equal in id and text the one whose other columns come first as JSON."""
    import corpus_pipeline as pipeline

    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, {"b": 2}), (1, text, {"a": 1}), (1, "another text of its own with other words in it altogether", None), (2, text, {}), (3, None, {"x": None}), (None, "a text without any id but words enough", {"y": 1})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    kept = sorted(((r["doc_id"], r["text"], r["more"]) for r in pipeline.near_dedup(spark, docs, "").collect()), key=repr)
    assert kept == sorted([(1, text, {"a": 1}), (1, rows[2][1], None), (3, None, {"x": None}), (None, rows[5][1], {"y": 1})], key=repr)
