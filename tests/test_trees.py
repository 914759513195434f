"""Kernels against brute force, file formats, and whole runs."""

import itertools
import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladewise.backend import backend, load
from cladewise.functions import kernels
from cladewise.model import DistanceSpec, TreeSpec
from cladewise.operators import distance, mst, profile, tree
from cladewise.sources import profile_files, sinks, trees

PROFILE = "## free comment\n#Strain\tST\t#note\tL1\tL2\tL3\na\t1\tx\t1\t2\t3\nb\t1\tx\t1\t2\t3\nc d\t2\ty\t-\t2\t0\ne\t3\ty\t0\tN\t-\nf\t4\tz\t9\t9\t9\n"


def spanning_cost(cost):
    """Brute force: the cheapest choice of parents without a cycle."""
    n, best = len(cost), np.inf
    for parents in itertools.product(range(n + 1), repeat=n):
        if parents.count(n) != 1:
            continue
        for v in range(n):
            seen = set()
            while v != n and v not in seen:
                seen.add(v)
                v = parents[v]
            if v != n:
                break
        else:
            best = min(best, sum(cost[p, v] for v, p in enumerate(parents) if p < n))
    return best


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 5), st.integers(0, 10**6))
def test_arborescence(n, seed):
    cost = np.random.default_rng(seed).integers(0, 7, (n, n)).astype(float)
    edges = kernels.arborescence(cost.copy())
    assert len({t for _, t in edges}) == n - 1 == len(edges)
    assert sum(cost[s, t] for s, t in edges) == spanning_cost(cost)


def test_spanning_tree_ways_agree(spark):
    d = np.random.default_rng(3).integers(1, 30, (40, 40))
    edges = spark.createDataFrame([(i, j, int(d[i, j]), 0, i, j) for i in range(40) for j in range(i + 1, 40)], "u long, v long, r long, w int, i int, j int").selectExpr("u", "v", "struct(r, w, i, j) as key")
    one = {(r.u, r.v) for r in mst.spanning_tree(edges).collect()}
    two = {(r.u, r.v) for r in mst.boruvka(edges).collect()}
    assert one == two and len(one) == 39


def test_blockwise_run():
    d = kernels.distances(np.array([[0, 0, 0, 0, 0, 0]]), np.array([[0, 2, 2, 3, 0, 3]]), DistanceSpec("blockwise", block_penalty=0.25))
    assert d[0, 0] == 3.25


def test_neighbour_joining_is_exact_on_additive_distances():
    # ((0:2,1:3):1,(2:4,3:5):2)
    d = np.array([[0, 5, 9, 10], [5, 0, 10, 11], [9, 10, 0, 9], [10, 11, 9, 0]], float)
    edges = kernels.neighbour_joining(d)
    near = {}
    for a, b, x in edges:
        near.setdefault(a, []).append((b, x))
        near.setdefault(b, []).append((a, x))

    def far(a, b, seen=()):
        return 0 if a == b else min((x + far(c, b, (*seen, a)) for c, x in near[a] if c not in seen), default=np.inf)

    assert all(abs(far(i, j) - d[i, j]) < 1e-9 for i in range(4) for j in range(4))


@pytest.mark.parametrize("n", [4, 7, 12])
def test_weighted_joining_is_exact_on_additive_distances(n):
    rng = np.random.default_rng(n)
    up, length = {0: None}, {}
    for v in range(1, 2 * n):
        up[v], length[v] = int(rng.integers(0, v)), float(rng.integers(1, 9))
    line = lambda v: [v] if up[v] is None else [v, *line(up[v])]
    leaves = [v for v in up if v not in set(up.values())]

    def far(a, b):
        x, y = line(a), line(b)
        return sum(length[v] for v in set(x) ^ set(y))

    d = np.array([[far(a, b) for b in leaves] for a in leaves])
    near = {}
    for a, b, x in kernels.neighbour_joining(d, weighted=True):
        near.setdefault(a, []).append((b, x))
        near.setdefault(b, []).append((a, x))

    def path(a, b, seen=()):
        return 0 if a == b else min((x + path(c, b, (*seen, a)) for c, x in near[a] if c not in seen), default=np.inf)

    assert all(abs(path(i, j) - d[i, j]) < 1e-6 for i in range(len(d)) for j in range(len(d)))


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 9), st.integers(0, 10**6))
def test_recrafted_branches_still_span(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 3, (n, 6)) + 1
    d = kernels.distances(a, a, DistanceSpec("asymmetric"))
    rank = rng.permutation(n)
    tree_ = kernels.directed_tree(d, rank)
    out = kernels.recraft([list(e) for e in tree_], d, rank, 6)
    root = list(range(n))
    for s, t, x in out:
        assert x == d[s, t] and root[s] != root[t]
        root = [root[s] if r == root[t] else r for r in root]
    assert len(out) == n - 1 and len(set(root)) == 1


def test_arborescence_of_many_nodes_takes_no_cubic_time():
    import time

    rng = np.random.default_rng(2)
    took = {}
    for n in (400, 1600):
        a = rng.integers(0, 6, (n, 24))
        cost = np.rint(kernels.distances(a, a, DistanceSpec("asymmetric", "absolute_distance"))) + np.arange(n)[:, None] / n
        began = time.process_time()
        assert len(kernels.arborescence(cost)) == n - 1
        took[n] = time.process_time() - began
    assert took[1600] < 40 * max(0.05, took[400])


def test_block_forests_are_enough(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [int(x) for x in rng.integers(0, 3, 7)]) for i in range(60)], "sample long, alleles array<int>")
    found = {}
    for block in (512, 7):
        monkeypatch.setattr(distance, "BLOCK", block)
        for spec in (TreeSpec("MSTree"), TreeSpec("goeBurst"), TreeSpec("MSTree", DistanceSpec("blockwise")), TreeSpec()):
            _, edges = mst.tree_edges(rows, spec)
            found.setdefault(spec, []).append(sorted((min(s, t), max(s, t), x) for s, t, x in edges))
    assert all(a == b for a, b in found.values())


def test_contemporary_limits():
    assert not kernels.contemporary(1, 1, 50, 2, 100)
    assert kernels.contemporary(5, 5, 3, 3, 100)


def test_symmetric_properties():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 4, (12, 9))
    a[:, 0] = 1
    d = kernels.distances(a, a, DistanceSpec())
    assert np.allclose(d, d.T)
    assert (np.diag(kernels.distances(a, a, DistanceSpec("asymmetric"))) == 0).all()
    none = kernels.distances(np.array([[1, 0]]), np.array([[0, 1]]), DistanceSpec())
    assert none[0, 0] == 2  # nothing in common: as far as there are loci


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [i % 3, i % 5, i % 2]) for i in range(20)], "sample long, alleles array<int>")
    for spec in (DistanceSpec(), DistanceSpec("asymmetric", "absolute_distance")):
        monkeypatch.setattr(distance, "BLOCK", 512)
        one = {(r.src, r.dst): r.d for r in distance.pairs(rows.filter("alleles[0] > 0"), spec).collect()}
        monkeypatch.setattr(distance, "BLOCK", 3)
        assert one == {(r.src, r.dst): r.d for r in distance.pairs(rows.filter("alleles[0] > 0"), spec).collect()}


def test_profile_text(spark):
    packed = load(spark, PROFILE)
    got = {r["sample"]: r["alleles"] for r in packed.collect()}
    assert got["a"] == got["b"] and got["c_d"][0] == got["c_d"][2] == 0 and got["e"] == [0, 0, 0]
    groups = {r["rep"]: r["members"] for r in profile.dedup(profile.drop_empty(packed)).collect()}
    assert groups["a"] == ["a", "b"] and "e" not in groups


def test_profile_without_hash_header_and_gzip(spark, tmp_path):
    import gzip

    path = tmp_path / "p.profile.gz"
    path.write_bytes(gzip.compress(b"Strain\tL1\tL2\nx\t1\t2\ny\t1\t3\n"))
    assert profile_files.read_profile(spark, str(path)).select("sample").distinct().count() == 2


def test_ragged_profile_raises(spark):
    with pytest.raises(Exception, match="too few fields"):
        profile_files.read_profile(spark, "#S\tL1\tL2\na\t1\n").collect()


def test_header_below_many_comments(spark):
    comments = [f"# note {i}" for i in range(1500)]
    rows = profile_files.read_profile(spark, "\n".join([*comments, "#S\tL1\tL2", "## more", "a\t1\t2", "#late\tX", "b\t3\t4"]))
    assert sorted(map(tuple, rows.collect())) == [("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3"), ("b", 1, "4")]
    rows = profile_files.read_profile(spark, "\n".join([*(f"#{x}" for x in comments), "S\tL1", "a\t1"]))
    assert list(map(tuple, rows.collect())) == [("a", 0, "1")]


def test_fasta(spark):
    rows = profile_files.read_profile(spark, ">a first\nAC\nGN\n>b\nACG-\n").collect()
    assert {(r["sample"], r["locus"]): r["allele"] for r in rows}[("b", 3)] == "-" and len(rows) == 8


def test_metadata_last_row_wins(spark):
    rows = profile_files.read_metadata(spark, "ID,Country,Year\n1,X,2000\n2,Y,\n1,Z,2001\n").collect()
    assert {r["ID"]: (r["Country"], r["Year"]) for r in rows} == {"1": ("Z", "2001"), "2": ("Y", "")}


@pytest.mark.parametrize("text,kind", [(">a\nAC", "profile"), ("#S\tL", "profile"), ("#NEXUS", "tree"), ("ID,Year", "metadata"), ("(a,b);", "tree"), ("ID\tYear", "metadata")])
def test_formats(text, kind):
    assert profile_files.detect_format(text) == kind


def test_direct_urls():
    assert profile_files.direct_url("https://www.dropbox.com/s/x/t.nwk?dl=0").endswith("?dl=1")
    assert profile_files.direct_url("https://github.com/o/r/blob/main/t.nwk") == "https://raw.githubusercontent.com/o/r/main/t.nwk"


def test_newick_round_trip():
    rows = trees.parse_newick("((a:1,b:2)95:0.5,'c d':1e-05)root;")
    assert [r[0] for r in rows] == ["_hypo_0", "_hypo_1", "a", "b", "c d"]
    assert sinks.newick([(r[0], r[1], r[2], r[3]) for r in rows]) == "((a:1,b:2):0.5,c d:1e-05);"
    with pytest.raises(ValueError):
        trees.parse_newick("((a,b);")


def test_nexus():
    rows = trees.parse_nexus("#NEXUS\nbegin trees;\ntranslate 1 one, 2 'two x';\ntree t = [&R] (1[&x={1,2},y=3]:1,2:2);\nend;")
    assert [r[2] for r in rows if r[2]] == ["one", "two x"] and rows[1][6] == {"x": ["1", "2"], "y": ["3"]}


def test_nexus_taxa_block():
    text = "#NEXUS\nbegin taxa;\ndimensions ntax=3;\ntaxlabels 'a b' \"c;d\" [x] it''s;\nend;\nbegin trees;\ntree t = (1:1,(2:2,3:3):1);\nend;"
    assert trees.taxa(text.replace("it''s", "'it''s'")) == ["a b", "c;d", "it's"]
    assert [r[2] for r in trees.parse_nexus(text.replace("it''s", "'it''s'")) if r[2]] == ["a b", "c;d", "it's"]


def test_tree_list_expands_composite_leaves():
    (name, rows), = trees.tree_list("tree t1 = [&U] ({a,b}:1,c:2);\n")
    assert name == "t1" and sorted(r[2] for r in rows if r[2]) == ["a", "b", "c"]


def test_project_links():
    rows = trees.parse_project(json.dumps({"nodes": ["hypothetical_node", "a"], "links": [{"source": 0, "target": 1, "distance": 2}]}))
    assert rows[1][:4] == ("a", "_hypo_0", "a", 2.0)


def test_many_trees(spark):
    df = spark.createDataFrame([(1, "(a,b);"), (2, "(c:1,(d,e));")], "tree_id int, text string")
    assert trees.parse_trees(df).filter("not is_hypo").count() == 5


@pytest.mark.parametrize("spec", [TreeSpec(), TreeSpec("MSTree"), TreeSpec("MSTree", recraft=True), TreeSpec("NJ"), TreeSpec("goeBurst"), TreeSpec("MSTree", DistanceSpec("blockwise"))])
def test_trees_hold_every_sample(spark, spec):
    from cladewise.backend import tree_text

    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(f"s{i:02}", [int(x) for x in rng.integers(0, 4, 8)]) for i in range(15)] + [("copy", [1, 2, 3, 1, 2, 3, 1, 2]), ("copy2", [1, 2, 3, 1, 2, 3, 1, 2])], "sample string, alleles array<int>")
    text = tree_text(rows, spec)
    names = sorted(r[2] for r in trees.parse_newick(text) if r[2])
    assert names == sorted([f"s{i:02}" for i in range(15)] + ["copy", "copy2"])


def test_backend(spark):
    assert backend(spark, "#S\tL1\na\t1\n", method="MSTree") == "a;"
    two = backend(spark, "#S\tL1\tL2\na\t1\t1\nb\t1\t2\n", method="MSTree")
    assert sorted(r[2] for r in trees.parse_newick(two) if r[2]) == ["a", "b"]
    lines = backend(spark, PROFILE, method="distance").split("\n")
    assert lines[0] == "    4" and lines[1].startswith("a          0.000000 0.000000")
    assert json.loads(backend(spark, PROFILE, method="NJ", checkEnv=True))["time"] == 5
    with pytest.raises(ValueError):
        backend(spark, "#S\tL1\na\t1\na\t2\n")


def test_collapse_flags(spark):
    nodes = spark.createDataFrame([("r", None, None, 0, True, 0), ("x", "r", -1.0, 1, True, 0), ("a", "x", 0.0, 2, False, 1), ("b", "x", 5.0, 2, False, 2), ("c", "r", 1.0, 1, False, 3)], "node_id string, parent_id string, length double, depth int, is_hypo boolean, ord int")
    group = lambda df: {r["node_id"]: r["group_id"] for r in df.collect()}
    assert group(tree.collapse(nodes, 0)) == {"r": "r", "x": "r", "a": "r", "b": "b", "c": "c"}
    forced = group(tree.collapse(nodes, 0, force=nodes.filter("node_id = 'b'"), keep=nodes.filter("node_id = 'c'")))
    assert forced["b"] == "r" and forced["c"] == "c"
    assert tree.auto_threshold(nodes, 2) == 0.0 and tree.auto_threshold(nodes, 1) == 1.0
    labels = {r["group_id"]: (r["label"], r["size"]) for r in tree.group_labels(nodes, tree.collapse(nodes, 0)).collect()}
    assert labels["r"] == ("a", 1)
    left = {r["node_id"]: (r["parent_id"], r["length"]) for r in tree.without(nodes, nodes.filter("node_id = 'a'")).collect()}
    assert left == {"r": (None, None), "b": ("r", 5.0), "c": ("r", 1.0)}


def test_smoothing_and_midpoint():
    rows = [("r", None, None, 0.0), ("a", "r", "a", 0.05), ("b", "r", "b", 4.0), ("c", "r", "c", 1.0)]
    assert {v: x for v, _, _, x in tree.smooth(rows)} == {"r": 0.0, "a": 0.0, "b": 4.05, "c": 1.05}
    mid = tree.midpoint(rows)
    assert sum(x for *_, x in mid) == pytest.approx(5.05) and sorted(n for _, _, n, _ in mid if n) == ["a", "b", "c"]


def plain_joining(d, weighted):
    """Neighbour joining by the whole matrix at every step: the splits with their lengths."""
    d = {(i, j): float(x) for (i, j), x in np.ndenumerate(d)}
    v, live, under, out = dict(d), list(range(round(len(d) ** 0.5))), {}, {}
    under = {i: frozenset([i]) for i in live}
    fresh = len(live)
    while len(live) > 3:
        m, total = len(live), {i: sum(d[i, k] for k in live if k != i) for i in live}
        i, j = min(((a, b) for a in live for b in live if a < b), key=lambda p: (m - 2) * d[p] - total[p[0]] - total[p[1]])
        half = d[i, j] / 2 + (total[i] - total[j]) / (2 * (m - 2))
        out[under[i]], out[under[j]] = half, d[i, j] - half
        rest = [k for k in live if k not in (i, j)]
        share = 0.5
        if weighted and v[i, j] > 0:
            share = min(1, max(0, 0.5 + sum(v[j, k] - v[i, k] for k in rest) / (2 * (m - 2) * v[i, j])))
        for k in rest:
            d[fresh, k] = d[k, fresh] = share * (d[i, k] - half) + (1 - share) * (d[j, k] - d[i, j] + half)
            v[fresh, k] = v[k, fresh] = share * v[i, k] + (1 - share) * v[j, k] - share * (1 - share) * v[i, j]
        under[fresh] = under[i] | under[j]
        live, fresh = [*rest, fresh], fresh + 1
    for a, b, c in (live, live[1:] + live[:1], live[2:] + live[:2]):
        out[under[a]] = (d[a, b] + d[a, c] - d[b, c]) / 2
    return out


def by_split(lengths, n):
    """Lengths by the side of each split that lacks leaf 0."""
    return {s if 0 not in s else frozenset(range(n)) - s: x for s, x in lengths.items()}


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("n", [3, 4, 5, 12, 40])
def test_neighbour_joining_against_whole_matrices(n, weighted):
    points = np.random.default_rng(n).random((n, 4))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    under, lengths = {i: frozenset([i]) for i in range(n)}, {}
    for parent, child, x in kernels.neighbour_joining(d, weighted):
        lengths[under[child]] = x
        under[parent] = under.get(parent, frozenset()) | under[child]
    got, want = by_split(lengths, n), by_split(plain_joining(d, weighted), n)
    # Of the last four nodes two pairs are equally good; with variances the lengths depend on which is taken.
    assert set(got) == set(want)
    assert weighted or got == {s: pytest.approx(x, abs=1e-9) for s, x in want.items()}


def test_joining_of_many_nodes():
    points = np.random.default_rng(1).random((1200, 10))
    began = time.time()
    assert len(kernels.neighbour_joining(np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)))) == 2 * 1200 - 3
    assert time.time() - began < 12


@pytest.mark.parametrize(("d02", "d12", "d01", "start", "want"), [
    (10, 10, 2, (1, 2), (0, 2)),  # as near to the better-ranked sample: the branch goes there
    (16, 10, 2, (1, 2), (1, 2)),  # farther than both ways together: it stays
    (14, 10, 2, (1, 2), (1, 2)),  # within 1.5 times as far, but farther than by way of the other
    (10, 3, 6, (0, 2), (1, 2)),  # a neighbour that is nearer, and by way of which the branch is shorter
])
def test_one_branch_is_moved_as_worked_out_by_hand(d02, d12, d01, start, want):
    d = np.array([[0, d01, d02], [d01, 0, d12], [d02, d12, 0]], float)
    short = [0, 1, float(d01)]
    found = kernels.recraft([short, [*start, d[start]]] if d01 <= d[start] else [[*start, d[start]], short], d, np.array([0, 1, 2]), 100)
    assert sorted(tuple(sorted(b[:2])) for b in found) == sorted([(0, 1), want])
    assert all(x == d[s, t] for s, t, x in found)
