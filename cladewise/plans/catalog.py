"""The library's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions import kernels
from cladewise.functions.estimate import estimate
from cladewise.model import CategorySpec, DistanceSpec
from cladewise.operators import components, distance, evaluate, grid, metadata, mst, near, profile, rank, tree, zorder
from cladewise.plans import views
from cladewise.plans.storage import room, written
from cladewise.sources import sinks, trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- distances
def _reps(packed: DataFrame) -> DataFrame:
    return written(profile.dedup(profile.drop_empty(packed)), "profiles").df


def _distance_query(name: str, view, view_sql: str, spec: DistanceSpec, formula: str, extra: str = "", where: str = "") -> None:
    condition = "a.sid <> b.sid" if spec.directed else "a.sid < b.sid"
    sql = f"WITH {view_sql}, {views.REPS}{extra} SELECT a.sid AS src, b.sid AS dst, round({formula}, 6) AS d FROM p a JOIN p b ON a.locus = b.locus{where} WHERE {condition} GROUP BY a.sid, b.sid"

    @register(name, sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return distance.pairs(_reps(view(spark, sf_dir)).select("rep", "alleles"), spec, "rep", each=kernels.rounded)


_BOTH = "a.allele > 0 AND b.allele > 0"
_DIFFER = f"count(*) FILTER ({_BOTH} AND a.allele <> b.allele)"
_LOCI = "CAST(count(*) AS DOUBLE)"
_TARGET = "count(*) FILTER (b.allele > 0 AND a.allele <> b.allele)"
_PRESENCE = (
    ", w AS (SELECT locus, sum(CASE WHEN allele > 0 THEN 1 ELSE 0 END) AS m FROM p GROUP BY locus), pp AS (SELECT locus, "
    "CAST(m * (m - 1) AS DOUBLE) / ((SELECT count(*) FROM reps) * ((SELECT count(*) FROM reps) - 1)) AS pl FROM w)"
)
_WEIGHTED = f"sum(CASE WHEN {_BOTH} AND a.allele <> b.allele THEN 1.0::DOUBLE WHEN a.allele = 0 AND b.allele > 0 THEN pl ELSE 0.0::DOUBLE END)"
_distance_query("dist_symmetric_pair_delete", views.events_profile, views.P1, DistanceSpec(), f"({_DIFFER} + 0.01::DOUBLE) * {_LOCI} / (count(*) FILTER ({_BOTH}) + 0.01::DOUBLE)")
_distance_query("dist_symmetric_as_allele", views.events_profile, views.P1, DistanceSpec(missing="as_allele"), "CAST(count(*) FILTER (a.allele <> b.allele) AS DOUBLE)")
_distance_query("dist_symmetric_absolute", views.events_profile, views.P1, DistanceSpec(missing="absolute_distance"), f"CAST({_DIFFER} AS DOUBLE)")
_distance_query("dist_symmetric_complete_delete", views.events_profile, views.P1, DistanceSpec(missing="complete_delete"), "CAST(count(*) FILTER (a.allele <> b.allele AND ok) AS DOUBLE)", ", whole AS (SELECT locus, min(allele) > 0 AS ok FROM p GROUP BY locus)", " JOIN whole ON whole.locus = a.locus")
_distance_query("dist_asymmetric", views.events_profile, views.P1, DistanceSpec("asymmetric"), f"{_TARGET} * {_LOCI} / count(*) FILTER (b.allele > 0)")
_distance_query("dist_asymmetric_absolute", views.orders_profile, views.P2, DistanceSpec("asymmetric", "absolute_distance"), f"CAST({_TARGET} AS DOUBLE)")
_distance_query("dist_asymmetric_wgmlst", views.events_profile, views.P1, DistanceSpec("asymmetric_wgMLST"), f"{_WEIGHTED} * {_LOCI} / count(*) FILTER (b.allele > 0)", _PRESENCE, " JOIN pp ON pp.locus = a.locus")
_distance_query("dist_embeddings", views.embeddings_profile, views.P3, DistanceSpec(), f"({_DIFFER} + 0.01::DOUBLE) * {_LOCI} / (count(*) FILTER ({_BOTH}) + 0.01::DOUBLE)")


@register(
    "dist_blockwise",
    f"""WITH {views.P1}, {views.REPS}, x AS (SELECT a.sid AS src, b.sid AS dst, a.locus, a.allele - b.allele AS delta, lag(a.allele - b.allele, 1, 0) OVER (PARTITION BY a.sid, b.sid ORDER BY a.locus) AS before
  FROM p a JOIN p b ON a.locus = b.locus WHERE a.sid < b.sid)
SELECT src, dst, round(count(*) FILTER (delta <> 0 AND delta <> before) + 0.01::DOUBLE * (count(*) FILTER (delta <> 0) - count(*) FILTER (delta <> 0 AND delta <> before)), 6) AS d FROM x GROUP BY src, dst""",
)
def _blockwise(spark, sf_dir):
    return distance.pairs(_reps(views.events_profile(spark, sf_dir)).select("rep", "alleles"), DistanceSpec("blockwise"), "rep", each=kernels.rounded)


_PAIRS = (
    f"e AS (SELECT a.sid AS src, b.sid AS dst, ({_DIFFER} + 0.01::DOUBLE) * {_LOCI} / (count(*) FILTER ({_BOTH}) + 0.01::DOUBLE) AS d FROM p a "
    f"JOIN p b ON a.locus = b.locus WHERE a.sid <> b.sid GROUP BY 1, 2)"
)
_DIRECTED = f"e AS (SELECT a.sid AS src, b.sid AS dst, {_TARGET} * {_LOCI} / count(*) FILTER (b.allele > 0) AS d FROM p a JOIN p b ON a.locus = b.locus WHERE a.sid <> b.sid GROUP BY 1, 2)"


@register(
    "dist_normalised",
    f"""WITH {views.P2}, {views.REPS}, {_PAIRS}, f AS (SELECT * FROM e UNION ALL SELECT rep, rep, 0.0 FROM reps), m AS (SELECT rep, unnest(members) AS member FROM reps)
SELECT a.member AS src, round(sum(d / 5), 4) AS total, max(round(d / 5, 6)) AS farthest, count(*) AS n FROM f JOIN m a ON a.rep = f.src JOIN m b ON b.rep = f.dst GROUP BY a.member""",
)
def _normalised(spark, sf_dir):
    """Sums and the largest of each customer's distances, by groups of equal profiles."""
    found = distance.member_totals(_reps(views.orders_profile(spark, sf_dir)), views.PRIORITIES, DistanceSpec())
    return found.select("src", F.round("total", 4).alias("total"), "farthest", "n")


@register(
    "phylip_rows",
    f"""WITH {views.P1}, {views.REPS}, {_PAIRS}, f AS (SELECT * FROM e UNION ALL SELECT rep, rep, 0.0 FROM reps), m AS (SELECT rep, unnest(members) AS member FROM reps)
SELECT a.member AS name, rpad(CAST(a.member AS VARCHAR), 10, ' ') || ' ' || string_agg(printf('%.6f', round(d / 24, 6)), ' ' ORDER BY b.rep, b.member) AS line FROM f JOIN m a ON a.rep = f.src JOIN m b ON b.rep = f.dst GROUP BY a.member""",
)
def _phylip(spark, sf_dir):
    return sinks.phylip_lines(_reps(views.events_profile(spark, sf_dir)), 24, DistanceSpec()).select(F.col("src").alias("name"), "line")


# ---- profiles
@register(
    "encode_alleles",
    """WITH c AS (SELECT s.sid, l.locus, coalesce(o.a, '0') AS allele FROM (SELECT DISTINCT user_id AS sid FROM events) s CROSS JOIN (SELECT range AS locus FROM range(24)) l
  LEFT JOIN (SELECT user_id AS sid, hour(ts) AS locus, min(event_type) AS a FROM events GROUP BY 1, 2) o ON o.sid = s.sid AND o.locus = l.locus)
SELECT sid AS sample, CAST(locus AS INT) AS locus, CASE WHEN allele IN ('0', 'N', '-') THEN 0 ELSE CAST(dense_rank() OVER (PARTITION BY locus ORDER BY allele) AS INT) END AS allele FROM c""",
)
def _encode(spark, sf_dir):
    return profile.encode(views.events_long(spark, sf_dir))


@register("dedup_groups", f"WITH {views.P2}, {views.REPS} SELECT rep, size, list_aggregate(members, 'string_agg', ',') AS members, idx FROM reps")
def _dedup(spark, sf_dir):
    return profile.indexed(_reps(views.orders_profile(spark, sf_dir))).select("rep", "size", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.col("idx").cast("long").alias("idx"))


@register("complete_loci", f"WITH {views.P1} SELECT CAST(locus AS INT) AS locus FROM cells GROUP BY locus HAVING min(allele) > 0")
def _complete(spark, sf_dir):
    return profile.unpack(views.events_profile(spark, sf_dir)).groupBy("locus").agg(F.min("allele").alias("least")).filter("least > 0").select("locus")


@register(
    "call_alleles",
    """WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) > 0), g AS (SELECT doc_id, unnest(range(CAST((length(text) - 1) // 1000 AS BIGINT) + 1)) AS locus, text FROM d),
c AS (SELECT doc_id, locus, substr(text, CAST(locus * 1000 + 1 AS BIGINT), 900) AS gene FROM g), f AS (SELECT locus, gene, min(doc_id) AS first FROM c GROUP BY 1, 2),
n AS (SELECT locus, gene, row_number() OVER (PARTITION BY locus ORDER BY first) AS allele FROM f)
SELECT doc_id AS sample, CAST(c.locus AS INT) AS locus, CAST(allele AS INT) AS allele FROM c JOIN n ON n.locus = c.locus AND n.gene = c.gene""",
)
def _call(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").filter("length(text) > 0")
    return profile.call_alleles(docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("sample"), F.col("text").alias("sequence")))


# ---- ranks and trees
_HARMONIC = (
    "r AS (SELECT rep, idx, size, row_number() OVER (ORDER BY round((SELECT count(*) FROM reps) / (coalesce(s, 0) + 10), 9), -size, idx) - 1 AS rank "
    "FROM reps LEFT JOIN (SELECT src, sum(1 / (d + 0.1::DOUBLE)) AS s FROM e GROUP BY src) ON src = rep)"
)
_EBURST = """h AS (SELECT src, CAST(floor(d) AS BIGINT) AS bin, count(*) AS n FROM e GROUP BY 1, 2), hb AS (SELECT rep, unnest(range(1, (SELECT max(bin) FROM h) + 1)) AS bin FROM reps),
k AS (SELECT rep, list(-coalesce(n, 0) ORDER BY hb.bin) AS key FROM hb LEFT JOIN h ON h.src = hb.rep AND h.bin = hb.bin GROUP BY rep),
r AS (SELECT reps.rep, idx, size, row_number() OVER (ORDER BY list_append(key, -(coalesce(n, 0) + 1 + size)), idx) - 1 AS rank FROM reps JOIN k ON k.rep = reps.rep LEFT JOIN h ON h.src = reps.rep AND h.bin = 0)"""


@register("rank_harmonic", f"WITH {views.P1}, {views.REPS}, {_DIRECTED}, {_HARMONIC} SELECT rep, CAST(rank AS INT) AS rank FROM r")
def _harmonic(spark, sf_dir):
    return rank.ranks(mst.ready(views.events_profile(spark, sf_dir)), DistanceSpec("asymmetric"), "harmonic")


@register("rank_eburst", f"WITH {views.P2}, {views.REPS}, {_PAIRS}, {_EBURST} SELECT rep, CAST(rank AS INT) AS rank FROM r")
def _eburst(spark, sf_dir):
    return rank.ranks(mst.ready(views.orders_profile(spark, sf_dir)), DistanceSpec(), "eBurst")


def _minimax(steps: int, scale: int = 1) -> str:
    """CTEs: an edge is in the tree where its place among all edges is the least possible largest place on a path between its ends."""
    out = [(
        f"o AS (SELECT a.idx AS i, b.idx AS j, e.src AS u, e.dst AS v, round_even(d * {scale}, 0) AS len, row_number() OVER (ORDER BY round_even(d * {scale}, 0), least(a.rank, "
        "b.rank), a.idx, b.idx) AS w FROM e JOIN r a ON a.rep = e.src JOIN r b ON b.rep = e.dst WHERE a.idx < b.idx)"
    )]
    out.append("m0 AS (SELECT i, j, w FROM o UNION ALL SELECT j, i, w FROM o UNION ALL SELECT idx, idx, 0 FROM reps)")
    out += [f"m{k} AS MATERIALIZED (SELECT a.i, b.j, min(greatest(a.w, b.w)) AS w FROM m{k - 1} a JOIN m{k - 1} b ON a.j = b.i GROUP BY 1, 2)" for k in range(1, steps + 1)]
    return ", ".join(out) + f", t AS (SELECT o.u, o.v, o.len FROM o JOIN m{steps} m ON m.i = o.i AND m.j = o.j AND m.w = o.w)"


@register("mst_edges", f"WITH {views.P1}, {views.REPS}, {_PAIRS}, {_EBURST}, {_minimax(8)} SELECT least(u, v) AS u, greatest(u, v) AS v, CAST(len AS BIGINT) AS length FROM t")
def _mst(spark, sf_dir):
    return _mst_table(spark, sf_dir)[1]


_BLOCKWISE = (
    "x AS (SELECT a.sid AS src, b.sid AS dst, a.locus, a.allele - b.allele AS delta, lag(a.allele - b.allele, 1, 0) OVER (PARTITION BY a.sid, b.sid ORDER BY a.locus) AS before "
    "FROM p a JOIN p b ON a.locus = b.locus WHERE a.sid <> b.sid), "
    "e AS (SELECT src, dst, count(*) FILTER (delta <> 0 AND delta <> before) + 0.01::DOUBLE * (count(*) FILTER (delta <> 0) - count(*) FILTER (delta <> 0 AND delta <> before)) AS d FROM x GROUP BY 1, 2)"
)


@register("mst_blockwise_edges", f"WITH {views.P1}, {views.REPS}, {_BLOCKWISE}, {_EBURST}, {_minimax(8, 10000)} SELECT least(u, v) AS u, greatest(u, v) AS v, len / 10000.0::DOUBLE AS length FROM t")
def _mst_blockwise(spark, sf_dir):
    """The spanning tree of blockwise distances, compared to four digits."""
    nodes, spec = mst.ready(views.events_profile(spark, sf_dir)), DistanceSpec("blockwise")
    ranks = written(rank.ranks(nodes, spec, "eBurst"), "ranks").df
    found = mst.spanning_tree(mst.block_forests(nodes, ranks, spec, 10000))
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), (F.col("key.r") / 10000).alias("length"))


def _mst_table(spark, sf_dir):
    nodes = mst.ready(views.events_profile(spark, sf_dir))
    ranks = written(rank.ranks(nodes, DistanceSpec(), "eBurst"), "ranks").df
    found = mst.spanning_tree(mst.block_forests(nodes, ranks, DistanceSpec()))
    return nodes, found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("key.r").alias("length"))


@register("link_lengths", (
    f"WITH {views.P1}, {views.REPS}, {_PAIRS}, {_EBURST}, {_minimax(8)} SELECT least(u, v) AS src, greatest(u, v) AS dst, {_DIFFER} AS length FROM t "
    f"JOIN p a ON a.sid = u JOIN p b ON b.sid = v AND a.locus = b.locus GROUP BY u, v"
))
def _links(spark, sf_dir):
    nodes, edges = _mst_table(spark, sf_dir)
    return distance.link_lengths(edges.select(F.col("u").alias("src"), F.col("v").alias("dst")), nodes)


@register(
    "rooted_nodes",
    f"""WITH RECURSIVE {views.P1}, {views.REPS}, {_PAIRS}, {_EBURST}, {_minimax(8)}, b AS (SELECT u, v, len FROM t UNION ALL SELECT v, u, len FROM t),
s(node, parent, length, depth) AS (SELECT (SELECT min(rep) FROM reps), NULL::BIGINT, 0.0::DOUBLE, 0 UNION ALL SELECT b.v, b.u, CAST(b.len AS DOUBLE), s.depth + 1 FROM s JOIN b ON b.u = s.node WHERE s.parent IS NULL OR b.v <> s.parent) SELECT node, parent, length, depth FROM s""",
)
def _rooted(spark, sf_dir):
    nodes, edges = _mst_table(spark, sf_dir)
    root = nodes.agg(F.min("rep")).first()[0]
    return tree.root_frame(edges.withColumn("length", F.col("length").cast("double")), root)


@register(
    "shortcuts",
    f"""WITH {views.P2}, {views.REPS}, {_DIRECTED}, {_HARMONIC}, c AS (SELECT e.src, e.dst, a.rank, d + a.rank / CAST((SELECT count(*) FROM reps) AS DOUBLE) AS cost FROM e JOIN r a ON a.rep = e.src JOIN r b ON b.rep = e.dst WHERE d < 3 AND a.rank < b.rank)
SELECT src, dst, CAST(floor(cost) AS BIGINT) AS length FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY cost, rank) AS k FROM c) WHERE k = 1""",
)
def _shortcuts(spark, sf_dir):
    nodes, spec = mst.ready(views.orders_profile(spark, sf_dir)), DistanceSpec("asymmetric")
    n = nodes.count()
    ranks = written(rank.ranks(nodes, spec, "harmonic"), "ranks").df
    return mst.shortcuts(near.best_sources(nodes, ranks, spec, kernels.cutoff(n) + 1), ranks, n)


_NEAR = f"WITH {views.P1}, {views.REPS} SELECT a.sid AS src, b.sid AS dst, CAST(count(*) FILTER (a.allele <> b.allele) AS DOUBLE) AS d FROM p a JOIN p b ON a.locus = b.locus WHERE a.sid < b.sid GROUP BY 1, 2 HAVING count(*) FILTER (a.allele <> b.allele) < 14"


@register("near_pairs", _NEAR)
def _near(spark, sf_dir):
    """Profiles that differ at 13 of 24 loci at most."""
    return near.near_pairs(_reps(views.events_profile(spark, sf_dir)), DistanceSpec(missing="as_allele"), 14)


@register(
    "near_targets",
    f"WITH {views.P1}, {views.REPS}, {_DIRECTED} SELECT dst, count(*) AS n, round(min(d), 6) AS nearest FROM e WHERE d < 13 GROUP BY dst",
)
def _near_targets(spark, sf_dir):
    """How many sources a profile has at a directed distance below 13, and how far the nearest is."""
    found = near.near_counts(_reps(views.events_profile(spark, sf_dir)), DistanceSpec("asymmetric"), 13)
    return found.select("dst", "n", F.round("nearest", 6).alias("nearest"))


@register(
    "rooted_tree",
    f"""WITH RECURSIVE {views.P1}, {views.REPS}, {_PAIRS}, {_EBURST}, {_minimax(8)}, x AS (SELECT least(u, v) AS u, greatest(u, v) AS v, len FROM t), b AS (SELECT u, v, len FROM x UNION ALL SELECT v, u, len FROM x),
s(node, parent, length) AS (SELECT (SELECT u FROM x ORDER BY len DESC, u, v LIMIT 1), NULL::BIGINT, 0.0::DOUBLE UNION ALL SELECT b.v, b.u, CAST(b.len AS DOUBLE) FROM s JOIN b ON b.u = s.node WHERE s.parent IS NULL OR b.v <> s.parent),
i AS (SELECT DISTINCT parent AS node FROM s WHERE parent IS NOT NULL)
SELECT CAST(s.node AS VARCHAR) AS node, CAST(parent AS VARCHAR) AS parent, CASE WHEN i.node IS NULL THEN CAST(s.node AS VARCHAR) END AS name, length FROM s LEFT JOIN i ON i.node = s.node
UNION ALL SELECT 'leaf_' || CAST(node AS VARCHAR), CAST(node AS VARCHAR), CAST(node AS VARCHAR), 0.0::DOUBLE FROM i""",
)
def _rooted_tree(spark, sf_dir):
    """The tree as it is written: rooted at the source of the longest edge, inner samples with a leaf of length 0."""
    edges = _mst_table(spark, sf_dir)[1].withColumn("length", F.col("length").cast("double"))
    edges = written(edges, "edges").df
    longest = edges.orderBy(F.desc("length"), "u", "v").first()
    return tree.shown_nodes(tree.root_frame(edges, longest["u"]))


@register(
    "mstree_v2_checks",
    f"WITH {views.P1}, {views.REPS} SELECT count(*) - 1 AS n_edges, count(*) AS n_nodes, 1 AS n_roots, 0 AS n_wrong_lengths FROM reps",
)
def _mstree_v2_checks(spark, sf_dir):
    """What holds of every directed tree: one root, each node once, and the lengths of the edges between profiles."""
    from cladewise.model import TreeSpec

    packed = views.events_profile(spark, sf_dir)
    _, edges = mst.tree_edges(packed, TreeSpec())
    found = spark.createDataFrame([(s, t, float(x)) for s, t, x in edges], "src long, dst long, length double")
    ends = found.select(F.col("src").alias("node")).union(found.select("dst")).distinct()
    # The pieces that the edges join the nodes to.
    whole = components.components(ends, found, "node").agg(F.count_distinct("component").alias("n_roots"), F.count("*").alias("n_nodes"))
    cells = profile.unpack(packed)
    side = lambda end: cells.select(F.col("sample").alias(end), "locus", F.col("allele").alias(f"{end}_allele"))
    both = found.join(side("src"), "src").join(side("dst"), ["dst", "locus"])
    wrong = both.groupBy("src", "dst", "length").agg(F.count(F.when(F.expr("src_allele > 0 and dst_allele > 0 and src_allele <> dst_allele"), 1)).alias("n")).filter("n <> length")
    return found.agg(F.count("*").alias("n_edges")).crossJoin(whole).crossJoin(wrong.agg(F.count("*").alias("n_wrong_lengths"))).select("n_edges", "n_nodes", "n_roots", "n_wrong_lengths")


def _leaves_of(name: str, method: str) -> None:
    @register(name, f"WITH {views.P1} SELECT CAST(sid AS VARCHAR) AS name, 1 AS n FROM (SELECT DISTINCT sid FROM cells)")
    def query(spark, sf_dir):
        """Every sample is a leaf of the written tree, once."""
        from cladewise.backend import tree_text
        from cladewise.model import TreeSpec

        nodes = trees.read_tree(spark, tree_text(views.events_profile(spark, sf_dir), TreeSpec(method)))
        return nodes.filter("name is not null").groupBy("name").agg(F.count("*").alias("n"))


_leaves_of("newick_leaves", "MSTree")
_leaves_of("nj_leaves", "NJ")


@register("mstree_v2_edges")
def _mstree_v2(spark, sf_dir):
    """Directed tree with moved branches: steps depend on each other, tested against brute force."""
    from cladewise.model import TreeSpec

    _, edges = mst.tree_edges(views.events_profile(spark, sf_dir), TreeSpec())
    return spark.createDataFrame([(s, t, float(x)) for s, t, x in edges], "src long, dst long, length double")


@register("nj_tree")
def _nj(spark, sf_dir):
    """Neighbour joining of the events profile, as text."""
    from cladewise.backend import tree_text
    from cladewise.model import TreeSpec

    return spark.createDataFrame([(tree_text(views.events_profile(spark, sf_dir), TreeSpec("NJ")),)], "newick string")


@register("newick_tree")
def _newick(spark, sf_dir):
    """The spanning tree of the events profile, as text."""
    from cladewise.backend import tree_text
    from cladewise.model import TreeSpec

    return spark.createDataFrame([(tree_text(views.events_profile(spark, sf_dir), TreeSpec("MSTree")),)], "newick string")


# ---- tree tables
_CLIMB = (
    f"WITH RECURSIVE {views.TREE}, g(node_id, top, go) AS (SELECT node_id, node_id, coalesce(length <= 1, false) FROM tree UNION ALL SELECT g.node_id, "
    f"t.parent_id, coalesce(u.length <= 1, false) FROM g JOIN tree t ON t.node_id = g.top JOIN tree u ON u.node_id = t.parent_id WHERE g.go), "
    f"groups AS (SELECT node_id, top AS group_id FROM g WHERE NOT go)"
)


@register("collapse_groups", f"{_CLIMB} SELECT node_id, group_id FROM groups")
def _collapse(spark, sf_dir):
    return tree.collapse(views.tree(spark, sf_dir), 1.0)


@register("quotient_links", (
    f"{_CLIMB} SELECT DISTINCT a.group_id AS source, b.group_id AS target, t.length AS value FROM tree t JOIN groups a ON a.node_id = t.parent_id "
    f"JOIN groups b ON b.node_id = t.node_id WHERE a.group_id <> b.group_id"
))
def _quotient(spark, sf_dir):
    nodes = views.tree(spark, sf_dir)
    return tree.quotient(nodes, tree.collapse(nodes, 1.0))


@register(
    "group_labels",
    f"""{_CLIMB} SELECT group_id, CASE WHEN bool_or(t.node_id = group_id AND NOT is_hypo) THEN group_id ELSE coalesce(arg_max(t.node_id, ord) FILTER (NOT is_hypo), group_id) END AS label, count(*) FILTER (NOT is_hypo) AS size
FROM groups JOIN tree t ON t.node_id = groups.node_id GROUP BY group_id""",
)
def _labels(spark, sf_dir):
    nodes = views.tree(spark, sf_dir)
    return tree.group_labels(nodes, tree.collapse(nodes, 1.0))


@register(
    "subtree_keep",
    f"""WITH RECURSIVE {views.TREE}, live(node_id) AS (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT t.parent_id FROM live JOIN tree t ON t.node_id = live.node_id WHERE t.parent_id IS NOT NULL),
n AS (SELECT t.node_id, t.parent_id, coalesce(t.length, 0.0::DOUBLE) AS length, t.is_hypo, (SELECT count(*) FROM live l JOIN tree c ON c.node_id = l.node_id WHERE c.parent_id = t.node_id) AS kids FROM tree t JOIN live ON live.node_id = t.node_id),
c(node_id, parent_id, length, is_hypo) AS (SELECT node_id, parent_id, length, is_hypo FROM n WHERE NOT (is_hypo AND kids <= 1) UNION ALL SELECT c.node_id, n.parent_id, c.length + n.length, c.is_hypo FROM c JOIN n ON n.node_id = c.parent_id WHERE n.is_hypo AND n.kids <= 1)
SELECT c.node_id, c.parent_id, CASE WHEN c.parent_id IS NOT NULL THEN c.length END AS length, c.is_hypo FROM c LEFT JOIN n ON n.node_id = c.parent_id WHERE n.node_id IS NULL OR NOT (n.is_hypo AND n.kids <= 1)""",
)
def _subtree(spark, sf_dir):
    nodes = views.tree(spark, sf_dir)
    chosen = views.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"))
    return tree.induced(nodes, nodes.join(chosen, "node_id", "left_semi"))


@register("link_extent", f"WITH {views.TREE} SELECT max(greatest(length, 0)) AS longest, min(greatest(length, 0)) AS shortest, count(*) AS n FROM tree WHERE parent_id IS NOT NULL")
def _extent(spark, sf_dir):
    links = views.tree(spark, sf_dir).filter("parent_id is not null").select(tree.clean_length(F.col("length")).alias("value"))
    return links.agg(F.max("value").alias("longest"), F.min("value").alias("shortest"), F.count("*").alias("n"))


@register("shown_links", f"WITH {views.TREE} SELECT node_id, least(length, 3.0::DOUBLE) AS shown, length > 3 AS dashed, length >= 5 AS hidden FROM tree WHERE parent_id IS NOT NULL")
def _shown(spark, sf_dir):
    links = views.tree(spark, sf_dir).filter("parent_id is not null").select("node_id", tree.clean_length(F.col("length")).alias("value"))
    return tree.shown_links(links, 3.0, 5.0).drop("value")


@register("node_radius", f"{_CLIMB} SELECT group_id, round(6 * sqrt(count(*) FILTER (NOT is_hypo)), 6) AS radius FROM groups JOIN tree t ON t.node_id = groups.node_id GROUP BY group_id")
def _radius(spark, sf_dir):
    nodes = views.tree(spark, sf_dir)
    groups = tree.group_labels(nodes, tree.collapse(nodes, 1.0))
    return groups.select("group_id", F.round(tree.radius(F.col("size"), F.col("size") == 0), 6).alias("radius"))


@register("rectangle_selection", (
    "SELECT vec_id AS node_id FROM embeddings WHERE CAST(embedding[1] AS DOUBLE) >= -0.1 AND CAST(embedding[1] AS DOUBLE) < 0.1 "
    "AND CAST(embedding[2] AS DOUBLE) >= 0.0 AND CAST(embedding[2] AS DOUBLE) < 0.2"
))
def _rectangle(spark, sf_dir):
    """Nodes in a rectangle of a layout that is written by a space-filling key."""
    at = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    path = room(spark, "layout")
    zorder.write_layout(at, path)
    return zorder.read_rectangle(spark, path, -0.1, 0.0, 0.1, 0.2).select("node_id")


# ---- metadata
@register("category_counts", f"WITH {views.META} SELECT nation AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, nation) AS place FROM meta GROUP BY nation HAVING count(*) >= 2")
def _categories(spark, sf_dir):
    return metadata.category_counts(views.metadata(spark, sf_dir), CategorySpec("nation", least=2), views.tree(spark, sf_dir))


@register(
    "category_topk_others",
    (
        f"WITH {views.META}, c AS (SELECT balance AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(balance AS DOUBLE), "
        f"balance) AS place FROM meta GROUP BY balance) SELECT CASE WHEN place <= 30 THEN value ELSE 'Others' END AS value, CAST(sum(n) AS BIGINT) AS n FROM c "
        f"GROUP BY 1"
    ),
)
def _topk(spark, sf_dir):
    counts = metadata.category_counts(views.metadata(spark, sf_dir), CategorySpec("balance", numeric=True))
    return metadata.top_and_others(counts, 30).select("value", "n")


@register("node_composition", (
    f"{_CLIMB}, {views.META} SELECT group_id, coalesce(segment, 'missing') AS value, count(*) AS n FROM groups JOIN tree t ON t.node_id = groups.node_id "
    f"LEFT JOIN meta ON meta.ID = groups.node_id WHERE NOT is_hypo GROUP BY 1, 2"
))
def _composition(spark, sf_dir):
    nodes = views.tree(spark, sf_dir)
    members = tree.collapse(nodes, 1.0).join(nodes.filter("not is_hypo").select("node_id"), "node_id", "left_semi")
    return metadata.composition(members, views.metadata(spark, sf_dir), "segment")


@register("node_labels", f"WITH {views.TREE}, {views.META} SELECT t.node_id, coalesce(nation, 'ND') AS label FROM tree t LEFT JOIN meta ON ID = node_id")
def _node_labels(spark, sf_dir):
    return metadata.node_labels(views.tree(spark, sf_dir), views.metadata(spark, sf_dir), "nation", "ord")


@register("search_nodes", (
    f"WITH {views.META} SELECT DISTINCT ID FROM meta WHERE regexp_matches(segment, '^build', 'i') OR regexp_matches(nation, '^build', 'i') "
    f"OR regexp_matches(ID, '^build', 'i') OR regexp_matches(balance, '^build', 'i')"
))
def _search(spark, sf_dir):
    return metadata.search(views.metadata(spark, sf_dir), "^build")


@register("column_filter", f"WITH {views.META} SELECT ID, segment, nation FROM meta WHERE regexp_matches(segment, 'mach', 'i') AND regexp_matches(nation, 'n', 'i')")
def _filter(spark, sf_dir):
    return metadata.column_filter(views.metadata(spark, sf_dir), {"segment": "mach", "nation": "N", "ID": "("}).select("ID", "segment", "nation")


@register("typed_sort", f"WITH {views.META} SELECT ID, row_number() OVER (ORDER BY CAST(balance AS DOUBLE) DESC, balance DESC, ID) AS place FROM meta")
def _sort(spark, sf_dir):
    return metadata.reindexed(views.metadata(spark, sf_dir), metadata.typed_order("balance", True, "ID")).select("ID", "place")


@register(
    "metadata_upsert",
    (
        f"WITH {views.META}, old AS (SELECT ID, segment, nation FROM meta WHERE ord % 3 <> 0), new AS (SELECT ID, CASE "
        f"WHEN ord % 2 = 0 THEN 'NEW' END AS segment, balance FROM meta WHERE ord % 3 <> 1) SELECT coalesce(new.ID, old.ID) AS ID, coalesce(new.segment, "
        f"old.segment) AS segment, old.nation, new.balance, coalesce(new.ID, old.ID) AS \"__Node\" FROM old FULL JOIN new ON new.ID = old.ID"
    ),
)
def _upsert(spark, sf_dir):
    rows = views.metadata(spark, sf_dir)
    return metadata.upsert(rows.filter("ord % 3 <> 0").select("ID", "segment", "nation"), rows.filter("ord % 3 <> 1").select("ID", F.when(F.col("ord") % 2 == 0, "NEW").alias("segment"), "balance"))


@register("date_extent", (
    "WITH d AS (SELECT CAST(ts AS DATE) AS d FROM events) SELECT min(d) AS first, max(d) AS last, count(*) FILTER (d IS NULL) AS n_undated, "
    "min(d) + CAST(floor((max(d) - min(d)) / 2) AS INT) AS middle FROM d"
))
def _dates(spark, sf_dir):
    return metadata.date_extent(views.table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("d")), "d")


@register("whole_numbers", (
    "SELECT p_partkey, CASE WHEN regexp_extract(p_name || ' ' || p_brand, '(-*\\d+)', 1) IN ('') OR regexp_extract(p_name || ' ' || p_brand, '(-*\\d+)', "
    "1) LIKE '-%' THEN '' ELSE regexp_extract(p_name || ' ' || p_brand, '(-*\\d+)', 1) END AS number FROM part"
))
def _numbers(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", metadata.whole_number(F.concat_ws(" ", "p_name", "p_brand")).alias("number"))


@register("replaced_range", (
    f"WITH {views.META}, n AS (SELECT *, row_number() OVER (ORDER BY ord) AS place FROM meta) SELECT ID, place, CASE WHEN place BETWEEN 5 AND 20 THEN 'X' "
    f"ELSE segment END AS segment FROM n"
))
def _replaced(spark, sf_dir):
    rows = metadata.reindexed(views.metadata(spark, sf_dir), [F.col("ord").asc()])
    return metadata.replace_range(rows, "X", 5, 20, ["segment"]).select("ID", "place", "segment")


# ---- grid
@register(
    "group_totals",
    """SELECT CASE WHEN grouping(l_linestatus) = 1 THEN 0 ELSE 1 END AS level, l_returnflag || CASE WHEN grouping(l_linestatus) = 1 THEN '' ELSE ':|:' || l_linestatus END AS group_key, count(*) AS n, round(avg(l_quantity), 6) AS avg_l_quantity, round(sum(l_quantity), 2) AS sum_l_quantity, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) HAVING grouping(l_returnflag) = 0""",
)
def _totals(spark, sf_dir):
    rows = grid.group_levels(views.table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"l_quantity": ("avg", "sum", "min", "max")})
    return rows.select("level", "group_key", "n", F.round("avg_l_quantity", 6).alias("avg_l_quantity"), F.round("sum_l_quantity", 2).alias("sum_l_quantity"), "min_l_quantity", "max_l_quantity")


@register("grouped_levels", (
    "SELECT CAST(l AS INT) AS level, key AS group_key, id, row_number() OVER (ORDER BY s, l >= 1, p, l > 1, k) AS place FROM (SELECT 0 AS l, "
    "o_orderstatus AS key, NULL AS id, o_orderstatus AS s, NULL AS p, NULL AS k FROM orders GROUP BY o_orderstatus UNION ALL SELECT 1, "
    "o_orderstatus || ':|:' || o_orderpriority, NULL, o_orderstatus, o_orderpriority, NULL FROM orders GROUP BY o_orderstatus, o_orderpriority UNION ALL "
    "SELECT 2, o_orderstatus || ':|:' || o_orderpriority, CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority, o_orderkey FROM orders)"
))
def _levels(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    return grid.flattened(rows, ["o_orderstatus", "o_orderpriority"], ["id"])


@register("page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _page(spark, sf_dir):
    return grid.page(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 25)


@register("row_diff", (
    "SELECT coalesce(a.o_orderkey, b.k) AS place FROM (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE "
    "WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0) b ON a.o_orderkey = b.k "
    "WHERE a.o_orderstatus IS DISTINCT FROM b.s"
))
def _diff(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_orderstatus").alias("s"))
    return grid.row_diff(rows.filter("place % 5 <> 0"), rows.filter("place % 11 <> 0").withColumn("s", F.when(F.col("place") % 7 == 0, "X").otherwise(F.col("s"))))


@register("bad_ids", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 OR l_orderkey IS NULL")
def _bad(spark, sf_dir):
    return grid.bad_ids(views.table(spark, sf_dir, "lineitem"), "l_orderkey")


@register("grid_edits", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'U' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 9 <> 0")
def _edits(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    changed = grid.update(rows, rows.filter("o_orderkey % 4 = 0").withColumn("status", F.lit("U")), "o_orderkey")
    return grid.delete(changed, rows.filter("o_orderkey % 9 = 0"), "o_orderkey")


# ---- evaluation
_QUARTETS = """l AS (SELECT n_nationkey AS k, n_regionkey AS t, n_nationkey % 4 AS f FROM nation), q AS (SELECT a.k AS a, b.k AS b, c.k AS c, d.k AS d, a.t AS a_t, b.t AS b_t, c.t AS c_t, d.t AS d_t, a.f AS a_f, b.f AS b_f, c.f AS c_f, d.f AS d_f FROM l a JOIN l b ON a.k < b.k JOIN l c ON b.k < c.k JOIN l d ON c.k < d.k)"""


def _pairing(x: str) -> str:
    a, b, c, d = (f"{k}_{x}" for k in "abcd")
    two = lambda p, q, r, s: f"(({p} = {q} AND {r} <> {p} AND {s} <> {p}) OR ({r} = {s} AND {p} <> {r} AND {q} <> {r}))"
    return f"CASE WHEN {two(a, b, c, d)} THEN 'ab|cd' WHEN {two(a, c, b, d)} THEN 'ac|bd' WHEN {two(a, d, b, c)} THEN 'ad|bc' END"


def _clades(spark, sf_dir, group):
    return views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("leaf"), group.cast("string").alias("clade"))


def _splits(spark, sf_dir, group):
    leaves = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("leaf"))
    return evaluate.splits(_clades(spark, sf_dir, group), leaves)


@register("quartet_splits", f"WITH {_QUARTETS}, s AS (SELECT a, b, c, d, {_pairing('t')} AS pairing FROM q) SELECT * FROM s WHERE pairing IS NOT NULL")
def _quartet_splits(spark, sf_dir):
    return _splits(spark, sf_dir, F.col("n_regionkey"))


@register("quartet_classes", (
    f"WITH {_QUARTETS}, s AS (SELECT a, b, c, d, {_pairing('t')} AS pairing, a_t, b_t, c_t, d_t FROM q) SELECT a, b, c, d, CASE WHEN (a_t = b_t "
    f"AND c_t = d_t) OR (a_t = c_t AND b_t = d_t) OR (a_t = d_t AND b_t = c_t) THEN 'balanced' ELSE 'unbalanced' END AS kind FROM s "
    f"WHERE pairing IS NOT NULL"
))
def _classes(spark, sf_dir):
    leaves = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("leaf"))
    return evaluate.balanced(_clades(spark, sf_dir, F.col("n_regionkey")), leaves)


_FLAGS = (
    f"{_QUARTETS}, s AS (SELECT a, b, c, d, {_pairing('t')} AS x, {_pairing('f')} AS y FROM q), z AS (SELECT a, b, c, d, CASE WHEN y = x THEN 1 "
    f"ELSE 0 END AS tp, CASE WHEN y <> x THEN 1 ELSE 0 END AS fp, CASE WHEN y IS NULL OR y <> x THEN 1 ELSE 0 END AS fn FROM s WHERE x IS NOT NULL)"
)
_RATIOS = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, " + ", ".join(
    f"CASE WHEN {below} > 0 THEN round({above} / ({below})::DOUBLE, 9) ELSE -1 END AS {name}"
    for name, above, below in (
        ("precision", "sum(tp)", "sum(tp + fp)"),
        ("sensitivity", "sum(tp)", "sum(tp + fn)"),
        ("f1", "sum(2 * tp)", "sum(2 * tp + fn + fp)"),
        ("f05", "sum(1.25 * tp)", "sum(1.25 * tp + 0.25 * fn + fp)"),
        ("f2", "sum(5 * tp)", "sum(5 * tp + 4 * fn + fp)"),
        ("accuracy", "sum(tp)", "sum(tp + fp + fn)"),
    )
)


def _flags(spark, sf_dir):
    return evaluate.compare(_splits(spark, sf_dir, F.col("n_regionkey")), _splits(spark, sf_dir, F.col("n_nationkey") % 4))


def _rounded(rows, by):
    names = ("precision", "sensitivity", "f1", "f05", "f2", "accuracy")
    return evaluate.scores(rows, by).select(*by, "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in names])


@register("quartet_stats", f"WITH {_FLAGS} SELECT 'tree' AS method, {_RATIOS} FROM z")
def _stats(spark, sf_dir):
    return _rounded(_flags(spark, sf_dir).withColumn("method", F.lit("tree")), ["method"])


@register("binned_precision", (
    f"WITH {_FLAGS} SELECT CAST(CASE WHEN 10.0 * (a + b + c + d) <= 1950 THEN least(floor((10.0 * (a + b + c + d) + 50) / 100) * 100, 1900) "
    f"ELSE 2000 END AS BIGINT) AS bin, {_RATIOS} FROM z GROUP BY 1"
))
def _binned(spark, sf_dir):
    rows = _flags(spark, sf_dir).withColumn("bin", evaluate.distance_bin(10.0 * (F.col("a") + F.col("b") + F.col("c") + F.col("d"))))
    return _rounded(rows, ["bin"])


@register("chunked_sums", "SELECT CAST(floor(o_custkey / 50) AS BIGINT) AS chunk, o_orderstatus AS method, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def _chunks(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").withColumn("method", F.col("o_orderstatus")).withColumn("total", F.col("o_totalprice"))
    return evaluate.chunked_sums(rows, "o_custkey", ["method"], ["total"]).withColumn("total", F.round("total", 2))


@register("cut_means", (
    "SELECT l_returnflag AS method, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN '(0, 10]' WHEN l_quantity > 10 AND l_quantity <= 25 THEN '(10, 25]' "
    "WHEN l_quantity > 25 AND l_quantity <= 50 THEN '(25, 50]' END AS bin, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1, 2"
))
def _cut(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("method"), evaluate.right_closed_bin(F.col("l_quantity"), [0, 10, 25, 50]).alias("bin")).agg(F.round(F.avg("l_discount"), 6).alias("mean"))


@register(
    "resource_estimate",
    (
        "WITH n AS (SELECT c_custkey::DOUBLE AS n FROM customer) SELECT CAST(n AS BIGINT) AS n, "
        "round(greatest(2.431284e-6 * n * n + 2.701426667e-9 * 2000 * n * n / 5 + 33.753, 5), 6) AS seconds, greatest(103.77 * n * n + 516625000, "
        "52428800) AS bytes FROM n"
    ),
)
def _estimate(spark, sf_dir):
    seconds, size = estimate(F.col("c_custkey").cast("double"), F.lit(2000.0), "MSTree", "asymmetric", 5)
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), F.round(seconds, 6).alias("seconds"), size.alias("bytes"))
