"""Further registered queries: scans of texts made of the tables, tree and grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewise.model import DistanceSpec, TreeSpec
from cladewise.operators import distance, evaluate, grid, metadata, mst, profile, radial, search_index, sorted_view, tree
from cladewise.operators.numbering import numbered
from cladewise.plans import views
from cladewise.plans.catalog import _CLIMB, _DIFFER, _EBURST, _PAIRS, _minimax, register
from cladewise.plans.storage import room, written
from cladewise.sources import nexus, profile_files, sinks, trees

def _values(names: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({names})"


@register(
    "profile_scan",
    """WITH s AS (SELECT s_suppkey AS k, CAST(s_nationkey AS VARCHAR) AS a, CASE WHEN s_suppkey % 3 = 0 THEN '-' ELSE CAST(s_suppkey % 7 AS VARCHAR) END AS b, 'N' || CAST(s_suppkey % 4 AS VARCHAR) AS c FROM supplier)
SELECT 'S__' || CAST(k AS VARCHAR) || '_' AS sample, CAST(unnest([0, 1, 2]) AS INT) AS locus, unnest([a, b, c]) AS allele FROM s""",
)
def _profile_scan(spark, sf_dir):
    """A profile with comments, a named header, columns that are no loci, and names to be cleaned, written from the suppliers and read again."""
    head = spark.createDataFrame([("## made of the suppliers", -3), ("#Other\tX", -2), ("#Strain\tST\t#note\tL1\tL2\tL3", -1)], "line string, ord long")
    text = lambda c: F.col(c).cast("string")
    cells = [F.concat(F.lit("S ("), text("s_suppkey"), F.lit(")")), F.lit("1"), F.lit("x"), text("s_nationkey"), F.when(F.col("s_suppkey") % 3 == 0, "-").otherwise((F.col("s_suppkey") % 7).cast("string")), F.concat(F.lit("n"), (F.col("s_suppkey") % 4).cast("string"))]
    rows = views.table(spark, sf_dir, "supplier").select(F.concat_ws("\t", *cells).alias("line"), F.col("s_suppkey").alias("ord"))
    return profile_files.read_profile(spark, _text_file(head.union(rows), "profile"))


@register(
    "fasta_scan",
    """SELECT 'c' || CAST(c_custkey AS VARCHAR) AS sample, CAST(unnest(range(14)) AS INT) AS locus, unnest(string_split(upper(rpad(c_mktsegment || CAST(c_nationkey AS VARCHAR), 14, '-')), '')) AS allele FROM customer""",
)
def _fasta_scan(spark, sf_dir):
    """Aligned sequences over several lines, in small letters, written from the customers and read again."""
    letters = F.lower(F.rpad(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")), 14, "-"))
    record = F.concat(F.lit(">c"), F.col("c_custkey").cast("string"), F.lit(" a note\n"), F.substring(letters, 1, 6), F.lit("\n"), F.substring(letters, 7, 5), F.lit(" \n"), F.substring(letters, 12, 3))
    return profile_files.read_profile(spark, _text_file(views.table(spark, sf_dir, "customer").select(record.alias("line"), F.col("c_custkey").alias("ord")), "fasta"))


@register("metadata_scan", """SELECT CAST(s_nationkey AS VARCHAR) AS "ID", arg_max(s_name, s_suppkey) AS "Name", '' AS "Year", arg_max(CAST(s_suppkey AS VARCHAR), s_suppkey) AS "Last" FROM supplier GROUP BY 1""")
def _metadata_scan(spark, sf_dir):
    """A metadata file by comma, written from the suppliers and read again: of the rows of one nation the last."""
    head = spark.createDataFrame([("ID,Name,Year,Last", -1)], "line string, ord long")
    rows = views.table(spark, sf_dir, "supplier").select(F.concat_ws(",", F.col("s_nationkey").cast("string"), "s_name", F.lit(""), F.col("s_suppkey").cast("string")).alias("line"), F.col("s_suppkey").alias("ord"))
    return profile_files.read_metadata(spark, _text_file(head.union(rows), "metadata"))


_LEAVES = "c AS (SELECT c_nationkey AS tree_id, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, c_mktsegment AS segment FROM customer)"


@register(
    "newick_scan",
    f"""WITH {_LEAVES}, t AS (SELECT DISTINCT tree_id FROM c)
SELECT tree_id, '_hypo_0' AS node_id, NULL AS parent_id, NULL AS name, NULL::DOUBLE AS length, 0 AS depth, true AS is_hypo FROM t UNION ALL SELECT tree_id, '_hypo_1', '_hypo_0', NULL, 0.5::DOUBLE, 1, true FROM t
UNION ALL SELECT tree_id, 'c ' || CAST(k AS VARCHAR), '_hypo_1', 'c ' || CAST(k AS VARCHAR), (k % 7)::DOUBLE, 2, false FROM c UNION ALL SELECT tree_id, 'it''s', '_hypo_0', 'it''s', 3e-2::DOUBLE, 1, false FROM t""",
)
def _newick_scan(spark, sf_dir):
    """A Newick text for each nation, of its customers with quoted names, a support value and lengths of several forms, parsed."""
    leaf = F.concat(F.lit("'c "), F.col("c_custkey").cast("string"), F.lit("':"), (F.col("c_custkey") % 7).cast("string"))
    rows = views.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("tree_id")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", leaf.alias("leaf")))).alias("c"))
    texts = rows.select("tree_id", F.concat(F.lit("(("), F.array_join("c.leaf", ","), F.lit(")95:0.5,'it''s':3e-2)root;")).alias("text"))
    return trees.parse_trees(texts).drop("annotations")


@register(
    "nexus_scan",
    f"""WITH {_LEAVES}, t AS (SELECT DISTINCT tree_id FROM c)
SELECT tree_id, 'of [' || CAST(tree_id AS VARCHAR) || '] it''s' AS tree, true AS is_default, true AS rooted, 'c(' || CAST(k AS VARCHAR) || ') [''' || segment || ''']' AS name, (k % 7)::DOUBLE AS length, segment || ',x' AS kinds, 'a,b' AS quoted, NULL AS error FROM c
UNION ALL SELECT tree_id, 'second', false, false, 'c(' || CAST(k AS VARCHAR) || ') [''' || segment || ''']', NULL, NULL, NULL, NULL FROM c WHERE i = 1 UNION ALL SELECT tree_id, 'second', false, false, 'plain', NULL, NULL, NULL, NULL FROM t
UNION ALL SELECT tree_id + 100, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'a quote is not closed' FROM t""",
)
def _nexus_scan(spark, sf_dir):
    """A NEXUS text for each nation: quoted labels with quotes, brackets and parentheses in them, nested comments, a translation, annotations, two trees; and one that is broken off."""
    each = views.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("tree_id")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("c"))
    number = lambda x: x["c_custkey"].cast("string")
    label = lambda x: F.concat(F.lit("'c("), number(x), F.lit(") [''"), x["c_mktsegment"], F.lit("'']'"))
    joined = lambda f: F.array_join(F.transform("c", f), ",")
    leaf = lambda x: F.concat(number(x), F.lit("[&kinds={"), x["c_mktsegment"], F.lit(",x},!quoted=\"a,b\"]:"), (x["c_custkey"] % 7).cast("string"))
    text = F.concat(
        F.lit("#NEXUS\n[made [of the] customers; 'all']\nBegin taxa;\n  title 'a; b';\n  taxlabels "), F.array_join(F.transform("c", label), " "), F.lit(";\nEndBlock;\nbegin TREES;\n translate "), joined(lambda x: F.concat(number(x), F.lit(" "), label(x))),
        F.lit(";\n tree * 'of ["), F.col("tree_id").cast("string"), F.lit("] it''s' = [&R] ("), joined(leaf), F.lit(")[&p=1]:1;\n utree second=[&U](\""), number(F.element_at("c", 1)), F.lit("\",plain);\nend;\n"),
    )
    texts = each.select("tree_id", text.alias("text"))
    broken = texts.select((F.col("tree_id") + 100).alias("tree_id"), F.concat("text", F.lit("begin x; y 'z;")).alias("text"))
    rows = nexus.nexus_trees(texts.union(broken)).filter("not is_hypo or error is not null")
    note = lambda k: F.array_join(F.col("annotations")[k], ",").alias(k)
    return rows.select("tree_id", "tree", "is_default", "rooted", "name", "length", note("kinds"), note("quoted"), "error")


_FIRST = "string_split(substr(text, 1, 2048), chr(10))[1]"


@register(
    "format_sniffing",
    f"""WITH t AS (SELECT doc_id AS id, 'document' AS origin, text FROM documents UNION ALL SELECT page_id, 'page', html FROM pages UNION ALL SELECT c_custkey, 'row', CASE c_custkey % 4 WHEN 0 THEN '>' || c_name WHEN 1 THEN '#Strain' || chr(9) || c_name WHEN 2 THEN c_name || ',' || c_mktsegment ELSE '(' || c_name || ',x);' END || chr(10) || 'a,b' FROM customer)
SELECT origin, id, CASE WHEN starts_with({_FIRST}, '>') OR (starts_with({_FIRST}, '#') AND NOT starts_with(upper({_FIRST}), '#NEXUS')) THEN 'profile'
  WHEN (contains({_FIRST}, ',') OR contains({_FIRST}, chr(9))) AND substr({_FIRST}, 1, 1) NOT IN ('(', '[', ' ', '{{') THEN 'metadata' ELSE 'tree' END AS kind FROM t WHERE text IS NOT NULL""",
)
def _sniff(spark, sf_dir):
    """What the texts of the tables would be read as."""
    key, name = F.col("c_custkey"), F.col("c_name")
    row = F.when(key % 4 == 0, F.concat(F.lit(">"), name)).when(key % 4 == 1, F.concat(F.lit("#Strain\t"), name)).when(key % 4 == 2, F.concat(name, F.lit(","), "c_mktsegment")).otherwise(F.concat(F.lit("("), name, F.lit(",x);")))
    texts = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("origin"), "text").union(views.table(spark, sf_dir, "pages").select("page_id", F.lit("page"), "html"))
    texts = texts.union(views.table(spark, sf_dir, "customer").select("c_custkey", F.lit("row"), F.concat(row, F.lit("\na,b"))))
    return texts.filter("text is not null").select("origin", "id", profile_files.format_of(F.col("text")).alias("kind"))


@register(
    "project_document",
    f"""WITH {views.TREE}, t AS (SELECT t.*, CASE WHEN t.depth = 3 THEN t.parent_id ELSE t.node_id END AS tree_id FROM tree t WHERE t.depth >= 2),
l AS (SELECT tree_id, list({{'source': parent_id, 'target': node_id, 'distance': length}} ORDER BY parent_id, node_id) AS links FROM t WHERE depth = 3 GROUP BY 1)
SELECT t.tree_id, CAST(to_json({{'nodes': list(node_id ORDER BY node_id), 'links': coalesce(any_value(links), [])}}) AS VARCHAR) AS project FROM t LEFT JOIN l ON l.tree_id = t.tree_id GROUP BY t.tree_id""",
)
def _project(spark, sf_dir):
    """A project document for each nation with its customers."""
    nodes = views.tree(spark, sf_dir).filter("depth >= 2").withColumn("tree_id", F.when(F.col("depth") == 3, F.col("parent_id")).otherwise(F.col("node_id")))
    return sinks.projects(nodes.withColumn("parent_id", F.when(F.col("depth") == 3, F.col("parent_id"))), "tree_id")


@register("descendants", (
    f"WITH RECURSIVE {views.TREE}, d(top_id, node_id) AS (SELECT node_id, node_id FROM tree WHERE depth = 1 UNION ALL SELECT d.top_id, t.node_id FROM d "
    f"JOIN tree t ON t.parent_id = d.node_id) SELECT * FROM d"
))
def _descendants(spark, sf_dir):
    nodes = views.tree(spark, sf_dir)
    return tree.descendants(nodes, nodes.filter("depth = 1"))


_BUILDING = "k AS (SELECT 'c' || c_custkey AS node_id FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1)"


def _building(spark, sf_dir):
    """Customers of a market segment and nations of a region, as nodes."""
    leaves = views.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"))
    return leaves.union(views.table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))


@register("tagged_nodes", (
    f"WITH RECURSIVE {views.TREE}, {_BUILDING}, d(node_id) AS (SELECT t.node_id FROM tree t JOIN k ON k.node_id = t.parent_id UNION SELECT t.node_id FROM d "
    f"JOIN tree t ON t.parent_id = d.node_id) SELECT node_id, node_id IN (SELECT node_id FROM d) AS tagged FROM tree"
))
def _tagged(spark, sf_dir):
    """Nodes below the chosen ones."""
    return tree.tagged(views.tree(spark, sf_dir), _building(spark, sf_dir)).select("node_id", "tagged")


@register("tracked_links", (
    f"WITH RECURSIVE {views.TREE}, {_BUILDING}, u(node_id) AS (SELECT node_id FROM k UNION SELECT t.parent_id FROM u JOIN tree t ON t.node_id = u.node_id "
    f"WHERE t.parent_id IS NOT NULL) SELECT t.parent_id AS source, t.node_id AS target FROM tree t JOIN u ON u.node_id = t.node_id WHERE t.parent_id IS NOT NULL"
))
def _tracked(spark, sf_dir):
    """Links on the ways from the chosen nodes to the root."""
    return tree.tracked(views.tree(spark, sf_dir), _building(spark, sf_dir))


@register("highlighted_groups", f"{_CLIMB}, {_BUILDING} SELECT group_id, bool_or(node_id IN (SELECT node_id FROM k)) AS highlighted FROM groups GROUP BY group_id")
def _highlighted(spark, sf_dir):
    """Collapsed groups of which a member is chosen."""
    return tree.highlighted(tree.collapse(views.tree(spark, sf_dir), 1.0), _building(spark, sf_dir).withColumnRenamed("node_id", "id"))


@register("all_ids", f"WITH {views.TREE} SELECT node_id FROM tree WHERE NOT is_hypo")
def _all_ids(spark, sf_dir):
    return tree.all_ids(views.tree(spark, sf_dir))


@register("find_links", f"WITH {views.TREE} SELECT parent_id AS source, node_id AS target, length AS value FROM tree WHERE node_id IN ('n3', 'n4') AND (node_id = 'n4' OR parent_id = 'r1')")
def _find(spark, sf_dir):
    links = views.tree(spark, sf_dir).filter("parent_id is not null").select(F.col("parent_id").alias("source"), F.col("node_id").alias("target"), F.col("length").alias("value"))
    return tree.find_links(links, spark.createDataFrame([("r1", "n3"), (None, "n4")], "source string, target string"))


@register("scaled_links", (
    f"WITH {views.TREE} SELECT node_id, round(length / 6 * 100, 6) AS linear, CASE WHEN length <= 0 THEN 0.0::DOUBLE ELSE round(ln(greatest(length, "
    f"1)) / ln(6) * 100, 6) END AS log FROM tree WHERE parent_id IS NOT NULL"
))
def _scaled(spark, sf_dir):
    links = views.tree(spark, sf_dir).filter("parent_id is not null")
    return links.select("node_id", F.round(tree.scaled(F.col("length"), 1.0, 6.0, 100.0), 6).alias("linear"), F.round(tree.scaled(F.col("length"), 1.0, 6.0, 100.0, True), 6).alias("log"))


@register(
    "fitted_layout",
    """WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p), k AS (SELECT *, least(800 / (x1 - x0), 600 / (y1 - y0)) AS k FROM b)
SELECT vec_id AS node_id, round((x - (x0 + x1) / 2) * k + 400, 6) AS x, round((y - (y0 + y1) / 2) * k + 300, 6) AS y FROM p, k""",
)
def _fitted(spark, sf_dir):
    at = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return tree.fitted(at, 800.0, 600.0).select("node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("selected_ids", f"{_CLIMB}, {views.META} SELECT DISTINCT ID, TRY_CAST(ID AS BIGINT) AS number FROM groups JOIN meta ON ID = node_id WHERE group_id IN ('n1', 'n2', 'c3')")
def _selected(spark, sf_dir):
    groups = tree.collapse(views.tree(spark, sf_dir), 1.0)
    return tree.selected_ids(groups, views.metadata(spark, sf_dir), groups.filter("group_id in ('n1', 'n2', 'c3')"))


@register("edited_lengths", f"WITH {views.TREE} SELECT node_id, CASE WHEN node_id IN ('n1', 'n2') THEN 9.5::DOUBLE ELSE length END AS length, length AS original_length FROM tree")
def _edited(spark, sf_dir):
    changes = spark.createDataFrame([("n1", 9.5), ("n2", 9.5)], "node_id string, value double")
    return tree.with_length(views.tree(spark, sf_dir), changes).select("node_id", "length", "original_length")


@register("auto_threshold", f"WITH {views.TREE} SELECT coalesce((SELECT greatest(length, 0) AS v FROM tree WHERE parent_id IS NOT NULL ORDER BY v DESC LIMIT 1 OFFSET 100), 0.0::DOUBLE) AS threshold")
def _threshold(spark, sf_dir):
    return spark.createDataFrame([(tree.auto_threshold(views.tree(spark, sf_dir), 100),)], "threshold double")


def _radial_sql() -> str:
    """The same folds over the tree's four levels, in SQL."""
    ctes = [
        "kids AS (SELECT parent_id AS node_id, count(*) AS children FROM tree WHERE parent_id IS NOT NULL GROUP BY 1)",
        "z AS (SELECT t.node_id, t.parent_id, depth, coalesce(greatest(length, 0), 0) AS link, CASE WHEN children IS NULL THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END AS size, coalesce(children, 0) AS children FROM tree t LEFT JOIN kids ON kids.node_id = t.node_id)",
        "m AS (SELECT z.*, p.size AS parent_size FROM z LEFT JOIN z p ON p.node_id = z.parent_id)",
        "g AS (SELECT max(link) FILTER (parent_id IS NOT NULL) / 500.0::DOUBLE * 2 AS r0, max(link) FILTER (parent_id IS NOT NULL) / 500.0::DOUBLE * 2 * pi() / sum(size) AS guess FROM m)",
        f"arcs0 AS (SELECT i AS no, guess * pow(4.0::DOUBLE, i - 3) AS arc FROM g, range({radial.ARCS}) r(i))",
    ]
    for fold in range(radial.FOLDS):
        for d in (3, 2, 1, 0):
            below = f"LEFT JOIN (SELECT no, parent_id, max(far) AS reach, sum(turn + arc / far) AS angle FROM f{fold}_{d + 1} GROUP BY 1, 2) b ON b.no = a.no AND b.parent_id = m.node_id" if d < 3 else "LEFT JOIN (SELECT 0 AS no, NULL AS parent_id, 0.0::DOUBLE AS reach, 0.0::DOUBLE AS angle) b ON false"
            ctes.append(
                f"f{fold}_{d} AS (SELECT *, CASE WHEN cos(pi() - half) > whole / off THEN off ELSE greatest(sqrt(pow(whole * cos(half) + off, 2) + pow(whole * sin(half), 2)), off, whole) END AS far, "
                f"CASE WHEN cos(pi() - half) > whole / off THEN asin(least(1, whole / off)) ELSE atan2(whole * sin(half), whole * cos(half) + off) END AS turn FROM (SELECT *, least(width, pi()) AS half FROM (SELECT *, greatest(angle, own * own_angle / whole) AS width FROM (SELECT a.no, a.arc, m.*, "
                f"coalesce(b.angle, 0.0::DOUBLE) AS angle, r0 * sqrt(size) AS own, asin(least(1.0::DOUBLE, a.arc * sqrt(size) / r0)) AS own_angle, greatest(r0 * sqrt(size), coalesce(b.reach, 0.0::DOUBLE)) AS whole, r0 * sqrt(coalesce(parent_size, 1.0::DOUBLE)) + link AS off "
                f"FROM m CROSS JOIN g CROSS JOIN arcs{fold} a {below} WHERE m.depth = {d}))))"
            )
        ctes.append(f"w{fold} AS (SELECT no, arc, max(width) AS width FROM ({' UNION ALL '.join(f'SELECT no, arc, width FROM f{fold}_{d}' for d in range(4))}) GROUP BY 1, 2)")
        ctes.append(f"o{fold} AS (SELECT coalesce(max(no) FILTER (width <= pi()), 0) AS best, count(*) FILTER (width <= pi()) AS fits FROM w{fold})")
        if fold < radial.FOLDS - 1:
            ctes.append(f"l{fold} AS (SELECT x.arc AS low, CASE WHEN fits > 0 THEN y.arc ELSE x.arc END AS high FROM o{fold} JOIN arcs{fold} x ON x.no = best JOIN arcs{fold} y ON y.no = least(best + 1, {radial.ARCS - 1}))")
            ctes.append(f"arcs{fold + 1} AS (SELECT i AS no, low * pow(high / low, i / {radial.ARCS}.0::DOUBLE) AS arc FROM l{fold}, range({radial.ARCS}) r(i))")
    last = radial.FOLDS - 1
    ctes += [
        f"f AS (SELECT x.* FROM ({' UNION ALL '.join(f'SELECT * FROM f{last}_{d}' for d in range(4))}) x JOIN o{last} ON x.no = best)",
        "c AS (SELECT f.node_id, f.parent_id, f.link, f.parent_size, p.angle AS parent_angle, p.parent_id IS NULL AS from_root, f.turn + f.arc / f.far AS room, f.off, CASE WHEN p.children > 2 THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(f.node_id, ''), lambda x: unicode(x)::BIGINT)), lambda h, x: (h * 31 + x) & 4294967295) ELSE 0 END AS hash, "
        "CASE WHEN p.parent_id IS NULL THEN greatest(0, (pi() - p.angle) / p.children) ELSE 0 END AS gap FROM f JOIN f p ON p.node_id = f.parent_id)",
        "d AS (SELECT node_id, parent_id, off, room + coalesce(sum(2 * (room + gap)) OVER (PARTITION BY parent_id ORDER BY CASE WHEN hash >= 2147483648 THEN hash - 4294967296 ELSE hash END, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - CASE WHEN from_root THEN 0 ELSE parent_angle END AS offset_ FROM c)",
        "q(node_id, angle, x, y) AS (SELECT node_id, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM tree WHERE parent_id IS NULL UNION ALL SELECT d.node_id, q.angle + offset_, q.x + off * cos(q.angle + offset_), q.y + off * sin(q.angle + offset_) FROM q JOIN d ON d.parent_id = q.node_id)",
    ]
    return f"WITH RECURSIVE {views.TREE}, {', '.join(ctes)} SELECT node_id, round(x, 4) + 0.0::DOUBLE AS x, round(y, 4) + 0.0::DOUBLE AS y FROM q"


@register("radial_layout", _radial_sql())
def _radial(spark, sf_dir):
    """Positions of all nodes, each subtree in a fan of its own."""
    at = tree.radial_layout(views.tree(spark, sf_dir))
    return at.select("node_id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@register("forced_groups", (
    f"WITH RECURSIVE {views.TREE}, go AS (SELECT node_id, parent_id, parent_id IS NOT NULL AND (node_id IN ('n1', 'n2') OR (length <= 1 "
    f"AND (node_id <> 'n4' OR length <= 0))) AS j FROM tree), g(node_id, top, go) AS (SELECT node_id, node_id, j FROM go UNION ALL SELECT g.node_id, "
    f"t.parent_id, u.j FROM g JOIN go t ON t.node_id = g.top JOIN go u ON u.node_id = t.parent_id WHERE g.go) SELECT node_id, top AS group_id FROM g "
    f"WHERE NOT go"
))
def _forced(spark, sf_dir):
    nodes = views.tree(spark, sf_dir)
    return tree.collapse(nodes, 1.0, force=nodes.filter("node_id in ('n1', 'n2')"), keep=nodes.filter("node_id = 'n4'"))


@register("indexed_search", (
    f"WITH {views.META}, p AS (SELECT unnest(['^build', 'ran', 'a(ce|nd)', 'm.ch', '(united|saudi) +[a-z]', 'y{{2}}', 'ABI', 'c1']) AS pattern) SELECT DISTINCT pattern, ID FROM meta, p WHERE regexp_matches(segment, pattern, 'i') "
    f"OR regexp_matches(nation, pattern, 'i') OR regexp_matches(ID, pattern, 'i') OR regexp_matches(balance, pattern, 'i') OR regexp_matches(CAST(ord AS VARCHAR), pattern, 'i')"
))
def _indexed_search(spark, sf_dir):
    """Keyword searches of the metadata by its trigram index."""
    rows, path = views.metadata(spark, sf_dir), room(spark, "index")
    search_index.build(rows, path)
    index, out = spark.read.parquet(path), None
    for pattern in ("^build", "ran", "a(ce|nd)", "m.ch", "(united|saudi) +[a-z]", "y{2}", "ABI", "c1"):
        found = search_index.indexed_search(rows, index, pattern).select(F.lit(pattern).alias("pattern"), "ID")
        out = found if out is None else out.union(found)
    return out


@register(
    "sorted_view",
    """WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1000 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT -o_orderkey - 1, o_totalprice / 2 FROM orders WHERE o_orderkey % 13 = 0)
SELECT o_orderkey, price, row_number() OVER (ORDER BY price, o_orderkey) AS place FROM e""",
)
def _sorted_view(spark, sf_dir):
    """The orders by price, in runs, after edits, insertions and deletions."""
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    view = sorted_view.sorted_view(rows, ["price"], "o_orderkey")
    moved = rows.filter("o_orderkey % 7 = 0").withColumn("price", F.col("price") + 1000)
    fresh = rows.filter("o_orderkey % 13 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), (F.col("price") / 2).alias("price"))
    return view.edited(moved.union(fresh), rows.filter("o_orderkey % 11 = 0")).rows()


@register("visible_rows", f"WITH {views.META} SELECT ID, nation FROM meta WHERE ord % 2 = 0")
def _visible(spark, sf_dir):
    return metadata.visible(views.metadata(spark, sf_dir), views.tree(spark, sf_dir).filter("is_hypo or ord % 2 = 0")).select("ID", "nation")


@register("value_selection", f"WITH {views.META} SELECT DISTINCT ID FROM meta WHERE segment = 'BUILDING'")
def _value(spark, sf_dir):
    return metadata.select_value(views.metadata(spark, sf_dir), "segment", "BUILDING")


@register("composition_items", (
    f"{_CLIMB}, {views.META}, c AS (SELECT group_id, segment AS value, count(*) AS n FROM groups JOIN meta ON ID = node_id GROUP BY 1, 2) SELECT group_id, "
    f"value, unnest(range(1, n + 1)) AS item FROM c"
))
def _items(spark, sf_dir):
    nodes = views.tree(spark, sf_dir)
    members = tree.collapse(nodes, 1.0).join(nodes.filter("not is_hypo").select("node_id"), "node_id", "left_semi")
    return metadata.one_by_one(metadata.composition(members, views.metadata(spark, sf_dir), "segment"))


@register("value_colours", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '#ff0000' WHEN 'MACHINERY' THEN '#00ff00' ELSE '#FFFFFF' END AS colour FROM customer")
def _colours(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select("c_custkey", metadata.colours(F.col("c_mktsegment"), {"BUILDING": "#ff0000", "MACHINERY": "#00ff00"}).alias("colour"))


@register("aliased_columns", "SELECT s_suppkey, s_nationkey AS country, 'ND' AS city FROM supplier")
def _aliased(spark, sf_dir):
    return metadata.aliased(views.table(spark, sf_dir, "supplier"), {"country": ("nation|country", ""), "city": ("town|city", "ND")}).select("s_suppkey", "country", "city")


@register("addresses", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name || ' ' || CAST(s_nationkey AS VARCHAR) END AS address FROM supplier")
def _addresses(spark, sf_dir):
    rows = views.table(spark, sf_dir, "supplier").withColumn("latitude", F.when(F.col("s_suppkey") % 2 == 0, "1").otherwise("")).withColumn("longitude", F.lit("2"))
    rows = rows.withColumn("country", F.col("s_nationkey").cast("string"))
    return rows.select("s_suppkey", metadata.address(rows, ("name",), "latitude", "longitude", "country").alias("address"))


@register("predefined_groups", "SELECT v AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) t(v) LEFT JOIN orders ON o_orderstatus = v GROUP BY v")
def _predefined(spark, sf_dir):
    groups = views.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return grid.predefined(groups, "o_orderstatus", ["F", "O", "P", "X"])


@register("collapsed_levels", (
    "SELECT CAST(l AS INT) AS level, key AS group_key, row_number() OVER (ORDER BY s, l >= 1, p) AS place FROM (SELECT 0 AS l, o_orderstatus AS key, "
    "o_orderstatus AS s, NULL AS p FROM orders GROUP BY o_orderstatus UNION ALL SELECT 1, o_orderstatus || ':|:' || o_orderpriority, o_orderstatus, "
    "o_orderpriority FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderstatus, o_orderpriority)"
))
def _collapsed(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    shut = rows.select(F.when(F.col("o_orderstatus") == "F", "F").otherwise(F.concat_ws(grid.SEPARATOR, "o_orderstatus", "o_orderpriority")).alias("group_key")).distinct()
    return grid.flattened(rows, ["o_orderstatus", "o_orderpriority"], ["id"], shut).drop("id")


@register("text_sort", "SELECT c_custkey, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) AS place FROM customer")
def _text_sort(spark, sf_dir):
    return metadata.reindexed(views.table(spark, sf_dir, "customer"), [F.col("c_custkey").cast("string").asc()]).select("c_custkey", "place")


@register("formatted", (
    "SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || '%' AS share, CASE WHEN l_returnflag = 'R' THEN 'Yes' "
    "ELSE 'No' END AS returned FROM lineitem"
))
def _formatted(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", grid.percent(F.col("l_discount") * 100).alias("share"), grid.yes_no(F.col("l_returnflag") == "R").alias("returned"))


@register("split_lines", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) || ',' || n_name || '|' || CAST(n_regionkey AS VARCHAR) AS line FROM nation")
def _split_lines(spark, sf_dir):
    return views.table(spark, sf_dir, "nation").select("n_nationkey", sinks.split_line(F.array(F.col("n_nationkey").cast("string"), "n_name"), F.array(F.col("n_regionkey").cast("string"))).alias("line"))


@register("clean_names", r"SELECT p_partkey, regexp_replace(p_name || ' (' || p_brand || ');', '[() ,\"'';]', '_', 'g') AS name, upper(p_type) AS allele FROM part")
def _clean(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", profile.clean_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(");"))).alias("name"), profile.clean_allele(F.col("p_type")).alias("allele"))


@register(
    "best_places",
    """WITH c AS (SELECT c_nationkey AS place_key, 0.5::DOUBLE + c_custkey / 4000.0::DOUBLE AS importance, (c_custkey % 3) * 0.05::DOUBLE AS x0, 2.0::DOUBLE + (c_custkey % 11) * 0.1::DOUBLE AS x1, (c_custkey % 5)::DOUBLE AS y0, (c_custkey % 5 + 2)::DOUBLE AS y1, c_mktsegment AS country, CASE WHEN c_custkey % 5 < 3 THEN 'x' ELSE 'y' END AS city FROM customer),
n AS (SELECT * FROM (SELECT *, max(importance) OVER (PARTITION BY place_key) AS top FROM c) WHERE importance >= 0.7::DOUBLE * top),
b AS (SELECT place_key, arg_max({'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1}, importance) AS b FROM n GROUP BY 1),
k AS (SELECT n.* FROM n JOIN b ON b.place_key = n.place_key WHERE (greatest(least(x1, b.b.x1) - greatest(x0, b.b.x0), 0) >= 0.9::DOUBLE * least(x1 - x0, b.b.x1 - b.b.x0) AND greatest(least(y1, b.b.y1) - greatest(y0, b.b.y0), 0) >= 0.9::DOUBLE * least(y1 - y0, b.b.y1 - b.b.y0)) OR importance >= 0.85::DOUBLE * top),
a AS (SELECT place_key, count(*) AS n, round(avg((x0 + x1) / 2), 6) AS longitude, round(avg((y0 + y1) / 2), 6) AS latitude FROM k GROUP BY 1),
v AS (SELECT k.place_key, country FROM k JOIN a ON a.place_key = k.place_key GROUP BY k.place_key, country, n HAVING count(*) * 2 > n), w AS (SELECT k.place_key, city FROM k JOIN a ON a.place_key = k.place_key GROUP BY k.place_key, city, n HAVING count(*) * 2 > n)
SELECT a.place_key, longitude, latitude, coalesce(country, '') AS country, coalesce(city, '') AS city FROM a LEFT JOIN v ON v.place_key = a.place_key LEFT JOIN w ON w.place_key = a.place_key""",
)
def _places(spark, sf_dir):
    """The customers of a nation as answers of a geocoder, and one place made of them."""
    key = F.col("c_custkey")
    rows = views.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("place_key"), (0.5 + key / 4000.0).alias("importance"), ((key % 3) * 0.05).alias("x0"), (2.0 + (key % 11) * 0.1).alias("x1"), (key % 5).cast("double").alias("y0"), (key % 5 + 2).cast("double").alias("y1"),
        F.col("c_mktsegment").alias("country"), F.when(key % 5 < 3, "x").otherwise("y").alias("city"),
    )
    found = metadata.best_places(rows)
    return found.withColumn("longitude", F.round("longitude", 6)).withColumn("latitude", F.round("latitude", 6))


#: The configurations that are compared: trees of directed distances with and without rearrangement, of eBurst ranks under two rules for missing alleles, of symmetric distances, and by neighbour joining.
METHODS = {
    "MSTreeV2": TreeSpec(),
    "goeBurst as_allele": TreeSpec("goeBurst", DistanceSpec(missing="as_allele")),
    "goeBurst pair_delete": TreeSpec("goeBurst"),
    "MSTree asymmetric": TreeSpec("MSTree", DistanceSpec("asymmetric"), "harmonic"),
    "MSTree asymmetric recrafted": TreeSpec("MSTree", DistanceSpec("asymmetric"), "harmonic", True),
    "MSTree symmetric": TreeSpec("MSTree"),
    "NJ": TreeSpec("NJ"),
}


@register("tree_accuracy")
def _accuracy(spark, sf_dir):
    """Quartet scores of seven methods' trees of one profile against the grouping that is known of its samples."""
    from cladewise.backend import tree_text

    packed = views.nations_profile(spark, sf_dir)
    leaves = packed.select(F.col("sample").cast("string").alias("leaf"))
    known = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("leaf"), F.col("n_regionkey").cast("string").alias("clade")).join(leaves, "leaf", "left_semi")
    truth, out = evaluate.splits(known, leaves), None
    for name, spec in METHODS.items():
        nodes = trees.read_tree(spark, tree_text(packed, spec)).select("node_id", "parent_id", "is_hypo")
        rows = evaluate.compare(truth, evaluate.splits(evaluate.clades(nodes), leaves)).withColumn("method", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return evaluate.scores(out, ["method"])


_PN_PAIRS = "x AS (SELECT a.sid AS src, b.sid AS dst, count(*) FILTER (a.allele <> b.allele) AS differ FROM cells a JOIN cells b ON a.locus = b.locus AND a.sid < b.sid GROUP BY 1, 2)"


@register(
    "quartet_distances",
    f"""WITH {views.PN}, {_PN_PAIRS}, s AS (SELECT DISTINCT sid FROM cells), q AS (SELECT a.sid AS a, b.sid AS b, c.sid AS c, d.sid AS d FROM s a JOIN s b ON a.sid < b.sid JOIN s c ON b.sid < c.sid JOIN s d ON c.sid < d.sid),
m AS (SELECT a, b, c, d, sum(x.differ) / 20.0::DOUBLE * 2000 / 6 AS mean FROM q JOIN x ON (src = a AND dst IN (b, c, q.d)) OR (src = b AND dst IN (c, q.d)) OR (src = c AND dst = q.d) GROUP BY 1, 2, 3, 4)
SELECT a, b, c, d, round(mean, 6) AS mean, CAST(CASE WHEN mean <= 1950 THEN least(floor((mean + 50) / 100) * 100, 1900) ELSE 2000 END AS BIGINT) AS bin FROM m""",
)
def _quartet_distances(spark, sf_dir):
    """Mean distance of each four samples, and its bin."""
    packed = views.nations_profile(spark, sf_dir)
    found = distance.pairs(packed, DistanceSpec(missing="as_allele"))
    means = evaluate.quartet_distance(evaluate.quartets(packed.select(F.col("sample").alias("leaf"))), found, 20)
    return means.select("a", "b", "c", "d", F.round("mean", 6).alias("mean"), evaluate.distance_bin(F.col("mean")).alias("bin"))


@register(
    "scores_by_kind",
    """WITH s AS (SELECT o_orderstatus AS method, CAST(floor(o_custkey / 50) AS BIGINT) AS chunk, count(*) FILTER (o_orderkey % 6 = 0) AS tp_b, count(*) FILTER (o_orderkey % 6 = 1) AS fp_b, count(*) FILTER (o_orderkey % 6 = 2) AS fn_b,
  count(*) FILTER (o_orderkey % 6 = 3) AS tp_u, count(*) FILTER (o_orderkey % 6 = 4) AS fp_u, count(*) FILTER (o_orderkey % 6 = 5) AS fn_u FROM orders GROUP BY 1, 2),
k AS (SELECT chunk, method, 'B' AS kind, tp_b AS tp, fp_b AS fp, fn_b AS fn FROM s UNION ALL SELECT chunk, method, 'U', tp_u, fp_u, fn_u FROM s UNION ALL SELECT chunk, method, 'total', tp_b + tp_u, fp_b + fp_u, fn_b + fn_u FROM s)
SELECT chunk, method, kind, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 9) ELSE -1 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 9) ELSE -1 END AS sensitivity FROM k""",
)
def _scores_by_kind(spark, sf_dir):
    """Precision and sensitivity of balanced, unbalanced and all splits over chunks of files."""
    names = ("tp_b", "fp_b", "fn_b", "tp_u", "fp_u", "fn_u")
    rows = views.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("method"), *[F.when(F.col("o_orderkey") % 6 == i, 1).otherwise(0).alias(n) for i, n in enumerate(names)])
    found = evaluate.by_kind(evaluate.chunked_sums(rows, "o_custkey", ["method"], list(names)), ["chunk", "method"])
    return found.select("chunk", "method", "kind", F.round("precision", 9).alias("precision"), F.round("sensitivity", 9).alias("sensitivity"))


def _two_levels(a: str, b: str) -> str:
    """The pairing of four leaves in a tree of groups (columns ``a``) and groups of these (``b``)."""
    two = lambda g, p, q, r, s: f"(({p}.{g} = {q}.{g} AND {r}.{g} <> {p}.{g} AND {s}.{g} <> {p}.{g}) OR ({r}.{g} = {s}.{g} AND {p}.{g} <> {r}.{g} AND {q}.{g} <> {r}.{g}))"
    arms = [f"WHEN {two(a, *x)} OR {two(b, *x)} THEN {i}" for i, x in enumerate((("p", "q", "r", "s"), ("p", "r", "q", "s"), ("p", "s", "q", "r")), 1)]
    return f"CASE {' '.join(arms)} ELSE 0 END"


@register(
    "quartet_counts",
    f"""WITH t AS (SELECT n_regionkey AS region, n_nationkey AS nation, c_mktsegment AS segment, c_mktsegment || CAST(n_regionkey AS VARCHAR) AS part, count(*) AS n, row_number() OVER (ORDER BY n_nationkey, c_mktsegment) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3),
x AS (SELECT {_two_levels("nation", "region")} AS one, {_two_levels("part", "segment")} AS two,
  CASE WHEN p.k = s.k THEN p.n * (p.n - 1) * (p.n - 2) * (p.n - 3) // 24 WHEN p.k = r.k THEN p.n * (p.n - 1) * (p.n - 2) // 6 * s.n WHEN q.k = s.k THEN p.n * (q.n * (q.n - 1) * (q.n - 2) // 6) WHEN p.k = q.k AND r.k = s.k THEN (p.n * (p.n - 1) // 2) * (r.n * (r.n - 1) // 2)
    WHEN p.k = q.k THEN p.n * (p.n - 1) // 2 * r.n * s.n WHEN q.k = r.k THEN p.n * (q.n * (q.n - 1) // 2) * s.n WHEN r.k = s.k THEN p.n * q.n * (r.n * (r.n - 1) // 2) ELSE p.n * q.n * r.n * s.n END AS m
  FROM t p JOIN t q ON p.k <= q.k JOIN t r ON q.k <= r.k JOIN t s ON r.k <= s.k)
SELECT CAST(sum(m) FILTER (one > 0 AND one = two) AS BIGINT) AS tp, CAST(sum(m) FILTER (one > 0 AND two > 0 AND one <> two) AS BIGINT) AS fp, CAST(sum(m) FILTER (one > 0 AND one <> two) AS BIGINT) AS fn FROM x""",
)
def _quartet_counts(spark, sf_dir):
    """Shared quartets of two trees of all customers: by nation and region, and by region within the market segment."""
    customer, nation = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "nation")
    rows = customer.join(F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"])

    def of(inner, outer):
        leaf, in_, out = F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("i"), inner), F.concat(F.lit("o"), outer)
        nodes = rows.select(leaf.alias("node_id"), in_.alias("parent_id"), leaf.alias("name"))
        for child, parent in ((in_, out), (out, F.lit("root"))):
            nodes = nodes.union(rows.select(child, parent, F.lit(None).cast("string")).distinct())
        return nodes.union(spark.range(1).select(F.lit("root"), F.lit(None).cast("string"), F.lit(None).cast("string")))

    key = lambda c: F.col(c).cast("string")
    return evaluate.quartet_counts(of(key("n_nationkey"), key("n_regionkey")), of(F.concat("c_mktsegment", key("n_regionkey")), F.col("c_mktsegment")))


@register("named_by_leaf", (
    f"WITH {views.TREE}, t AS (SELECT *, CASE WHEN is_hypo THEN NULL ELSE node_id END AS name FROM tree), z AS (SELECT parent_id, arg_min(node_id, "
    f"ord) AS leaf FROM t WHERE name IS NOT NULL AND length = 0 GROUP BY 1) SELECT t.node_id, t.parent_id, coalesce(t.name, z.leaf) AS name, t.length "
    f"FROM t LEFT JOIN z ON z.parent_id = t.node_id WHERE t.node_id NOT IN (SELECT leaf FROM z)"
))
def _named_by_leaf(spark, sf_dir):
    nodes = views.tree(spark, sf_dir).withColumn("name", F.when(~F.col("is_hypo"), F.col("node_id")))
    return evaluate.named_by_leaf(nodes).select("node_id", "parent_id", "name", "length")


@register("node_listing", f"WITH {views.TREE} SELECT node_id, row_number() OVER (ORDER BY node_id) AS place, true AS selected FROM tree WHERE NOT is_hypo")
def _listing(spark, sf_dir):
    return tree.select_all(tree.listing(views.tree(spark, sf_dir)))


@register("selected_records", (
    f"WITH {views.META}, {views.TREE}, c AS (SELECT node_id FROM tree WHERE NOT is_hypo AND length > 3) SELECT ID, segment, '' AS note FROM meta "
    f"WHERE ID IN (SELECT node_id FROM c)"
))
def _selected_records(spark, sf_dir):
    chosen = views.tree(spark, sf_dir).filter("not is_hypo and length > 3")
    rows = metadata.selected_only(views.metadata(spark, sf_dir), chosen)
    return metadata.remove_column(metadata.add_column(rows, "note"), "nation").select("ID", "segment", "note")


@register("selection_in_step", f"WITH {views.META}, {views.TREE} SELECT ID, ID IN (SELECT node_id FROM tree WHERE NOT is_hypo AND length > 3) AS selected FROM meta")
def _in_step(spark, sf_dir):
    chosen = views.tree(spark, sf_dir).filter("not is_hypo and length > 3")
    return metadata.with_selection(views.metadata(spark, sf_dir), chosen).select("ID", "selected")


@register("narrowed_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def _narrowed(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    shown = grid.refiltered(rows, None, F.col("o_orderstatus") == "F")
    return grid.refiltered(rows, shown, F.col("o_totalprice") > 1000, narrowing=True).select("o_orderkey")


def _gradient_sql() -> str:
    at = "CASE WHEN n <= 1 THEN 0.0::DOUBLE ELSE (place - 1) / (n - 1)::DOUBLE END"
    arms = []
    for (low, one), (high, two) in zip(metadata.GRADIENTS["heat"], metadata.GRADIENTS["heat"][1:]):
        part = lambda k: f"printf('%02X', CAST(floor({int(one[k : k + 2], 16)} + (way - {low}) / {high - low} * {int(two[k : k + 2], 16) - int(one[k : k + 2], 16)} + 0.5) AS BIGINT))"  # noqa: B023, E731
        arms.append(f"WHEN way < {high} THEN '#' || {part(0)} || {part(2)} || {part(4)}")
    return (
        f"SELECT n_name, CASE {' '.join(arms)} ELSE '#{metadata.GRADIENTS['heat'][-1][1]}' END AS colour FROM (SELECT n_name, {at} AS way FROM (SELECT n_name, "
        f"row_number() OVER (ORDER BY n_name) AS place, count(*) OVER () AS n FROM nation))"
    )


@register("gradient_colours", _gradient_sql())
def _gradient(spark, sf_dir):
    rows = numbered(views.table(spark, sf_dir, "nation").select("n_name"), ["n_name"])
    return rows.select("n_name", metadata.gradient(F.col("place"), F.lit(rows.count()), "heat").alias("colour"))


def _text_file(df, name: str) -> str:
    """The lines of a DataFrame ``line, ord`` as a folder of text files in order, for scans of what the tables hold."""
    return written(df.orderBy("ord").select("line"), name, "text").path


@register("profile_of_table", f"WITH {views.P1} SELECT CAST(sid AS VARCHAR) AS sample, CAST(locus AS INT) AS locus, CAST(allele AS VARCHAR) AS allele FROM cells")
def _profile_of_table(spark, sf_dir):
    """A profile file written from the events and read again."""
    head = spark.createDataFrame([("#Strain\t#note\t" + "\t".join(f"L{i}" for i in range(24)), -1)], "line string, ord long")
    rows = views.events_profile(spark, sf_dir).select(F.concat_ws("\t", F.col("sample").cast("string"), F.lit("x"), F.array_join(F.col("alleles").cast("array<string>"), "\t")).alias("line"), F.col("sample").cast("long").alias("ord"))
    return profile_files.read_profile(spark, _text_file(head.union(rows), "profile"))


@register("metadata_of_table", """SELECT CAST(c_nationkey AS VARCHAR) AS "ID", arg_max(c_name, c_custkey) AS "Name", arg_max(CAST(c_custkey AS VARCHAR), c_custkey) AS "Last" FROM customer GROUP BY 1""")
def _metadata_of_table(spark, sf_dir):
    """A metadata file written from the customers and read again, by tab as the server reads it: of the rows of one nation the last."""
    head = spark.createDataFrame([("ID\tName\tLast", -1)], "line string, ord long")
    rows = views.table(spark, sf_dir, "customer").select(F.concat_ws("\t", F.col("c_nationkey").cast("string"), "c_name", F.col("c_custkey").cast("string")).alias("line"), F.col("c_custkey").alias("ord"))
    return profile_files.read_metadata(spark, _text_file(head.union(rows), "metadata"), "\t")


@register("newick_of_table", "SELECT 'n' || n_nationkey AS name, CAST(n_nationkey % 4 AS DOUBLE) AS length, 2 AS depth FROM nation")
def _newick_of_table(spark, sf_dir):
    """A Newick text made of the nations by region, one text for each region, and parsed."""
    leaf = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(":"), (F.col("n_nationkey") % 4).cast("string"))
    texts = views.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("tree_id")).agg(F.concat(F.lit("(("), F.array_join(F.array_sort(F.collect_list(leaf)), ","), F.lit(")90:1.5);")).alias("text"))
    return trees.parse_trees(texts).filter("not is_hypo").select("name", "length", "depth")


@register("goeburst_edges", (
    f"WITH {views.P1}, {views.REPS}, {_PAIRS}, {_EBURST}, {_minimax(8)} SELECT least(u, v) AS src, greatest(u, v) AS dst, "
    f"CAST({_DIFFER} AS DOUBLE) AS length FROM t JOIN p a ON a.sid = u JOIN p b ON b.sid = v AND a.locus = b.locus GROUP BY u, v"
))
def _goeburst(spark, sf_dir):
    """The spanning tree of the events profile with eBurst ranks, and the loci that differ along its edges."""
    edges = mst.tree_table(views.events_profile(spark, sf_dir), TreeSpec("goeBurst"))[1]
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("length").cast("double").alias("length"))


@register("run_names", "SELECT p_partkey, regexp_extract(p_brand, '^[^_.]+') AS method, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS rate FROM part")
def _run_names(spark, sf_dir):
    """Method and rate of result files named after the parts."""
    name = F.concat(F.lit("runs/out/"), "p_brand", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise(""), F.lit(".tsv"))
    return views.table(spark, sf_dir, "part").select("p_partkey", evaluate.run_parts(name).alias("r")).select("p_partkey", "r.*")


@register("consecutive_rows", "SELECT CAST((k + 1) // 2 AS INT) AS place, first, second FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS k, o_totalprice AS first, lead(o_totalprice) OVER (ORDER BY o_orderkey) AS second FROM orders) WHERE k % 2 = 1")
def _consecutive(spark, sf_dir):
    return evaluate.consecutive(views.table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice")


@register("column_order", _values("place, name", *[f"({i}, '{n}')" for i, n in enumerate(("segment", "ID", "nation", "balance", "ord"))]))
def _column_order(spark, sf_dir):
    """The metadata's columns, one moved to the left and one dropped that differs from another only by case."""
    moved = metadata.moved_column(views.metadata(spark, sf_dir), "segment", -1)
    return spark.createDataFrame(list(enumerate(metadata.distinct_columns([*moved.columns, "Nation"]))), "place int, name string")


@register("kept_subtree", f"WITH {views.TREE}, {views.META}, k AS (SELECT ID FROM meta WHERE nation = 'FRANCE' OR segment = 'MACHINERY') SELECT ID AS node_id FROM k")
def _kept_subtree(spark, sf_dir):
    """The leaves that are left when the leaves of some records are kept and all others go."""
    nodes = views.tree(spark, sf_dir)
    keep = views.metadata(spark, sf_dir).filter("nation = 'FRANCE' or segment = 'MACHINERY'").select(F.col("ID").alias("node_id"))
    return tree.induced(nodes, nodes.join(keep, "node_id", "left_semi")).filter("not is_hypo").select("node_id")
