"""Trees as node tables: rooting, collapsing, pruning, expanding, selecting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.operators import climb
from cladewise.operators.radial import clean_length, radial_layout  # noqa: F401  (layouts are tree operators too)
from cladewise.operators.numbering import numbered
from cladewise.plans.storage import written


def root_edges(edges: list) -> list[list]:
    """[parent, child, length] of undirected edges, from the source of the longest one; children in the order in which sweeps over the edges, longest first, attach them."""
    left = sorted(edges, key=lambda e: -e[2])
    placed, out = {left[0][0]} if left else set(), []
    while left:
        rest = []
        for s, t, x in left:
            if s not in placed and t in placed:
                s, t = t, s
            if s in placed:
                out.append([s, t, x])
                placed.add(t)
            else:
                rest.append([s, t, x])
        if len(rest) == len(left):
            raise ValueError("the edges are not connected")
        left = rest
    return out


def rooted_nodes(edges: list, names: list) -> list[tuple]:
    """(node, parent, name, length) of a tree whose inner samples become unnamed nodes with a leaf of length 0. One sample alone is one node."""
    if not edges:
        return [(n, None, str(n), 0.0) for n in names[:1]]
    rooted = root_edges(edges)
    inner = {s for s, _, _ in rooted}
    shown = lambda v: None if v in inner or isinstance(v, tuple) else str(v)
    rows = [(rooted[0][0], None, None, 0.0)] + [(t, s, shown(t), float(x)) for s, t, x in rooted]
    return rows + [(("leaf", v), v, str(v), 0.0) for v, *_ in list(rows) if v in inner and not isinstance(v, tuple)]


def smooth(nodes: list[tuple]) -> list[tuple]:
    """Branches below 0.1 move to their sisters, children before parents, if any branch is above 3."""
    if max((n[3] for n in nodes if n[1] is not None), default=0) <= 3:
        return nodes
    below: dict = {}
    for v, p, *_ in nodes:
        below.setdefault(p, []).append(v)
    length = {v: x for v, _, _, x in nodes}
    order, stack = [], list(below.get(None, []))
    while stack:
        v = stack.pop()
        order.append(v)
        stack += below.get(v, [])
    up = {v: p for v, p, *_ in nodes}
    for v in reversed(order):
        if up[v] is not None and 0 < length[v] < 0.1:
            for sister in below[up[v]]:
                if sister != v:
                    length[sister] += length[v]
            length[v] = 0.0
    return [(v, p, name, length[v]) for v, p, name, _ in nodes]


def expand_groups(nodes: list[tuple], members: dict) -> list[tuple]:
    """A leaf of several equal samples becomes an unnamed node with a leaf of length 0 for each."""
    out = []
    for v, p, name, x in nodes:
        group = members.get(name, [])
        out.append((v, p, None if len(group) > 1 else name, x))
        if len(group) > 1:
            out += [(("member", m), v, str(m), 0.0) for m in group]
    return out


def midpoint(nodes: list[tuple]) -> list[tuple]:
    """The tree rooted at the middle of its longest path between leaves."""
    near: dict = {}
    for v, p, _, x in nodes:
        near.setdefault(v, [])
        if p is not None:
            near[v].append((p, x))
            near.setdefault(p, []).append((v, x))
    names = {v: name for v, _, name, _ in nodes}

    def walk(start):
        dist, back, stack = {start: 0.0}, {start: None}, [start]
        while stack:
            v = stack.pop()
            for u, x in near[v]:
                if u not in dist:
                    dist[u], back[u] = dist[v] + x, v
                    stack.append(u)
        return dist, back

    leaves = [v for v in near if len(near[v]) <= 1]
    if len(leaves) < 3:
        return nodes
    key = lambda d: lambda v: (d[v], str(v))
    d, _ = walk(leaves[0])
    a = max(leaves, key=key(d))
    d, back = walk(a)
    b = max(leaves, key=key(d))
    half, v = d[b] / 2, b
    while back[v] is not None and d[back[v]] >= half:
        v = back[v]
    if back[v] is None:
        return nodes
    root = ("root", 0)
    rows, stack = [(root, None, None, 0.0)], [(v, root, d[v] - half), (back[v], root, half - d[back[v]])]
    seen = {v, back[v]}
    while stack:
        u, p, x = stack.pop()
        rows.append((u, p, names.get(u), x))
        for w, y in near[u]:
            if w not in seen:
                seen.add(w)
                stack.append((w, u, y))
    return rows


def root_frame(edges: DataFrame, root) -> DataFrame:
    """``node, parent, length, depth`` of a tree's undirected edges ``u, v, length`` as seen from ``root``, by ranks along a tour."""
    return climb.rooted(edges, root)


def shown_nodes(frame: DataFrame) -> DataFrame:
    """``node, parent, name, length`` (text) of a rooted frame as it is written: an inner sample becomes an unnamed node with a leaf of length 0."""
    text = lambda c: F.col(c).cast("string")
    inner = frame.filter("parent is not null").select(text("parent").alias("_inner")).distinct()
    rows = frame.select(text("node").alias("node"), text("parent").alias("parent"), "length").join(inner, F.col("node") == F.col("_inner"), "left")
    named = rows.select("node", "parent", F.when(F.col("_inner").isNull(), F.col("node")).alias("name"), "length")
    leaves = inner.select(F.concat(F.lit("leaf_"), "_inner").alias("node"), F.col("_inner").alias("parent"), F.col("_inner").alias("name"), F.lit(0.0).alias("length"))
    return named.union(leaves)


def collapse(nodes: DataFrame, threshold: float, force: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
    """``node_id, group_id``: nodes joined to their parents over links of at most ``threshold``, named by the root-most node.

    ``force``: nodes joined whatever their length; ``keep``: nodes that stay apart unless their length is 0.
    """
    links = nodes.filter("parent_id is not null").withColumn("value", clean_length(F.col("length")))
    joined = links.filter(F.col("value") <= threshold)
    if keep is not None:
        joined = joined.join(keep.select("node_id").distinct().withColumn("_k", F.lit(True)), "node_id", "left").filter("_k is null or value <= 0").drop("_k")
    if force is not None:
        joined = joined.union(links.join(force.select("node_id").distinct(), "node_id", "left_semi").select(*joined.columns))
    ends = climb.followed(joined.select(F.col("node_id").alias("at"), F.col("parent_id").alias("to"), F.lit(1).cast("long").alias("n")).distinct())
    return nodes.select("node_id").join(ends.select(F.col("at").alias("node_id"), "to"), "node_id", "left").select("node_id", F.coalesce("to", "node_id").alias("group_id"))


def group_labels(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """``group_id, label, size``: a hypothetical group takes the name of its last named member in ``ord``; hypothetical nodes are no members."""
    both = groups.join(nodes.select("node_id", "is_hypo", "ord"), "node_id")
    named = F.max_by("node_id", F.when(~F.col("is_hypo"), F.col("ord")))
    own = F.bool_or((F.col("node_id") == F.col("group_id")) & ~F.col("is_hypo"))
    return both.groupBy("group_id").agg(F.when(own, F.col("group_id")).otherwise(F.coalesce(named, F.col("group_id"))).alias("label"), F.count(F.when(~F.col("is_hypo"), 1)).alias("size"))


def quotient(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """``source, target, value`` between groups: the links that still join different groups."""
    of = lambda c, g: groups.select(F.col("node_id").alias(c), F.col("group_id").alias(g))
    links = nodes.filter("parent_id is not null").select("node_id", "parent_id", clean_length(F.col("length")).alias("value"))
    return links.join(of("parent_id", "source"), "parent_id").join(of("node_id", "target"), "node_id").filter("source <> target").select("source", "target", "value").distinct()


def auto_threshold(nodes: DataFrame, most: int = 20000) -> float:
    """The link length at which a tree of more than ``most`` links collapses: the (most + 1)st largest; else 0."""
    top = nodes.filter("parent_id is not null").select(clean_length(F.col("length")).alias("v")).orderBy(F.desc("v")).limit(most + 1)
    row = top.agg(F.count("*").alias("n"), F.min("v").alias("v")).first()
    return float(row["v"]) if row["n"] > most else 0.0


def induced(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """The tree of the kept leaves: ``node_id, parent_id, length, is_hypo``. Hypothetical nodes without two branches go, and the lengths along a removed chain add up.

    Two climbs, each in rounds that double: marks from the kept nodes up, and along the chains of nodes that go.
    """
    live = nodes.join(climb.at_or_above(nodes, keep), "node_id", "left_semi").select("node_id", "parent_id", clean_length(F.col("length")).alias("length"), "is_hypo")
    degree = live.groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    # A chain node is passed over: hypothetical, with one child.
    passed = F.col("is_hypo") & (F.coalesce("children", F.lit(0)) <= 1)
    marked = written(live.join(degree, "node_id", "left").withColumn("passed", passed).drop("children"), "marked").df
    # A chain that ends at the root has no node above it.
    hop = climb.followed(marked.filter("passed").select(F.col("node_id").alias("at"), F.col("parent_id").alias("to"), F.col("length").alias("n")))
    hop = hop.select(F.col("at").alias("_at"), F.col("to").alias("_to"), F.col("n").alias("_n"))
    state = marked.filter("not passed").join(hop, F.col("parent_id") == F.col("_at"), "left")
    parent, length = F.when(F.col("_at").isNull(), F.col("parent_id")).otherwise(F.col("_to")), F.col("length") + F.coalesce("_n", F.lit(0.0))
    return state.select("node_id", parent.alias("parent_id"), F.when(parent.isNotNull(), length).alias("length"), "is_hypo")


def without(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """The tree of the named nodes that are not in ``gone``."""
    return induced(nodes, nodes.filter("not is_hypo").join(gone.select("node_id"), "node_id", "left_anti"))


def shown_links(links: DataFrame, most: float, hide: float) -> DataFrame:
    """Links clamped at ``most``, with ``dashed`` where they were longer and ``hidden`` from ``hide`` on."""
    return links.withColumn("shown", F.least("value", F.lit(most))).withColumn("dashed", F.col("value") > most).withColumn("hidden", F.col("value") >= hide)


def radius(size: Column, hypothetical: Column, base: float = 6.0, power: float = 0.5, show_hypothetical: bool = False) -> Column:
    """A node's radius: its size to a power; hypothetical nodes count a quarter, or nothing where they are not shown."""
    return F.when(hypothetical, F.lit(0.25**power * base) if show_hypothetical else F.lit(0.0)).otherwise(F.pow(size, F.lit(power)) * base)


def in_rectangle(layout: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Nodes at x in [x0, x1) and y in [y0, y1)."""
    return layout.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def descendants(nodes: DataFrame, top: DataFrame) -> DataFrame:
    """``top_id, node_id`` of every node below (or at) each node of ``top``."""
    return climb.pairs_below(nodes, top)


def tagged(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """``nodes`` with ``tagged``: whether a node lies below a chosen one."""
    under = climb.nearest(nodes, chosen).select(F.col("node_id").alias("_above"))
    return nodes.join(under, F.col("parent_id") == F.col("_above"), "left").withColumn("tagged", F.col("_above").isNotNull()).drop("_above")


def tracked(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """The links (``source, target``) on the ways from the chosen nodes up to the root."""
    return nodes.filter("parent_id is not null").join(climb.at_or_above(nodes, chosen), "node_id", "left_semi").select(F.col("parent_id").alias("source"), F.col("node_id").alias("target"))


def highlighted(groups: DataFrame, wanted: DataFrame, by: str = "id") -> DataFrame:
    """``group_id, highlighted`` of each group of ``node_id, group_id``: whether ``wanted`` (``id``) names a member, or with ``by='node'`` the group itself."""
    column = "node_id" if by == "id" else "group_id"
    hit = groups.join(wanted.select(F.col("id").alias(column)).distinct(), column, "left_semi").select("group_id").distinct().withColumn("_hit", F.lit(True))
    return groups.select("group_id").distinct().join(hit, "group_id", "left").select("group_id", F.col("_hit").isNotNull().alias("highlighted"))


def all_ids(nodes: DataFrame) -> DataFrame:
    """``node_id`` of all nodes that stand for samples."""
    return nodes.filter("not is_hypo and node_id not like '\\_hypo\\_%'").select("node_id")


def find_links(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links by ``target``, and by ``source`` too where that is not null."""
    w = wanted.select(F.col("source").alias("_s"), F.col("target").alias("target"))
    return links.join(w, "target").filter("_s is null or _s = source").select(*links.columns)


def scaled(value: Column, least: float, most: float, size: float, log: bool = False) -> Column:
    """A link length on a linear scale from 0, or on a logarithmic one from ``least``, to ``size``."""
    if log:
        return F.when(value <= 0, 0.0).otherwise(F.log(F.greatest(value, F.lit(least)) / least) / F.log(F.lit(most / least)) * size)
    return value / most * size


def fitted(layout: DataFrame, width: float, height: float, margin: float = 0.0) -> DataFrame:
    """``node_id, x, y`` moved and scaled (both axes alike) to fit a box; one point alone lies in its middle."""
    box = layout.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    k = F.least((width - 2 * margin) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-9)), (height - 2 * margin) / F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-9)))
    placed = layout.crossJoin(F.broadcast(box.withColumn("k", k)))  # one row
    put = lambda c, size: (F.col(c) - (F.col(f"{c}0") + F.col(f"{c}1")) / 2) * F.col("k") + size / 2
    return placed.select("node_id", put("x", width).alias("x"), put("y", height).alias("y"))


def selected_ids(groups: DataFrame, metadata: DataFrame, chosen: DataFrame, key: str = "ID") -> DataFrame:
    """Distinct ids of the records of all members of the chosen groups, with ``number`` where an id is numeric."""
    members = groups.join(chosen.select("group_id").distinct(), "group_id", "left_semi").select(F.col("node_id").alias(key))
    return metadata.join(members.distinct(), key, "left_semi").select(key).distinct().withColumn("number", F.expr(f"try_cast(`{key}` as bigint)"))


def with_length(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with some link lengths edited (``node_id, value``); ``original_length`` keeps what they were."""
    new = changes.select("node_id", F.col("value").alias("_v"))
    return nodes.join(new, "node_id", "left").withColumn("original_length", F.col("length")).withColumn("length", F.coalesce("_v", "length")).drop("_v")


def select_all(nodes: DataFrame, chosen: bool = True) -> DataFrame:
    """Every node selected, or none: the flag ``selected``."""
    return nodes.withColumn("selected", F.lit(chosen))


def listing(nodes: DataFrame) -> DataFrame:
    """``node_id, place``: the named nodes in order of their names, numbered from 1."""
    return numbered(nodes.filter("not is_hypo").select("node_id"), ["node_id"])
