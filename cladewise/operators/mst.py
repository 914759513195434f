"""Minimum spanning trees of an edge table, shortcuts, and tree pipelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.functions import kernels
from cladewise.functions.coded import MAX_CODES, Coded, code_type
from cladewise.model import DistanceSpec, TreeSpec
from cladewise.operators.components import star_forest
from cladewise.operators.distance import by_blocks, link_lengths
from cladewise.operators.profile import dedup, drop_empty, indexed
from cladewise.operators.rank import ranks as node_ranks
from cladewise.plans.storage import written

#: Nodes that a tree kernel whose steps follow one another takes at most, as measured (on the driver, some 40 bytes for each pair of them).
MAX_DENSE = 10_000

#: Edges (after each task has dropped those that close a cycle among its own) that one task finishes; more go through Boruvka's rounds.
MAX_KRUSKAL = 2_000_000

#: Edges that are looked at together, at least.
PENDING = 200_000

#: Profiles that bound how far apart neighbours in a tree may be.
HUB = 2048


def least_forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Which edges of nodes 0 .. n - 1, given in order, make the least forest: Boruvka's rounds over arrays."""
    part, left, taken = np.arange(n), np.arange(len(u)), []
    while True:
        a, b = part[u[left]], part[v[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            return np.sort(np.concatenate(taken)) if taken else left
        # Of each part the first edge that leaves it: of equal places the last that is set counts.
        first, other = np.full(n, -1), np.full(n, -1)
        first[a[::-1]], other[b[::-1]] = left[::-1], left[::-1]
        best = np.where((first >= 0) & ((other < 0) | (first < other)), first, other)
        parts = np.flatnonzero(best >= 0)
        edge = best[parts]
        x, y = part[u[edge]], part[v[edge]]
        to = np.arange(n)
        to[parts] = np.where(x == parts, y, x)
        mutual = (to[to] == np.arange(n)) & (np.arange(n) < to)
        to[mutual] = np.flatnonzero(mutual)
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        part = to[part]
        taken.append(np.unique(edge))


def _kept(table: pa.Table) -> pa.Table:
    """The edges of a table that close no cycle with smaller ones."""
    table = table.combine_chunks()
    r, w, i, j = (pc.struct_field(table.column("key"), name).to_numpy() for name in ("r", "w", "i", "j"))
    order = np.lexsort((j, i, w, r))
    names, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
    u, v = ends[: len(i)][order], ends[len(i) :][order]
    return table.take(pa.array(order[least_forest(u, v, len(names))], pa.int64()))


def _kruskal(batches):
    """The edges of a partition that close no cycle with smaller ones. As many are added at once as are kept (``PENDING`` at least), so memory follows the nodes and not the edges."""
    kept, more = None, []
    for batch in batches:
        more.append(pa.Table.from_batches([batch]))
        if sum(map(len, more)) >= max(PENDING, 0 if kept is None else len(kept)):
            kept, more = _kept(pa.concat_tables([kept, *more] if kept is not None else more)), []
    if more:
        kept = _kept(pa.concat_tables([kept, *more] if kept is not None else more))
    if kept is not None:
        yield from kept.combine_chunks().to_batches(max_chunksize=1 << 16)


def spanning_tree(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of ``u, v, key`` (keys in total order: r, w, i, j, with i and j the numbers of the ends).

    An edge that closes a cycle with smaller edges is in no minimum tree, so each
    task first drops those of its own partition; of what remains, one task makes
    the tree if it is small, else Boruvka's rounds do.
    """
    schema = edges.select("u", "v", "key").schema
    local = written(edges.select("u", "v", "key").mapInArrow(_kruskal, schema), "forest")
    n = local.df.count()
    while n > MAX_KRUSKAL and (parts := local.df.rdd.getNumPartitions()) > 1:
        # Fewer tasks of more edges each, as long as they drop half of them.
        fewer = written(local.df.repartition(-(-parts // 4)).mapInArrow(_kruskal, schema), "forest")
        local.drop()
        local, before, n = fewer, n, fewer.df.count()
        if 2 * n > before:
            break
    if n <= MAX_KRUSKAL:
        return local.df.coalesce(1).mapInArrow(_kruskal, schema)
    return boruvka(local.df)


def boruvka(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest by rounds over tables.

    Each round takes every component's smallest outgoing edge, joins components by
    alternating stars, and keeps the edges between components. At most log2 n rounds.
    """
    now = written(edges.select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv"), "key").filter("u <> v"), "edges")
    chosen = []
    while not now.df.isEmpty():
        ends = now.df.select(F.col("cu").alias("c"), "u", "v", "cu", "cv", "key").union(now.df.select("cv", "u", "v", "cu", "cv", "key"))
        best = ends.groupBy("c").agg(F.min_by(F.struct("u", "v", "cu", "cv", "key"), "key").alias("e")).select("e.*").distinct()
        took = written(best, "tree")
        chosen.append(took)
        forest = star_forest(took.df, "cu", "cv")
        of = lambda c, new: forest.df.select(F.col("node").alias(c), F.col("component").alias(new))  # noqa: E731, B023
        moved = now.df.join(of("cu", "_u"), "cu", "left").join(of("cv", "_v"), "cv", "left")
        moved = moved.select("u", "v", F.coalesce("_u", "cu").alias("cu"), F.coalesce("_v", "cv").alias("cv"), "key").filter("cu <> cv")
        after = written(moved, "edges")
        now.drop()
        forest.drop()
        now = after
    out = chosen[0].df if chosen else now.df
    for more in chosen[1:]:
        out = out.union(more.df)
    return out.select("u", "v", "key")


def _reach(nodes: DataFrame, spec: DistanceSpec, scale: int) -> Callable[[np.ndarray], np.ndarray]:
    """For rows of alleles a rounded distance each, such that an edge of more than the larger of its ends' is in no minimum tree.

    Some profiles (the hub, of at most ``HUB``) hang together by edges of at most some length; any two nodes are then
    joined by a path whose longest edge is that, or the distance of one of them from the hub. Which profiles these are
    changes nothing but the time that a tree takes.
    """
    some = nodes.orderBy(F.xxhash64("rep")).limit(HUB).select("alleles").toArrow().column("alleles").combine_chunks()
    if len(some) < 2 or spec.missing == "complete_delete":
        return lambda rows: np.full(len(rows), np.iinfo(np.int32).max, np.int32)
    each = lambda d: np.rint(d * scale).astype(np.int32)
    hub = some.flatten().to_numpy().reshape(len(some), -1)
    r = kernels.distances(hub, hub, spec, each=each)
    u, v = np.triu_indices(len(hub), 1)
    order = np.argsort(r[u, v], kind="stable")
    u, v = u[order], v[order]
    tree = least_forest(u, v, len(hub))
    long = r[u[tree], v[tree]]
    # The shortest length by whose edges nine tenths of the hub hang together.
    for length in np.unique(long):
        up = _parts_of(u[tree][long <= length], v[tree][long <= length], len(hub))
        sizes = np.bincount(up, minlength=len(hub))
        if 10 * sizes.max() >= 9 * len(hub):
            core = hub[up == sizes.argmax()]
            break

    def reach(rows: np.ndarray) -> np.ndarray:
        least = [kernels.distances(rows[k : k + HUB], core, spec, each=each).min(axis=1) for k in range(0, len(rows), HUB)]
        return np.maximum(np.concatenate(least), length).astype(np.int32)

    return reach


def _parts_of(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The part, by its least node, of each node of a few edges."""
    up = np.arange(n)
    while True:
        low = np.minimum(up[u], up[v])
        after = up.copy()
        np.minimum.at(after, u, low)
        np.minimum.at(after, v, low)
        after = after[after]
        if (after == up).all():
            return up
        up = after


def block_forests(nodes: DataFrame, ranks: DataFrame, spec: DistanceSpec, scale: int = 1) -> DataFrame:
    """``u, v, key`` (rounded distance, better rank, both idx) of the edges in the minimum tree of some pair of blocks: at most one for each of its nodes.

    An edge that is in no tree of its own pair of blocks closes a cycle with smaller ones, so it is in no minimum tree; all others are never stored.
    Nor are edges beyond the ends' reach, of which only the others are put in order.
    """
    kind, reach = dict(nodes.dtypes)["rep"], _reach(nodes, spec, scale)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alleles = batch.column("alleles")
            far = reach(alleles.flatten().to_numpy().reshape(len(alleles), -1)) if len(batch) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.int32())], names=[*batch.schema.names, "reach"])

    def made(left: pa.Table, right: pa.Table, r: np.ndarray, same: bool) -> pa.Table:
        (wu, iu, fu), (wv, iv, fv) = ([x.column(c).to_numpy() for c in ("rank", "idx", "reach")] for x in (left, right))
        near = r <= np.maximum(fu[:, None], fv[None, :])
        if same:
            near &= np.triu(np.ones(near.shape, bool), 1)
        at = np.flatnonzero(near)
        a, b = at // max(1, near.shape[1]), at % max(1, near.shape[1])
        r, w, i, j = r[a, b], np.minimum(wu[a], wv[b]), np.minimum(iu[a], iv[b]), np.maximum(iu[a], iv[b])
        order = np.lexsort((j, i, w, r))
        chosen = order[least_forest(a[order], (b if same else b + len(left))[order], len(left) + len(right))]
        key = pa.StructArray.from_arrays([pa.array(x[chosen], pa.int64() if k == 0 else pa.int32()) for k, x in enumerate((r, w, i, j))], names=list("rwij"))
        return pa.table({"u": left.column("id").take(pa.array(a[chosen])), "v": right.column("id").take(pa.array(b[chosen])), "key": key})

    rows = nodes.select("rep", "alleles", F.col("idx").cast("int").alias("idx")).join(ranks.select("rep", F.col("rank").cast("int").alias("rank")), "rep")
    rows = rows.mapInArrow(reached, f"rep {kind}, alleles array<int>, idx int, rank int, reach int")
    return by_blocks(rows, spec, made, f"u {kind}, v {kind}, key struct<r: bigint, w: int, i: int, j: int>", "rep", ("rank", "idx", "reach"), each=lambda d: np.rint(d * scale).astype(np.int32))


def shortcuts(full: DataFrame, ranks: DataFrame, n: int) -> DataFrame:
    """``src, dst, length``: for each node its best source within the cutoff, among better-ranked ones."""
    side = lambda end: ranks.select(F.col("rep").alias(end), F.col("rank").alias(f"{end}_rank"))
    near = full.filter(F.col("d") < kernels.cutoff(n) + 1).join(side("src"), "src").join(side("dst"), "dst").filter("src_rank < dst_rank")
    cost = F.col("d") + F.col("src_rank") / n
    return near.groupBy("dst").agg(F.min(F.struct(cost.alias("c"), "src_rank", "src")).alias("b")).select("b.src", "dst", F.floor("b.c").cast("long").alias("length"))


def ready(packed: DataFrame) -> DataFrame:
    """Distinct profiles with an order, as a table: ``rep, size, members, alleles, idx``."""
    return written(indexed(dedup(drop_empty(packed))), "profiles").df


def dense(nodes: DataFrame, spec: DistanceSpec, ranks: DataFrame | None) -> tuple[list, Coded, np.ndarray | None]:
    """Names, the distance matrix and ranks (if there are any) on the driver, for the kernels whose steps follow one another. At most MAX_DENSE nodes.

    Pairs of blocks come one after the other, as bytes, and go straight into the matrix, as codes of their distinct distances.
    """
    rows = nodes.select("rep", "idx")
    rows = (rows.join(ranks, "rep") if ranks is not None else rows).orderBy("idx").toArrow()
    names = rows.column("rep").to_pylist()
    if len(names) > MAX_DENSE:
        raise ValueError(f"{len(names)} profiles: a tree of this kind takes {MAX_DENSE} at most")
    spread = nodes.select("rep", "alleles", F.col("idx").cast("int").alias("idx"))
    distinct = lambda left, right, d, same: pa.table({"d": pa.array(np.unique(d), pa.float64())})
    seen = by_blocks(spread, spec, distinct, "d double", "rep").distinct().limit(MAX_CODES).toArrow().column("d").to_numpy()
    values = np.union1d(seen, [0.0]) if len(seen) < MAX_CODES else None
    kind = code_type(values)

    def made(left: pa.Table, right: pa.Table, d: np.ndarray, same: bool) -> pa.Table:
        one, two = (x.column("idx").to_numpy().astype(np.int32).tobytes() for x in (left, right))
        codes = d if values is None else np.searchsorted(values, d)
        return pa.table({"src": [one], "dst": [two], "d": [np.ascontiguousarray(codes, kind).tobytes()]}, pa.schema([("src", pa.binary()), ("dst", pa.binary()), ("d", pa.binary())]))

    table = written(by_blocks(spread, spec, made, "src binary, dst binary, d binary", "rep", ("idx",)), "blocks")
    codes = np.zeros((len(names), len(names)), kind)
    for row in table.df.toLocalIterator(prefetchPartitions=True):
        src, dst = np.frombuffer(row["src"], np.int32), np.frombuffer(row["dst"], np.int32)
        block = np.frombuffer(row["d"], kind).reshape(len(src), len(dst))
        codes[np.ix_(src, dst)] = block
        if not spec.directed:
            codes[np.ix_(dst, src)] = block.T
    table.drop()
    np.fill_diagonal(codes, 0 if values is None else np.searchsorted(values, 0.0))
    return names, Coded(codes, values), rows.column("rank").to_numpy() if ranks is not None else None


#: Methods that join neighbours; ranks have no part in them.
JOINING = ("NJ", "RapidNJ", "ninja", "fastme")


def _ranked(packed: DataFrame, spec: TreeSpec) -> tuple[DataFrame, DistanceSpec, DataFrame | None]:
    """The distinct profiles, the distance by which a tree is made of them, and their ranks, if it takes any."""
    nodes = ready(packed)
    dist = spec.distance if spec.method in ("MSTree", "distance") else DistanceSpec("symmetric", spec.distance.missing)
    if spec.method in JOINING:
        return nodes, dist, None
    heuristic = "eBurst" if spec.method == "goeBurst" else spec.heuristic
    return nodes, dist, written(node_ranks(nodes, dist, heuristic), "ranks").df


def _lengths(edges: DataFrame, nodes: DataFrame, dist: DistanceSpec) -> DataFrame:
    """``src, dst, length`` of the tree's edges: the loci that differ, or for blockwise distances the distance itself."""
    if dist.matrix == "blockwise":
        return edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), (F.col("key.r") / 10000).alias("length"))
    return link_lengths(edges.select(F.col("u").alias("src"), F.col("v").alias("dst")), nodes, dist.missing)


def tree_table(packed: DataFrame, spec: TreeSpec) -> tuple[DataFrame, DataFrame]:
    """The distinct profiles, and the edges ``src, dst, length`` of a tree of undirected distances without rearrangement: a table from end to end, of any size."""
    spec = spec.resolved()
    nodes, dist, ranks = _ranked(packed, spec)
    if spec.method not in ("MSTree", "goeBurst") or dist.directed or spec.recraft:
        raise ValueError(f"a tree of method {spec.method} is made on the driver")
    return nodes, _lengths(spanning_tree(block_forests(nodes, ranks, dist, 10000 if dist.matrix == "blockwise" else 1)), nodes, dist)


def tree_edges(packed: DataFrame, spec: TreeSpec) -> tuple[DataFrame, list]:
    """The distinct profiles, and the tree's edges [source, target, length] between names."""
    spec = spec.resolved()
    if spec.method in ("MSTree", "goeBurst") and not spec.distance.directed and not spec.recraft:
        nodes, edges = tree_table(packed, spec)
        return nodes, [[r["src"], r["dst"], r["length"]] for r in edges.collect()]
    nodes, dist, ranks = _ranked(packed, spec)
    n = nodes.count()
    loci = nodes.select(F.size("alleles")).first()[0] if n else 0
    if n < 2:
        return nodes, []
    names, d, rank = dense(nodes, dist, ranks)
    if spec.method in JOINING:
        edges = kernels.neighbour_joining(d, weighted=spec.method == "fastme")
        return nodes, [[names[a] if a < n else ("inner", a), names[b] if b < n else ("inner", b), x] for a, b, x in edges]
    if dist.directed:
        edges = kernels.directed_tree(d, rank)
    else:
        place = {name: i for i, name in enumerate(names)}
        edges = [[place[r["u"]], place[r["v"]], r["key"]["r"]] for r in spanning_tree(block_forests(nodes, ranks, dist)).collect()]
    if spec.recraft:
        edges = kernels.recraft(edges, d, rank, loci)
    kind = dict(nodes.dtypes)["rep"]
    table = nodes.sparkSession.createDataFrame([(names[s], names[t], None) for s, t, _ in edges], f"u {kind}, v {kind}, key int")
    return nodes, [[r["src"], r["dst"], r["length"]] for r in _lengths(table, nodes, dist).collect()]
