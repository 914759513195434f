"""Newick, PHYLIP, tables, projects and splits as text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions.kernels import distances, rounded
from cladewise.model import DistanceSpec
from cladewise.operators import distance
from cladewise.operators.numbering import numbered
from cladewise.operators.profile import complete_loci
from cladewise.plans.storage import written

#: Text of PHYLIP lines that a task holds at once, about.
LINE_BYTES = 1 << 25


def number(x: float) -> str:
    """A branch length: up to six significant digits."""
    return f"{x:g}"


def newick(nodes: list[tuple]) -> str:
    """Of (node, parent, name, length) rows, children in the order given; the root has no parent."""
    below: dict = {}
    root = None
    for row in nodes:
        if row[1] is None:
            root = row
        else:
            below.setdefault(row[1], []).append(row)
    if root is None:
        return ";"
    done: dict = {}
    stack = [(root, False)]
    while stack:
        row, ready = stack.pop()
        kids = below.get(row[0], [])
        if kids and not ready:
            stack.append((row, True))
            stack += [(k, False) for k in kids]
            continue
        inner = "(" + ",".join(done.pop(k[0]) for k in kids) + ")" if kids else ""
        text = inner + (row[2] or "").replace("'", "")
        done[row[0]] = text + (f":{number(row[3] or 0)}" if row is not root else "")
    return done[root[0]] + ";"


def phylip_rows(full: DataFrame, order: tuple[str, ...] = ("src_rep", "src"), to: tuple[str, ...] = ("dst_rep", "dst")) -> DataFrame:
    """``name, line``: a PHYLIP row of each member, its distances in the same order of members as the rows."""
    cells = F.sort_array(F.collect_list(F.struct(*to, "d")))
    rows = full.groupBy(*order).agg(cells.alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.format_string("%.6f", F.round(x["d"], 6))), " ")
    return rows.select(*order, F.concat(F.rpad(F.col(order[-1]).cast("string"), 10, " "), F.lit(" "), text).alias("line"))


def phylip_lines(reps: DataFrame, loci: int, spec: DistanceSpec) -> DataFrame:
    """``src_rep, src, line``: what ``phylip_rows`` makes of the ``normalised`` distances of all members, straight from the profiles ``rep, size, members, alleles``.

    A task takes a few sources by all targets, block after block, and holds the text of their lines alone; no distance is stored or shuffled.
    """
    kind, scale = dict(reps.dtypes)["rep"], float(loci) if spec.scaled else 1.0
    n, members = reps.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks, some = max(1, -(-n // distance.BLOCK)), max(1, min(64, LINE_BYTES // (9 * max(1, members))))
    whole = np.array(complete_loci(reps), int) if (spec.matrix, spec.missing) == ("symmetric", "complete_delete") else None
    presence = distance.presence_weights(reps.select("rep", "alleles"), n) if spec.matrix == "asymmetric_wgMLST" else None
    placed = written(numbered(reps, ["rep"]), "targets").df
    cell = F.struct("place", "rep", "alleles", "size")
    targets = placed.groupBy(F.floor((F.col("place") - 1) / distance.BLOCK).cast("int").alias("two")).agg(F.array_sort(F.collect_list(cell)).alias("right")).repartition(1)
    sources = placed.groupBy(F.floor((F.col("place") - 1) / some).cast("int").alias("one")).agg(F.collect_list(F.struct("rep", "alleles", "members")).alias("left"))
    cores = reps.sparkSession.sparkContext.defaultParallelism
    sources = sources.repartition(max(1, min(-(-n // some), distance.WAVES * cores)))

    def text(d: np.ndarray) -> np.ndarray:
        return np.array([b"%.6f " % x for x in rounded(d / scale).ravel()]).reshape(d.shape)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, dict[int, list[bytes]]] = {}
        for batch in batches:
            for k in range(len(batch)):
                left, right = (pa.Table.from_struct_array(batch.column(c)[k].values) for c in ("left", "right"))
                one, two = batch.column("one")[k].as_py(), batch.column("two")[k].as_py()
                cells = distances(distance._matrix(left.column("alleles")), distance._matrix(right.column("alleles")), spec, whole, presence, text)
                at = {x: j for j, x in enumerate(right.column("rep").to_pylist())}
                for i, x in enumerate(left.column("rep").to_pylist()):
                    if x in at:
                        cells[i, at[x]] = b"0.000000 "
                sizes = right.column("size").to_numpy()
                if (sizes > 1).any():
                    cells = np.repeat(cells, sizes, axis=1)
                pieces = waiting.setdefault(one, {})
                pieces[two] = [row.tobytes().translate(None, b"\0") for row in cells]
                if len(pieces) == blocks:
                    for i, (rep, names) in enumerate(zip(left.column("rep").to_pylist(), left.column("members").to_pylist(), strict=True)):
                        line = b"".join(pieces[b][i] for b in range(blocks))[:-1].decode()
                        for name in names:
                            yield pa.RecordBatch.from_arrays([pa.array([rep], left.column("rep").type), pa.array([name], left.column("rep").type), pa.array([f"{str(name)[:10]:10} {line}"])], names=["src_rep", "src", "line"])
                    del waiting[one]

    pairs = sources.join(targets.hint("shuffle_replicate_nl")).select("one", "left", "two", "right")
    return pairs.mapInArrow(kernel, f"src_rep {kind}, src {kind}, line string")


def phylip_header(n: int) -> str:
    """A PHYLIP matrix's first line."""
    return f"    {n}"


def shown(value: Column) -> Column:
    """A cell of an exported table: empty for null."""
    return F.coalesce(value.cast("string"), F.lit(""))


def write_table(df: DataFrame, path: str, sep: str = "\t", without: tuple[str, ...] = ()) -> None:
    """A delimited table with a header, without some columns."""
    df.select(*[shown(F.col(c)).alias(c) for c in df.columns if c not in without]).write.csv(path, sep=sep, header=True, emptyValue="")


def project(nodes: DataFrame, metadata: DataFrame | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """One JSON document: nodes, links, metadata and options. (A document is one row, so it suits trees that a viewer can load.)"""
    links = nodes.filter("parent_id is not null").agg(F.array_sort(F.collect_list(F.struct(F.col("parent_id").alias("source"), F.col("node_id").alias("target"), F.col("length").alias("distance")))).alias("links"))
    names = nodes.agg(F.array_sort(F.collect_list("node_id")).alias("nodes"))
    out = names.crossJoin(links)
    if metadata is not None:
        out = out.crossJoin(metadata.agg(F.collect_list(F.struct(*metadata.columns)).alias("metadata")))
    for k, v in (options or {}).items():
        out = out.withColumn(k, F.lit(v))
    return out.select(F.to_json(F.struct(*out.columns)).alias("project"))


def projects(nodes: DataFrame, key: str) -> DataFrame:
    """``key, project``: a JSON document of nodes and links for each of many trees of ``key, node_id, parent_id, length``."""
    link = F.when(F.col("parent_id").isNotNull(), F.struct(F.col("parent_id").alias("source"), F.col("node_id").alias("target"), F.col("length").alias("distance")))
    each = nodes.groupBy(key).agg(F.array_sort(F.collect_list("node_id")).alias("nodes"), F.array_sort(F.collect_list(link)).alias("links"))
    return each.select(key, F.to_json(F.struct("nodes", "links")).alias("project"))


def split_line(left: Column, right: Column) -> Column:
    """``a,b|c,d``."""
    return F.concat(F.array_join(left, ","), F.lit("|"), F.array_join(right, ","))


def share_payload(nodes: DataFrame, metadata: DataFrame, colours: dict[str, dict[str, str]] | None = None, key: str = "ID") -> tuple[str, DataFrame]:
    """What a map service takes: the Newick text of the leaves that have metadata, and their rows with positions, dates as whole numbers and a colour column for each coloured one. (Nothing is sent.)"""
    from cladewise.operators import metadata as meta
    from cladewise.operators.tree import induced

    leaves = nodes.filter("not is_hypo").join(metadata.select(F.col(key).alias("node_id")).distinct(), "node_id", "left_semi")
    rows = [(r["node_id"], r["parent_id"], None if r["is_hypo"] else r["node_id"], r["length"]) for r in induced(nodes, leaves).orderBy("node_id").collect()]
    table = meta.aliased(metadata.join(leaves.select(F.col("node_id").alias(key)), key, "left_semi"), {"latitude": ("^lat", ""), "longitude": ("^lon", ""), "year": ("year", ""), "month": ("month", ""), "day": ("(^|[^a-z])day", "")})
    table = table.withColumns({c: meta.whole_number(F.col(c)) for c in ("year", "month", "day")})
    for column, palette in (colours or {}).items():
        table = table.withColumn(f"{column}__colour", meta.colours(F.col(column), palette))
    return newick(rows), table.select(*meta.distinct_columns(table.columns))
