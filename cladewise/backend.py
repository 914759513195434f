"""Profile in, tree or matrix out: the library's single entry for whole runs, and its command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions.estimate import estimate
from cladewise.model import HEURISTICS, METHODS, POLICIES, DistanceSpec, TreeSpec
from cladewise.operators import mst, tree
from cladewise.operators.profile import complete_delete, dedup, drop_empty, duplicate_names, encode, pack
from cladewise.plans.storage import written
from cladewise.sources import sinks
from cladewise.sources.profile_files import read_profile


def load(spark: SparkSession, profile: str) -> DataFrame:
    """A packed, encoded profile of a file or a literal text; names must be distinct."""
    long = written(encode(read_profile(spark, profile)), "profile").df
    loci = (long.agg(F.max("locus")).first()[0] or 0) + 1
    if not (twice := long.groupBy("sample", "locus").count().filter("count > 1").limit(1)).isEmpty():
        raise ValueError(f"two samples are named {twice.first()['sample']}")
    packed = pack(long, loci)
    if not duplicate_names(packed).isEmpty():
        raise ValueError("sample names are not distinct")
    return packed


def tree_text(packed: DataFrame, spec: TreeSpec) -> str:
    """The Newick text of a packed profile's tree, with equal samples side by side."""
    if spec.distance.missing == "complete_delete":
        packed = complete_delete(packed)
    nodes, edges = mst.tree_edges(packed, spec)
    groups = {str(r["rep"]): r["members"] for r in nodes.filter("size > 1").select("rep", "members").toLocalIterator()}
    names = [r["rep"] for r in nodes.select("rep").limit(1).collect()]
    if spec.method in ("NJ", "RapidNJ", "ninja", "fastme"):
        root = edges[-1][0] if edges else None
        rows = [(root, None, None if isinstance(root, tuple) else str(root), 0.0)] + [(t, s, None if isinstance(t, tuple) else str(t), x) for s, t, x in edges] if edges else tree.rooted_nodes([], names)
        rows = tree.midpoint(rows)
    else:
        rows = tree.rooted_nodes(edges, names)
    return sinks.newick(tree.expand_groups(tree.smooth(rows), groups))


def matrix_rows(packed: DataFrame, spec: DistanceSpec) -> DataFrame:
    """PHYLIP rows in order: ``src_rep, src, line``."""
    if spec.missing == "complete_delete":
        packed = complete_delete(packed)
    nodes = written(dedup(drop_empty(packed)), "profiles").df
    loci = nodes.select(F.size("alleles")).first()[0]
    return sinks.phylip_lines(nodes, loci, spec).orderBy("src_rep", "src")


def backend(spark: SparkSession, profile: str, method: str = "MSTreeV2", matrix_type: str = "symmetric", heuristic: str = "eBurst", branch_recraft: bool = False, handle_missing: str = "pair_delete", wgMLST: bool = False, n_proc: int = 5, checkEnv: bool = False, block_penalty: float = 0.01) -> str:  # noqa: N803
    """A Newick tree, a PHYLIP matrix (``method='distance'``) or, with ``checkEnv``, the expected time and memory as JSON."""
    kind = "asymmetric_wgMLST" if wgMLST and matrix_type == "asymmetric" else matrix_type
    spec = TreeSpec(method, DistanceSpec(kind, handle_missing, float(block_penalty)), heuristic, branch_recraft)
    packed = load(spark, profile)
    if checkEnv:
        nodes = dedup(drop_empty(packed))
        one = nodes.agg(F.count("*").cast("double").alias("n"), F.max(F.size("alleles")).cast("double").alias("loci"))
        seconds, size = estimate(F.col("n"), F.col("loci"), method, matrix_type, n_proc)
        row = one.select(seconds.alias("time"), size.alias("memory")).first()
        free = spark._jvm.java.lang.Runtime.getRuntime().maxMemory()
        return json.dumps({"time": row["time"], "memory": row["memory"], "affordable": row["memory"] is not None and free >= row["memory"]})
    if method == "distance":
        lines = [r["line"] for r in matrix_rows(packed, spec.distance).toLocalIterator()]
        return "\n".join([sinks.phylip_header(len(lines)), *lines])
    return tree_text(packed, spec)


def main(arguments: list[str] | None = None) -> None:
    """The command line."""
    p = argparse.ArgumentParser(prog="cladewise", description="A tree or distance matrix of a profile or aligned sequences.")
    p.add_argument("--profile", "-p", required=True, help="a tab-separated profile or aligned FASTA")
    p.add_argument("--method", "-m", default="MSTreeV2", choices=METHODS)
    p.add_argument("--matrix", "-x", default="symmetric", choices=("symmetric", "asymmetric", "blockwise"))
    p.add_argument("--recraft", "-r", action="store_true", help="move branches locally (MSTreeV2 does)")
    p.add_argument("--missing", "-y", default=0, type=int, choices=range(4), help=", ".join(f"{i}: {x}" for i, x in enumerate(POLICIES)))
    p.add_argument("--wgMLST", "-w", action="store_true")
    p.add_argument("--heuristic", "-t", default="eBurst", choices=HEURISTICS)
    p.add_argument("--n_proc", "-n", default=5, type=int, help="processes assumed by --check")
    p.add_argument("--check", "-c", action="store_true", help="only the expected time and memory")
    p.add_argument("--block_penalty", "-b", default=0.01, type=float)
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("cladewise").getOrCreate()
    print(backend(spark, a.profile, a.method, a.matrix, a.heuristic, a.recraft, POLICIES[a.missing], a.wgMLST, a.n_proc, a.check, a.block_penalty))


if __name__ == "__main__":
    main()
