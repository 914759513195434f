"""Newick, NEXUS and project documents to node and link tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from itertools import takewhile

from pyspark.sql import DataFrame, SparkSession

from cladewise.sources.nexus import Token, lex, notes, parse

NODES = "node_id string, parent_id string, name string, length double, depth int, is_hypo boolean, annotations map<string,array<string>>"


def annotations(comment: str) -> dict[str, list[str]]:
    """``[&k=v,k={a,b}]`` as a map to lists."""
    return notes(comment[1:-1])


def parse_newick(text: str, translate: dict[str, str] | None = None) -> list[tuple]:
    """Rows of NODES in preorder. Inner nodes are named ``_hypo_<preorder number>``; their labels (support values) are dropped; a missing length is null."""
    return build(takewhile(lambda t: t != ("mark", ";"), lex(text, newick=True)), translate)


def build(tokens: Iterable[Token], translate: dict[str, str] | None = None) -> list[tuple]:
    """Rows of NODES of a tree's tokens."""
    children: list[list[int]] = [[]]
    label, length, found, parent = [""], [None], [{}], [-1]
    at, colon = 0, False
    for kind, token in tokens:
        if kind == "comment":
            found[at] |= notes(token)
        elif kind != "mark":
            if colon:
                length[at], colon = float(token), False
            else:
                label[at] = (translate or {}).get(token, token)
        elif token in "(,":
            owner = at if token == "(" else parent[at]
            if owner < 0:
                raise ValueError("a comma outside all brackets")
            children.append([])
            label.append("")
            length.append(None)
            found.append({})
            parent.append(owner)
            at = len(parent) - 1
            children[owner].append(at)
            colon = False
        elif token == ")":
            at, colon = parent[at], False
            if at < 0:
                raise ValueError("a bracket closes that none opened")
        elif token == ":":
            colon = True
        else:
            raise ValueError(f"{token} within a tree")
    if parent[at] >= 0:
        raise ValueError("a bracket is not closed")
    rows, ids, stack, n = [], {}, [(0, 0)], 0
    while stack:
        v, depth = stack.pop()
        inner = bool(children[v])
        ids[v] = f"_hypo_{n}" if inner else label[v]
        rows.append((ids[v], ids.get(parent[v]), None if inner else label[v], length[v], depth, inner, found[v]))
        n += 1
        stack += [(c, depth + 1) for c in reversed(children[v])]
    return rows


def parse_nexus(text: str) -> list[tuple]:
    """Rows of NODES of the first tree of a NEXUS file, with its translation; without one, numbers stand for the labels of the ``taxa`` block."""
    found = parse(text).trees
    if not found:
        raise ValueError("no tree")
    return found[0].rows


def taxa(text: str) -> list[str]:
    """The labels of the ``taxa`` block, quoted or plain."""
    return parse(text).taxa


def tree_list(text: str) -> list[tuple[str, list[tuple]]]:
    """(name, rows of NODES) of each ``tree NAME = newick`` line; a leaf ``{a,b}`` becomes a node with the leaves a and b."""
    out = []
    for name, newick in re.findall(r"^\s*tree\s+(\S+)\s*=\s*(?:\[[^\]]*\]\s*)*(\S.*?;)\s*$", text, re.I | re.M):
        out.append((name, parse_newick(re.sub(r"\[?\{([^}]*)\}\]?", lambda m: "(" + ",".join(f"{x.strip()}:0" for x in m[1].split(",")) + ")", newick))))
    return out


def parse_project(text: str) -> list[tuple]:
    """A JSON project (with nodes and links, or a tree), else NEXUS, else Newick."""
    try:
        project = json.loads(text)
    except ValueError:
        return parse_nexus(text) if text.lstrip()[:6].upper() == "#NEXUS" else parse_newick(text)
    if "nodes" not in project:
        return parse_newick(project.get("tree") or project["nwk"])
    names = [f"_hypo_{i}" if n == "hypothetical_node" else n for i, n in enumerate(project["nodes"])]
    up = {names[x["target"]]: (names[x["source"]], float(x["distance"])) for x in project["links"]}

    def depth(n: str) -> int:
        d = 0
        while n in up:
            n, d = up[n][0], d + 1
        return d

    return [(n, up.get(n, (None,))[0], None if n.startswith("_hypo_") else n, up[n][1] if n in up else None, depth(n), n.startswith("_hypo_"), {}) for n in names]


def read_tree(spark: SparkSession, text: str) -> DataFrame:
    """The node table of a tree text of any of these forms."""
    return spark.createDataFrame(parse_project(text), NODES)


def parse_trees(df: DataFrame, text_col: str = "text", key_col: str = "tree_id") -> DataFrame:
    """Node tables of many trees, one text each: ``key, nodes...``; each row is parsed on its own executor."""
    import pandas as pd

    kind = dict(df.dtypes)[key_col]

    def each(frames):
        for frame in frames:
            rows = [(k, *row) for k, text in zip(frame[key_col], frame[text_col], strict=True) for row in parse_project(text)]
            yield pd.DataFrame(rows, columns=[key_col, *(c.split()[0] for c in NODES.split(", "))])

    return df.select(key_col, text_col).mapInPandas(each, f"{key_col} {kind}, {NODES}")
