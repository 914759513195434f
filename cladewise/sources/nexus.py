"""NEXUS files by their tokens: quoted labels, nested comments, annotations, all trees of a file.

A text is words, quoted labels (a doubled quote stands for one), marks and comments
(which nest). Marks cut it into commands, commands into blocks; of these the
``taxa`` block gives labels by number, the ``trees`` block its translation and
trees. Other blocks and commands are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = re.compile(r"\s+")
SINGLE = re.compile(r"'((?:[^']|'')*)'")
DOUBLE = re.compile(r'"([^"]*)"')
BRACKET = re.compile(r"[\[\]]")
#: Marks and words of NEXUS, and of Newick alone, where = and ] are letters like others.
MARKS, WORD = "();,:=", re.compile(r"[^\s()\[\];,:=]+")
NEWICK_MARKS, NEWICK_WORD = "();,:", re.compile(r"[^\s()\[;,:]+")
Token = tuple[str, str]


def lex(text: str, newick: bool = False) -> Iterator[Token]:
    """(kind, value) of each token; kinds are ``word``, ``quoted``, ``comment`` and ``mark``. In Newick alone a quote that is not closed is a letter."""
    marks, word = (NEWICK_MARKS, NEWICK_WORD) if newick else (MARKS, WORD)
    at = 0
    while at < len(text):
        c = text[at]
        if m := SPACE.match(text, at):
            at = m.end()
        elif c in marks:
            yield "mark", c
            at += 1
        elif c == "[":
            depth, end = 0, None
            for m in BRACKET.finditer(text, at):
                depth += 1 if m[0] == "[" else -1
                if not depth:
                    end = m.end()
                    break
            if end is None:
                raise ValueError("a comment is not closed")
            yield "comment", text[at + 1 : end - 1]
            at = end
        elif c in "'\"" and (m := (SINGLE if c == "'" else DOUBLE).match(text, at)):
            yield "quoted", m[1].replace("''", "'") if c == "'" else m[1]
            at = m.end()
        elif c in "'\"]" and not newick:
            raise ValueError("a bracket closes a comment that none opened" if c == "]" else "a quote is not closed")
        else:
            m = word.match(text, at)
            yield "word", m[0]
            at = m.end()


def notes(comment: str) -> dict[str, list[str]]:
    """A comment ``&k=v,k={a,b},k="x,y"`` as a map to lists; commas in braces, brackets and quotes part nothing. Other comments give none."""
    if not comment.startswith("&"):
        return {}
    parts, depth, quote, begin = [], 0, "", 1
    for i, c in enumerate(comment + ",", 0):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
        elif c == "," and depth <= 0 and i:
            parts.append(comment[begin:i])
            begin = i + 1
    plain = lambda x: x.strip().strip("\"'")
    out = {}
    for part in parts:
        key, equals, value = part.partition("=")
        if equals and key.strip():
            value = value.strip()
            out[key.strip().lstrip("!")] = [plain(x) for x in value[1:-1].split(",")] if value.startswith("{") else [plain(value)]
    return out


def commands(tokens: Iterator[Token]) -> Iterator[list[Token]]:
    """The tokens of each command, without the mark that ends it; comments stand only where a command has begun."""
    now: list[Token] = []
    for token in tokens:
        if token == ("mark", ";"):
            yield now
            now = []
        elif now or token[0] != "comment":
            if not (token[0] == "word" and not now and token[1].upper() == "#NEXUS"):
                now.append(token)
    if now:
        yield now


class NexusTree(NamedTuple):
    """A tree of a file: its name, whether it is the default, rooted or not (None where nothing says so), and rows of nodes."""

    name: str
    default: bool
    rooted: bool | None
    rows: list[tuple]


class Nexus(NamedTuple):
    """The labels of the taxa block, and the trees."""

    taxa: list[str]
    trees: list[NexusTree]


def parse(text: str) -> Nexus:
    """A whole file."""
    from cladewise.sources.trees import build

    taxa: list[str] = []
    found: list[NexusTree] = []
    block, names = None, None
    for command in commands(lex(text)):
        words = [t for t in command if t[0] != "comment"]
        if not words:
            continue
        verb = words[0][1].lower() if words[0][0] == "word" else ""
        if verb == "begin" and len(words) > 1:
            block = words[1][1].lower()
        elif verb in ("end", "endblock"):
            block = None
        elif block == "taxa" and verb == "taxlabels":
            taxa += [x for kind, x in words[1:] if kind != "mark"]
        elif block == "trees" and verb == "translate":
            names = names or {}
            pair: list[str] = []
            for kind, x in [*words[1:], ("mark", ",")]:
                if kind != "mark":
                    pair.append(x)
                elif pair:
                    if len(pair) != 2:
                        raise ValueError(f"{' '.join(pair)} translates nothing")
                    names[pair[0]] = pair[1]
                    pair = []
        elif block == "trees" and verb in ("tree", "utree"):
            found.append(_tree(command, _labels(taxa) if names is None else names, build))
    return Nexus(taxa, found)


def _labels(taxa: list[str]) -> dict[str, str]:
    """Numbers for labels, but for those that are labels themselves."""
    numbers = {str(i): label for i, label in enumerate(taxa, 1)}
    return {k: v for k, v in numbers.items() if k not in taxa}


def _tree(command: list[Token], names: dict[str, str], build) -> NexusTree:
    equals = next((i for i, t in enumerate(command) if t == ("mark", "=")), None)
    head = [t for t in command[1:equals] if t[0] != "comment"]
    if equals is None or not head:
        raise ValueError("a tree without a name or without =")
    label = head[-1][1]
    default = head[0] == ("word", "*") or (head[0][0] == "word" and label.startswith("*"))
    rooted, at = None, equals + 1
    while at < len(command) and command[at][0] == "comment":
        mark = command[at][1].strip().upper()
        rooted = {"&R": True, "&U": False}.get(mark, rooted)
        at += 1
    return NexusTree(label.lstrip("*") if head[-1][0] == "word" else label, default, rooted, build(command[at:], names))


def nexus_trees(df: DataFrame, text_col: str = "text", key_col: str = "tree_id") -> DataFrame:
    """All trees of many files, one text each: ``key, tree, is_default, rooted``, the columns of a node table, and ``error``.

    A text that is no NEXUS file has one row, with what is wrong with it; null texts have none.
    """
    from cladewise.sources.trees import NODES

    kind = dict(df.dtypes)[key_col]
    schema = f"{key_col} {kind}, tree string, is_default boolean, rooted boolean, {NODES}, error string"
    nodes = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.bool_(), pa.map_(pa.string(), pa.list_(pa.string())))
    node_names = [c.split()[0] for c in re.split(r", (?=\w+ )", NODES)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                if text is None:
                    continue
                try:
                    rows = [(t.name, t.default, t.rooted, *row, None) for t in parse(text).trees for row in t.rows]
                except ValueError as wrong:
                    rows = [(None,) * (3 + len(nodes)) + (str(wrong),)]
                columns = list(zip(*rows, strict=True)) or [()] * (4 + len(nodes))
                annotated = [None if x is None else list(x.items()) for x in columns[2 + len(nodes)]]
                arrays = [pa.array(x, t) for x, t in zip([*columns[: 2 + len(nodes)], annotated, columns[-1]], (pa.string(), pa.bool_(), pa.bool_(), *nodes, pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(rows), pa.int64())), *arrays], names=[key_col, "tree", "is_default", "rooted", *node_names, "error"])

    return df.select(key_col, text_col).mapInArrow(each, schema)
