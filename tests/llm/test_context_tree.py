"""op12: scores against a context tree that is updated and weighed as a whole, the base by counting, layouts, dirty tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladewise.llm import arrow_text, op12_context_tree
from tests.llm.helpers import LONG, crc, dirty, empty, lower, words

SF = "/root/testdata/sf0.01"


def spelled(text):
    """The bytes that are predicted."""
    return " ".join(words(lower(text))).encode() + b"\xff"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\né\x0b|", max_size=30), max_size=8), st.integers(1, 4))
def test_layout(found, depth):
    data, begin = op12_context_tree.laid_out(*arrow_text.texts(pa.array(found, pa.string())), depth)
    got = [data[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]
    assert got == [b"\xff" * depth + spelled(x) for x in found]
    keys, at = op12_context_tree.runs(data, begin, depth)
    want = [int.from_bytes(x[i : i + depth + 1], "big") for x in got for i in range(len(x) - depth)]
    assert keys.tolist() == want
    assert at.tolist() == np.cumsum([0, *(len(x) - depth for x in got)])[:-1].tolist()
    keys, first = op12_context_tree.word_keys(data, begin)
    assert np.diff(first).tolist() == [len(words(x)) for x in found] and (keys < 0).all()


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 10.5, 1000, 1e9 + 0.5])
    assert op12_context_tree.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-10)


class Tree:
    """All nodes of all decisions; a chance is the ratio of the root's weighted probabilities with and without one more bit."""

    def __init__(self, depth):
        self.depth, self.n, self.below = depth, defaultdict(lambda: [0, 0]), defaultdict(set)

    def learn(self, text):
        data = b"\xff" * self.depth + spelled(text)
        for i in range(self.depth, len(data)):
            for prefix, bit in self.bits(data[i]):
                for d in range(self.depth + 1):
                    self.n[data[i - d : i], prefix][bit] += 1
                    if d:
                        self.below[data[i - d + 1 : i], prefix].add(data[i - d : i])

    @staticmethod
    def bits(byte):
        return [((1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1) for j in range(8)]

    def weighted(self, context, prefix, path=None, bit=0):
        n = list(self.n.get((context, prefix), (0, 0)))
        on = path is not None and path.endswith(context)
        if on:
            n[bit] += 1
        own = math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)
        if len(context) == self.depth or not sum(n):
            return own
        children = set(self.below[context, prefix]) | ({path[len(path) - len(context) - 1 :]} if on else set())
        deeper = sum(self.weighted(c, prefix, path if on else None, bit) for c in children)
        return np.logaddexp(own, deeper) - math.log(2)

    def score(self, text):
        data, total = b"\xff" * self.depth + spelled(text), 0.0
        for i in range(self.depth, len(data)):
            for prefix, bit in self.bits(data[i]):
                total += self.weighted(b"", prefix, data[i - self.depth : i], bit) - self.weighted(b"", prefix)
        return total / math.log(10)


def base(rows, held):
    """(n_tokens, n_known, train_tokens, base_score) by counting."""
    tokens = [[*words(lower(x)), None] for x in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n = sum(c.values())
    return [(len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in t)) for t in tokens]


TEXTS = ["the cat sat", "The  dog sat on a mat", "", None, "a cat", "the cat sat", "é ü", "zebra", "the dog and a cat sat", " a\tb "]


def found(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("depth", [1, 3])
def test_against_whole_tree(spark, monkeypatch, depth):
    held = [i % 4 == 3 for i in range(len(TEXTS))]
    docs = spark.createDataFrame([(i, x, h, "own") for i, (x, h) in enumerate(zip(TEXTS, held))], "doc_id long, text string, split boolean, key string")
    tree = Tree(depth)
    for x, h in zip(TEXTS, held):
        if not h:
            tree.learn(x)
    want = sorted(((i, h, *b[:3], round(b[3], 6), round(tree.score(x), 6)) for i, (x, h, b) in enumerate(zip(TEXTS, held, base(TEXTS, held)))), key=repr)
    assert found(op12_context_tree.scores(docs, F.col("split"), depth=depth)) == want
    # Many splits and parts, merged keys: the same.
    monkeypatch.setattr(op12_context_tree, "SPLIT", 12)
    monkeypatch.setattr(op12_context_tree, "PART", 6)
    monkeypatch.setattr(op12_context_tree, "WAITING", 3)
    assert found(op12_context_tree.scores(docs.repartition(3), F.col("split"), depth=depth)) == want
    bits = {r["doc_id"]: r["bits_per_byte"] for r in op12_context_tree.scores(docs, F.col("split"), depth=depth).collect()}
    assert bits[0] == pytest.approx(-tree.score(TEXTS[0]) * math.log2(10) / len(spelled(TEXTS[0])))


def test_dirty_tables(spark):
    docs = dirty(spark, [(50, LONG + " never seen"), (51, "x" * 100_000)])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = [crc("" if i is None else i) % 7 == 2 for i, _ in rows]
    got = found(op12_context_tree.scores(docs, op12_context_tree.held_out_fold(F.col("doc_id"))))
    want = sorted(((i, h, *b[:3], round(b[3], 6)) for (i, _), h, b in zip(rows, held, base([x for _, x in rows], held))), key=repr)
    assert [g[:6] for g in got] == want and all(math.isfinite(g[6]) and g[6] < 0 for g in got)
    assert op12_context_tree.scores(empty(spark), F.lit(False)).count() == 0
    untrained = found(op12_context_tree.scores(docs.filter("doc_id in (5, 2)"), F.lit(True)))
    assert [(g[3], g[4], g[5]) for g in untrained] == [(0, 0, 0.0)] * 2
    assert {g[0]: g[6] for g in untrained}[2] == pytest.approx(8 * math.log10(0.5), abs=1e-6)


def test_held_out_texts(spark):
    """More depth, shorter codes on texts that were not learned from."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {d: op12_context_tree.scores(docs, op12_context_tree.held_out_fold(F.col("doc_id")), depth=d).filter("held_out").agg(F.sum("score"), F.avg("bits_per_byte")).first() for d in (1, 5)}
    assert rows[5][0] > rows[1][0] and rows[5][1] < rows[1][1]
