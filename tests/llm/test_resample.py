"""op11: the CRC algebra against zlib, the query against its SQL, brute force on dirty tables."""

import hashlib
import math
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cladewise.llm import crc_algebra, op11_resample
from tests.llm.helpers import dirty, empty, lower, tuples
from tests.oracle import same

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80), min_size=2, max_size=6))
def test_crc_of_joined_parts(parts):
    data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(x) for x in parts])
    starts = ends - [len(x) for x in parts]
    crcs = crc_algebra.crc_words(data, starts, ends)
    assert crcs.tolist() == [zlib.crc32(x) for x in parts]
    joined = crc_algebra.shift(crcs[:-1], (ends - starts)[1:]) ^ crcs[1:]
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in zip(parts, parts[1:])]


def test_shift_by_a_long_text():
    long = b"xyz" * 400_001
    one = np.array([zlib.crc32(b"abc")], np.uint32)
    assert int((crc_algebra.shift(one, np.array([len(long)])) ^ np.uint32(zlib.crc32(long)))[0]) == zlib.crc32(b"abc" + long)


def runs(text):
    """All features of a text, written out."""
    found = TERMS.findall(lower(text))
    return [" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def brute(docs, items):
    """(doc_id, n_features, weight, score, rank) of each row of (doc_id, text)."""
    bucket = lambda x: zlib.crc32(x.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for text, into in [(text, s) for _, text in docs] + [(text, t) for text in items]:
        for x in runs(text):
            into[bucket(x)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in runs(text))
        rows.append([i, len(runs(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(TERMS.findall(lower(text)))])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(able, 1):
        r[4] = place if place <= 5 * len(able) // 100 else None
    return [tuple(r if r[4] is None or any(r is x for x in able) else [*r[:4], None]) for r in rows]


def test_dirty_tables(spark, monkeypatch):
    more = [(i, " ".join(f"Word{(i * j) % 17}" for j in range(i % 60))) for i in range(20, 120)] + [(20, "é" * 3 + " x" * 40)] * 30
    docs, items = dirty(spark, more), ["word1 word2 the same words again", None, "", "É x x x"]
    target = spark.createDataFrame([(i, x, "text") for i, x in enumerate(items)], "item_id int, text string, doc_id string")
    want = sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()], items), key=repr)
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    assert tuples(op11_resample.resample(docs, target), *columns) == want
    monkeypatch.setattr(op11_resample, "STRETCH", 3)
    assert tuples(op11_resample.weights(docs, np.ones(10000, np.int64)), "doc_id", "n_features", "weight") == sorted(((w[0], w[1], w[1]) for w in want), key=repr)
    assert op11_resample.resample(empty(spark), target).count() == 0
    none = op11_resample.resample(docs, target.limit(0))
    assert none.count() == docs.count() and none.filter("rank is not null").count() == 5 * none.filter("n_words >= 20").count() // 100


def test_query(spark):
    same(spark, op11_resample.op11_resample, op11_resample.OP11_SQL, "/root/testdata/sf0.001")
