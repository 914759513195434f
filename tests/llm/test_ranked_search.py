"""op13: bit-sliced sums and their best against plain numbers, the query against its SQL, brute force on dirty tables."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cladewise.llm import op13_ranked_search
from tests.llm.helpers import dirty, empty, lower, tuples
from tests.oracle import same

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 127), st.integers(0, 5)), st.integers(1, 2**36), min_size=1, max_size=80), st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=9), min_size=1, max_size=4), st.integers(1, 30))
def test_sums_and_best(found, items, k):
    cells = sorted(found)
    slices = op13_ranked_search.Slices(np.array([d for d, _ in cells]), np.array([t for _, t in cells]), np.array([found[c] for c in cells]))
    at = {t: i for i, t in enumerate(slices.terms.tolist())}
    asked = sorted(([t for t in x if t in at] for x in items), key=len, reverse=True)
    asked = [x for x in asked if x]
    if not asked:
        return
    item, doc, score = op13_ranked_search.best(slices.sums([np.array([at[t] for t in x]) for x in asked]), k)
    want = []
    for i, x in enumerate(asked):
        scores = {d: sum(found.get((d, t), 0) for t in x) for d in range(128)}
        want += [(i, d, s) for d, s in sorted(scores.items(), key=lambda e: (-e[1], e[0]))[:k] if s > 0]
    assert sorted(zip(item.tolist(), doc.tolist(), score.tolist())) == sorted(want)


def brute(docs, items):
    """(item_id, rank, doc_id, score) by sorting all scores."""
    held = [(i, Counter(TERMS.findall(lower(text)))) for i, text in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    out = []
    for item, text in set(items):
        score = Counter()
        for term, times in Counter(TERMS.findall(lower(text))).items():
            df = sum(term in c for _, c, _ in held)
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            for k, (_, c, n) in enumerate(held):
                score[k] += times * w * ((1_000_000_000 * c[term]) // (1000 * c[term] + 12 * (75 + 25 * n * n_docs // n_terms)))
        rows = sorted((-s, held[k][0] is None, held[k][0] or 0) for k, s in score.items() if s > 0)[:20]
        out += [(item, place, None if none else i, -s) for place, (s, none, i) in enumerate(rows, 1)]
    return sorted(out, key=repr)


def test_dirty_tables(spark, monkeypatch):
    more = [(i, " ".join(f"Word{(i * j) % 23}" for j in range(i % 40))) for i in range(20, 420)] + [(7000, "alpha beta")] * 50 + [(7001 + i, "gamma") for i in range(200)]
    docs, asked = dirty(spark, more), [(1, "word1 word2 the same words again WORD1"), (2, None), (3, ""), (4, "gamma"), (5, "ALPHA é unheard"), (5, "beta"), (5, "beta"), (None, "one text again"), (6, "unheard")]
    items = spark.createDataFrame([(i, x, 1) for i, x in asked], "item_id int, text string, score int")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], asked)
    columns = ("item_id", "rank", "doc_id", "score")
    assert tuples(op13_ranked_search.search(docs, items), *columns) == want
    monkeypatch.setattr(op13_ranked_search, "BLOCK", 64)
    monkeypatch.setattr(op13_ranked_search, "LOT_BYTES", 16)
    assert tuples(op13_ranked_search.search(docs.coalesce(1), items), *columns) == want
    assert op13_ranked_search.search(empty(spark), items).count() == 0
    assert op13_ranked_search.search(docs, items.limit(0)).count() == 0


def test_query(spark):
    same(spark, op13_ranked_search.op13_ranked_search, op13_ranked_search.OP13_SQL, "/root/testdata/sf0.01")
