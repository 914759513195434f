"""Ranked lexical search over bit-sliced impacts.

What a term adds to a document's score is a whole number, its impact. For a block
of documents each term has one bitmap for each bit of its impacts; the terms of an
item are added up for all documents of the block at once, by the carry arithmetic
of a ripple adder over these bitmaps, and the best ``TOP`` are found from the most
significant sum bitmap down, without looking at any single score.

A first pass over the documents gives each sought term's document frequency and the
lengths; a second one slices block after block, ranks it for all items and keeps
each item's best, so a task sends on at most ``TOP`` rows for each item, whatever
it read. Only terms that an item holds are sliced. Items go in lots of about
``LOT_BYTES`` of text, each with its two passes, so what is sent to the tasks (the
terms' hashes and weights) is bounded.

Terms are known by 64-bit hashes of their bytes. Scores are exact.

Defined results: null, empty and termless texts match nothing and don't count in N.
Rows of one doc_id are ranked each; a null id comes last among equal scores. Rows
of one item_id and text are one item; of one item_id and other texts, items of their own.
No documents, no items or no common term: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladewise.llm.arrow_text import hash_words, pieces, texts, tidy, words

TOP = 20
#: Documents of a block; a multiple of 64.
BLOCK = 2048
#: Items that are added up at once.
ITEMS = 64
LOT_BYTES = 4 << 20

#: [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]: digits, letters and all that isn't ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ONE = np.uint64(1)


def terms_of(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, first term of each row and one more) of pieces of the rows, in order."""
    data, bounds = texts(column)
    for lo, hi in pieces(bounds):
        part = data[bounds[lo] : bounds[hi]]
        starts, ends, rows = words(part, bounds[lo : hi + 1] - bounds[lo], TERM)
        yield hash_words(part, starts, ends), rows


def postings(hashes: np.ndarray, rows: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in ``sought``, occurrences) of the sought terms, by row and place. ``sought`` is sorted and not empty."""
    at = np.minimum(np.searchsorted(sought, hashes), len(sought) - 1)
    hit = sought[at] == hashes
    of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    cells, tf = np.unique(of[hit] * len(sought) + at[hit], return_counts=True)
    return cells // len(sought), cells % len(sought), tf.astype(np.int64)


@tidy
def _frequencies(batches: Iterator[pa.RecordBatch], sought: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents of each sought term, by its place; at -1 the documents with a term, at -2 all terms."""
    df, n_docs, n_terms = np.zeros(len(sought), np.int64), 0, 0
    for batch in batches:
        for hashes, rows in terms_of(batch.column(0)):
            df += np.bincount(postings(hashes, rows, sought)[1], minlength=len(sought))
            n_docs, n_terms = n_docs + int((np.diff(rows) > 0).sum()), n_terms + len(hashes)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1, -2], pa.int32()), pa.array([*df[some].tolist(), n_docs, n_terms], pa.int64())], names=["term", "n"])


class Slices:
    """The bit-sliced impacts of a block: ``planes[term, bit, word]`` of 64 documents each."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.terms, local = np.unique(term, return_inverse=True)
        bits, wide = int(impact.max(initial=0)).bit_length(), BLOCK // 64
        slot = local * wide + doc // 64
        order = np.argsort(slot, kind="stable")
        slot, impact, place = slot[order], impact[order].astype(np.uint64), (doc[order] % 64).astype(np.uint64)
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        self.planes = np.zeros((len(self.terms), bits, wide), np.uint64)
        for b in range(bits):
            if len(first):
                self.planes[slot[first] // wide, b, slot[first] % wide] = np.bitwise_or.reduceat(((impact >> np.uint64(b)) & _ONE) << place, first)

    def sums(self, items: list[np.ndarray]) -> np.ndarray:
        """``sums[bit, item, word]`` of the impacts of the items' terms, each item with at least as many of them as the next."""
        bits, wide = self.planes.shape[1:]
        most = max(map(len, items))
        out = np.zeros((bits + max(1, most).bit_length(), len(items), wide), np.uint64)
        for j in range(most):
            some = [x[j] for x in items if len(x) > j]
            added, carry = self.planes[some], np.zeros((len(some), wide), np.uint64)
            for b in range(bits):
                a, x = out[b, : len(some)], added[:, b]
                differ = a ^ x
                both = (a & x) | (differ & carry)
                np.bitwise_xor(differ, carry, out=a)
                carry = both
            b = bits
            while carry.any():
                a = out[b, : len(some)]
                both = a & carry
                a ^= carry
                carry, b = both, b + 1
        return out


def best(sums: np.ndarray, k: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of each item's ``k`` highest scores above 0; of equal ones the documents that come first."""
    left = np.bitwise_or.reduce(sums, axis=0)
    sure = np.zeros_like(left)
    for plane in sums[::-1]:
        hit = left & plane
        more = (np.bitwise_count(sure | hit).sum(axis=1) > k)[:, None]
        sure = np.where(more, sure, sure | hit)
        left = np.where(more, hit, left & ~hit)
    bits = lambda x: np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little").astype(bool)
    sure, left = bits(sure), bits(left)
    room = k - sure.sum(axis=1)
    item, doc = np.nonzero(sure | (left & (np.cumsum(left, axis=1) <= room[:, None])))
    score = np.zeros(len(item), np.int64)
    for b, plane in enumerate(sums):
        score |= (((plane[item, doc // 64] >> (doc % 64).astype(np.uint64)) & _ONE) << np.uint64(b)).astype(np.int64)
    return item, doc, score


def _leaders(found: list[pa.Table]) -> pa.Table:
    """Each item's best rows of several tables."""
    table = pa.concat_tables(found)
    item, score, ids = table.column("item").to_numpy(), table.column("score").to_numpy(), table.column("doc_id").combine_chunks()
    order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), -score, item))
    item = item[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    return table.take(pa.array(order[place < TOP]))


@tidy
def _rank(batches: Iterator[pa.RecordBatch], sought: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int, items: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each item's best documents of a partition."""
    kept, pending, count = [], [], 0

    def block() -> None:
        """Rank the documents that wait, in the order of their ids."""
        ids = pa.concat_arrays([x[0] for x in pending])
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.cumsum([0, *(len(x[0]) for x in pending)])
        doc, term, impact = (np.concatenate([x[i] + (before[k] if i == 1 else 0) for k, x in enumerate(pending)]) for i in (1, 2, 3))
        pending.clear()
        if not len(doc):
            return
        slices = Slices(place[doc], term, impact)
        local = np.full(len(sought), -1)
        local[slices.terms] = np.arange(len(slices.terms))
        present = [x[x >= 0] for x in (local[t] for t in items)]
        longest = sorted((i for i in range(len(items)) if len(present[i])), key=lambda i: -len(present[i]))
        for a in range(0, len(longest), ITEMS):
            some = longest[a : a + ITEMS]
            item, at, score = best(slices.sums([present[i] for i in some]))
            kept.append(pa.table({"item": pa.array(np.array(some)[item], pa.int32()), "doc_id": ids.take(pa.array(order[at])), "score": pa.array(score)}))
        kept[:] = [_leaders(kept)] if kept else []

    for batch in batches:
        lo = 0
        for hashes, rows in terms_of(batch.column(1)):
            n, size = np.diff(rows), len(rows) - 1
            doc, term, tf = postings(hashes, rows, sought)
            m = 75 + (25 * n * n_docs) // n_terms
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            doc, term, impact = (x[impact > 0] for x in (doc, term, impact))
            a = 0
            while a < size:
                b = min(size, a + BLOCK - count)
                p, q = np.searchsorted(doc, [a, b])
                pending.append((batch.column(0).slice(lo + a, b - a), doc[p:q] - a, term[p:q], impact[p:q]))
                count += b - a
                a = b
                if count == BLOCK:
                    block()
                    count = 0
            lo += size
    if pending:
        block()
    for table in kept:
        yield from table.combine_chunks().to_batches()


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``TOP`` highest-scoring documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots, kind = max(1, -(-size // LOT_BYTES)), dict(items.dtypes)[item_col]
    out = None
    for lot in range(lots):
        some = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == lot).toArrow()
        hashes = [x[a:b] for x, at in terms_of(some.column("text")) for a, b in zip(at[:-1], at[1:], strict=True)]
        found = _search_lot(rows, hashes)
        if found is None:
            continue
        known = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(hashes)), pa.int32()), "item_id": some.column("item_id")})).select("item", F.col("item_id").cast(kind).alias("item_id"))
        ranked = found.join(F.broadcast(known), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint") if out is None else out


def _search_lot(rows: DataFrame, hashes: list[np.ndarray]) -> DataFrame | None:
    """``item, rank, doc_id, score`` of the items of a lot, by their places; nothing where no item or no document has a term."""
    sought = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    if not len(sought):
        return None
    found = rows.select("text").mapInArrow(lambda x: _frequencies(x, sought), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in found.collect()}
    n_docs, n_terms = counts.get(-1, 0), counts.get(-2, 0)
    if not n_docs:
        return None
    df = np.array([counts.get(i, 0) for i in range(len(sought))], float)
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    items = [np.searchsorted(sought, x) for x in hashes]
    best_rows = rows.mapInArrow(lambda x: _rank(x, sought, weight, n_docs, n_terms, items), "item int, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best_rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, text, unnest({_WORDS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)), q AS (SELECT item_id, text, term, count(*) AS c FROM i GROUP BY 1, 2, 3),
t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
n AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
v AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, n GROUP BY term, n),
s AS (SELECT item_id, text, k, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n) // l)))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN v USING (term) JOIN d USING (k), n GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (k) WHERE score > 0) WHERE rank <= {TOP}"""
