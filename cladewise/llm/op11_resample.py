"""Importance resampling towards the benchmark by hashed n-grams, with CRC algebra.

Features are the runs of one to three words; a feature's bucket is its CRC-32
modulo ``BUCKETS``. Each word's CRC is taken once; those of its runs follow by
shifts over GF(2), and no run of words is ever written out. Both tables are
counted by bucket, the logarithm of the ratio of their smoothed shares is a bucket's
gain, a document's weight the sum of its gains, and the highest weights with
Gumbel noise are drawn.

The counts are ``BUCKETS`` numbers whatever the corpus, so they and the gains go
through the driver. Documents are read twice and never shuffled; only ids and
scores are sorted, by ranges.

Defined results: null, empty and wordless texts have no feature, weight 0 and no
rank. A null id draws as the empty text would. Rows of one id and score rank by
n_features, then as they come; repeated rows are rows of their own. No document
or no item: all shares are those of the smoothing. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.arrow_text import LOWER, pieces, texts, tidy, words
from cladewise.llm.crc_algebra import POLYNOMIAL, crc_words, shift
from cladewise.operators.numbering import numbered
from cladewise.plans.storage import written

BUCKETS = 10_000
#: Runs of up to so many words.
LONGEST = 3
#: A document is drawn only with so many words; so many hundredths of these are drawn.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Words that are worked on at once.
STRETCH = 1 << 16
_SPACE = np.uint32(0xE96CCF45)  # the CRC of one space

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text: digits, letters and all that isn't ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words in a run, rows, buckets) of all features of some texts, a stretch of words at a time."""
    data = LOWER[data]
    starts, ends, rows = words(data, bounds, TERM)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(rows))
    for a in range(0, len(starts), STRETCH):
        b = min(len(starts), a + STRETCH + LONGEST - 1)
        one, lens, row = crc_words(data, starts[a:b], ends[a:b]), ends[a:b] - starts[a:b], of[a:b]
        run, begins = one, min(STRETCH, b - a)
        yield 1, row[:begins], one[:begins] % np.uint32(BUCKETS)
        for n in range(2, LONGEST + 1):
            if len(run) < 2:
                break
            last = len(row) - n + 1
            spaced = shift(run[:last], np.ones(last, np.int64)) ^ _SPACE
            run = shift(spaced, lens[n - 1 :]) ^ one[n - 1 :]
            m = min(begins, last)
            whole = row[:m] == row[n - 1 : n - 1 + m]
            yield n, row[:m][whole], run[:m][whole] % np.uint32(BUCKETS)


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, bounds = texts(batch.column(0))
        for lo, hi in pieces(bounds):
            for _, _, buckets in features(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]):
                found += np.bincount(buckets, minlength=BUCKETS)
    some = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some])], names=["bucket", "n"])


def bucket_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    found = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain, in thousandths of a natural logarithm."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


@tidy
def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = texts(batch.column(1))
        n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for lo, hi in pieces(bounds):
            for n, rows, buckets in features(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]):
                found = np.bincount(rows, minlength=hi - lo)
                n_features[lo:hi] += found
                if n == 1:
                    n_words[lo:hi] += found
                weight[lo:hi] += np.bincount(rows, gain[buckets], minlength=hi - lo).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])


def weights(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda x: _weigh(x, gain), f"doc_id {dict(df.dtypes)[id_col]}, n_words bigint, n_features bigint, weight bigint")


def noisy(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighed`` with ``score``: the weight and Gumbel noise made of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; the rank is null where it isn't drawn."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    scored = written(noisy(weights(docs, gain, id_col, text_col)), "scored").df
    able = scored.filter(F.col("n_words") >= LEAST_WORDS)
    drawn = percent * able.count() // 100
    # The row's number keeps equal rows in different ranges of the sort.
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_row")]
    ranked = numbered(able.withColumn("_row", F.monotonically_increasing_id()), order, "rank").drop("_row")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long")))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against the benchmark, and the ranks of those drawn."""
    found = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")



def _nibble(x: int) -> int:
    """What a nibble leaves of a CRC's lowest four bits."""
    for _ in range(4):
        x = (x >> 1) ^ (POLYNOMIAL * (x & 1))
    return x


_TABLE = f"([{', '.join(str(_nibble(x)) for x in range(16))}]::BIGINT[])"
_HALF = f"xor(xor(c, b) >> 4, {_TABLE}[CAST(xor(c, b) & 15 AS INT) + 1])"
#: One byte ``b`` into a CRC ``c``: ``b`` first meets the lowest eight bits, then two nibbles go.
_BYTE = f"xor(({_HALF}) >> 4, {_TABLE}[CAST(({_HALF}) & 15 AS INT) + 1])"
OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
n AS (SELECT unnest([1, 2, 3]) AS n),
f AS (SELECT k, feature, count(*) AS c FROM (SELECT k, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS feature FROM d, n WHERE len(w) >= n) GROUP BY 1, 2),
g AS (SELECT feature, count(*) AS c FROM (SELECT unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS feature FROM q, n WHERE len(w) >= n) GROUP BY 1),
b AS (SELECT feature, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST(('0x' || substr(h, i, 2)) AS BIGINT)), lambda c, b: {_BYTE}, CAST(4294967295 AS BIGINT)), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT feature, hex(feature) AS h FROM (SELECT feature FROM f UNION SELECT feature FROM g))),
s AS (SELECT bucket, sum(c) AS s FROM f JOIN b USING (feature) GROUP BY 1), t AS (SELECT bucket, sum(c) AS t FROM g JOIN b USING (feature) GROUP BY 1),
x AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
y AS (SELECT k, sum(c) AS n_features, sum(c * gain) AS weight FROM f JOIN b USING (feature) JOIN x USING (bucket) GROUP BY 1),
z AS (SELECT d.k, doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM d LEFT JOIN y ON y.k = d.k),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM z LEFT JOIN r ON r.k = z.k"""
