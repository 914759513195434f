"""Toxicity: a character n-gram linear classifier with naive Bayes log-count ratios.

Features are the hashed character 3-, 4- and 5-grams of the lower-cased text,
spaces included. A feature's value in a text lies between 0 and 1: ``PRESENT`` for
being there, the rest for how often, up to once in ``LETTERS`` letters; so one word
counts in a text of any length, and a manner of writing by its share. From a
bounded sample of labelled rows come the log-count ratio r of each feature,
log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2)) over the sums of its values in the
documents of either class, and the ``FEATURES`` features that tell the classes
apart best. A logistic regression on r times value, with classes weighted by the
roots of their shares, gives the weights. Each text is scored whole.

Fitting runs on the driver over at most ``SAMPLE`` rows of each class (a
documented bound); scoring is one pass over all rows with a broadcast model of
fixed size. Defined results: null and empty texts get the score of no feature at
all; without labels of both classes every score is the share of label 1 with one
row of label 1 and two of label 0 added (so nothing is toxic without labels). One output row for each input row; a null id isn't
held out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.arrow_text import pieces, texts, tidy
from cladewise.llm.labelled import remainder, sample, shares, texts_of
from cladewise.plans.storage import written

SIZES = (3, 4, 5)
BITS = 20
PRESENT, LETTERS = 0.25, 300
FEATURES = 1 << 12
#: Labelled rows of each class that the fit sees at most.
SAMPLE = 4000
#: Bytes of their texts at most; where they have more, the first ones in the order of the sample's hash are taken.
SAMPLE_BYTES = 96 << 20
PENALTY = 1.0
#: Added to a feature's spread, which a few rows would put at nothing.
LEAST_SPREAD = 0.02
ROUNDS = 150
PIECE = 1 << 19
_STEP, _SPREAD = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def grams(found: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the text that each n-gram is of, as the first letter's place, and its bucket."""
    lower = [x.lower() for x in found]
    lens = np.array([len(x) for x in lower], np.int64)
    letters = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(letters))
    rolling = letters.copy()
    for n in range(2, max(SIZES) + 1):
        if len(letters) < n:
            return
        rolling = rolling[: len(letters) - n + 1] * _STEP + letters[n - 1 :]
        if n in SIZES:
            bucket = ((rolling ^ (rolling >> np.uint64(29))) * _SPREAD) >> np.uint64(64 - BITS)
            yield left[: len(bucket)] >= n, bucket.astype(np.int64)


def features(found: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, in order, with their values; ``table`` gives a bucket's feature, or -1."""
    lens = np.array([len(x.lower()) for x in found], np.int64)
    row = np.repeat(np.arange(len(found)), lens)
    keys = []
    for inside, bucket in grams(found):
        feature = table[bucket]
        hit = np.flatnonzero(inside & (feature >= 0))
        keys.append((row[hit] << BITS) | feature[hit])
    both, counts = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
    at = both >> BITS
    return at, both & ((1 << BITS) - 1), PRESENT + (1 - PRESENT) * np.minimum(1, counts * LETTERS / np.maximum(lens[at], LETTERS))


def _split(column) -> Iterator[list[str]]:
    _, bounds = texts(column)
    for lo, hi in pieces(bounds, PIECE):
        yield [x or "" for x in column.slice(lo, hi - lo).to_pylist()]


class Model:
    """Weights by feature, the feature of each bucket, and the intercept."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: float):
        self.table, self.weights, self.bias = table, weights, bias

    def score(self, found: list[str]) -> np.ndarray:
        """Scores of the texts."""
        row, feature, value = features(found, self.table) if len(self.weights) else (np.zeros(0, np.int64),) * 3
        z = self.bias + np.bincount(row, self.weights[feature] * value, len(found)) if len(row) else np.full(len(found), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def log_counts(column: pa.Array, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values of each feature, and of their squares, over the texts of either class."""
    whole = np.arange(1 << BITS, dtype=np.int32)
    sums, squares = np.zeros((2, 1 << BITS)), np.zeros((2, 1 << BITS))
    at = 0
    for found in _split(column):
        row, feature, value = features(found, whole)
        of = label[at : at + len(found)][row]
        for c in (0, 1):
            sums[c] += np.bincount(feature[of == c], value[of == c], 1 << BITS)
            squares[c] += np.bincount(feature[of == c], value[of == c] ** 2, 1 << BITS)
        at += len(found)
    return sums, squares


def fit(column: pa.Array, label: np.ndarray, shares_: tuple[int, int]) -> Model:
    """The model of labelled texts; ``shares_``: how many rows of each class there are in all."""
    n0, n1 = int((label == 0).sum()), int((label == 1).sum())
    if not n0 or not n1:
        return Model(np.full(1 << BITS, -1, np.int32), np.zeros(0), float(np.log((n1 + 1) / (n0 + 2))))
    sums, squares = log_counts(column, label)
    q, p = (sums[0] + 1) / (n0 + 2), (sums[1] + 1) / (n1 + 2)
    ratio = np.log(p / q)
    spread = np.maximum(0, squares[0] / n0 - q**2) + np.maximum(0, squares[1] / n1 - p**2) + LEAST_SPREAD
    apart = np.abs(p - q) / np.sqrt(spread / 2)
    chosen = np.sort(np.argsort(-apart, kind="stable")[:FEATURES])
    table = np.full(1 << BITS, -1, np.int32)
    table[chosen] = np.arange(len(chosen))
    ratio = ratio[chosen]
    rows, columns, values, at = [], [], [], 0
    for found in _split(column):
        row, feature, value = features(found, table)
        rows.append(row + at)
        columns.append(feature)
        values.append(value)
        at += len(found)
    row, feature = np.concatenate(rows), np.concatenate(columns)
    value = ratio[feature] * np.concatenate(values)
    # Half way, in logarithms, between the classes' shares and balance.
    weight = np.where(label == 1, shares_[1] ** 0.5 / n1, shares_[0] ** 0.5 / n0)
    weight = weight / weight.mean()
    n, m = len(label), len(chosen)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = x[m] + np.bincount(row, value * x[feature], n)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label)
        slope = np.append(np.bincount(feature, value * error[row], m) + PENALTY * x[:m], error.sum())
        return float((weight * (np.logaddexp(0, z) - label * z)).sum() + PENALTY / 2 * (x[:m] ** 2).sum()), slope

    x = minimise(loss, np.zeros(m + 1))
    return Model(table, x[:m] * ratio, float(x[m]))


def minimise(loss, x: np.ndarray, kept: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps, at most ROUNDS of them."""
    value, slope = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(ROUNDS):
        way, used = -slope, []
        for step, change, scale in reversed(moves):
            used.append(scale * (step @ way))
            way = way - used[-1] * change
        way = way * (1 / (moves[-1][2] * (moves[-1][1] @ moves[-1][1])) if moves else 1 / max(1.0, np.abs(slope).sum()))
        for (step, change, scale), a in zip(moves, reversed(used), strict=True):
            way = way + (a - scale * (change @ way)) * step
        down, far = slope @ way, 1.0
        while far > 1e-10:
            new_value, new_slope = loss(x + far * way)
            if new_value <= value + 1e-4 * far * down:
                break
            far /= 2
        else:
            break
        step, change = far * way, new_slope - slope
        if (product := step @ change) > 1e-12:
            moves = [*moves[1 - kept :], (step, change, 1 / product)]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, slope = x + step, new_value, new_slope
        if done:
            break
    return x


@tidy
def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        scores = [model.score(found) for found in _split(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "held_out", "score"])


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> Model:
    """Fit on labelled rows outside the held-out fold (crc32 of the id, modulo 5, is 0)."""
    fold = remainder(F.col("doc_id"), 5) == 0
    chosen = sample(labels, "toxic", fold, SAMPLE, True)
    table = written(texts_of(docs, chosen, text_col).withColumn("h", F.xxhash64("doc_id")), "labelled")
    sizes = table.df.select("h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy("h").toArrow()
    fits = int(np.searchsorted(np.cumsum(sizes.column("size").to_numpy().astype(np.int64)), SAMPLE_BYTES, "right"))
    last = sizes.column("h")[min(fits, sizes.num_rows - 1)].as_py() if sizes.num_rows else 0
    rows = table.df.filter(F.col("h") <= last).toArrow().combine_chunks()
    table.drop()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    column = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    return fit(column, rows.column("label").to_numpy().astype(np.int64), shares(labels, "toxic", fold))


def scores(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(remainder(F.col(id_col), 5) == 0, F.lit(False))
    rows = df.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(lambda x: _score(x, shared), f"doc_id {dict(df.dtypes)[id_col]}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@tidy
def _keep(batches: Iterator[pa.RecordBatch], shared, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for found in _split(batch.column(at)):
            yield batch.slice(done, len(found)).filter(pa.array(shared.value.score(found) < 0.5))
            done += len(found)


def keep_rows(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that aren't predicted toxic, with their own columns."""
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # any names may come
    return plain.mapInArrow(lambda x: _keep(x, shared, at), plain.schema).toDF(*df.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
