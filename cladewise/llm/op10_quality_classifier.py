"""Quality: histogram gradient-boosted trees over document statistics.

``STATISTICS`` are computed from each whole text in numpy. Trees of fixed depth
grow on binned statistics by second-order gain of the log loss; they are stored
flat, level by level, in arrays of split columns, thresholds and leaf values,
and all trees are walked at once for a whole batch.

Fitting runs on the driver over the statistics of at most ``SAMPLE`` labelled
rows (a documented bound). Defined results: null and empty texts have statistics
of zero and are scored from these; without labels of both classes every score is
the smoothed share of label 1 (one half without labels). One output row for each
input row; a null id isn't held out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.arrow_text import hash_words, lists, pieces, texts, tidy, windows, words
from cladewise.llm.labelled import remainder, sample, texts_of
from cladewise.llm.op2_html_extract import STOP_WORDS

#: Labelled rows that the fit sees at most.
SAMPLE = 30_000
TREES, DEPTH, BINS, RATE, SHRINK, LEAST = 80, 4, 64, 0.15, 1.0, 20
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper_share", "digit_share", "other_share", "symbols_per_word", "bars_per_word", "bangs_per_word",
    "stops_per_word", "commas_per_word", "lines_per_word", "distinct_words", "distinct_windows", "repeated_lines", "stop_words", "short_words", "capital_words",
)


def _class(text: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(text)] = 1
    return out


_UPPER, _DIGIT, _WHITE = _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b" \t\n\x0b\x0c\r")
_LETTER = _UPPER + _class(bytes(range(97, 123))) + _class(bytes(range(128, 256)))
_OTHER = 1 - _LETTER - _DIGIT - _WHITE
_TABLES = np.stack([_UPPER, _DIGIT, _OTHER, _class(b"#*$%&<>"), _class(b"|"), _class(b"!"), _class(b"."), _class(b","), _class(b"\n"), _LETTER], axis=1)
_NEWLINE = np.ones(256, bool)
_NEWLINE[10] = False


def _stops() -> np.ndarray:
    data, bounds = texts(pa.array(sorted(STOP_WORDS)))
    starts, ends, _ = words(data, bounds)
    return np.sort(hash_words(data, starts, ends))


_STOPS = _stops()


def statistics(column) -> np.ndarray:
    """One row of STATISTICS for each text."""
    data, bounds = texts(column)
    out = np.zeros((len(bounds) - 1, len(STATISTICS)))
    for lo, hi in pieces(bounds):
        part, own = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        starts, ends, rows = words(part, own)
        hashes = hash_words(part, starts, ends)
        whole = windows(hashes, 3)
        stop = _STOPS[np.minimum(np.searchsorted(_STOPS, hashes), len(_STOPS) - 1)] == hashes
        lens = ends - starts
        capital = _UPPER[part[starts]] if len(starts) else np.zeros(0, np.int64)
        line_starts, line_ends, line_rows = words(part, own, _NEWLINE)
        lines = hash_words(part, line_starts, line_ends, False)
        for r in range(hi - lo):
            a, b, n = rows[r], rows[r + 1], int(rows[r + 1] - rows[r])
            if not n:
                continue
            upper, digit, other, symbols, bars, bangs, stops, commas, newlines, letters = (np.bincount(part[own[r] : own[r + 1]], minlength=256) @ _TABLES).tolist()
            size, each, near = int(own[r + 1] - own[r]), lens[a:b], whole[a : max(a, b - 2)]
            text_lines = lines[line_rows[r] : line_rows[r + 1]]
            out[lo + r] = (
                np.log1p(size), np.log1p(n), each.mean(), each.max(), upper / max(1, letters), digit / size, other / size, symbols / n, bars / n, bangs / n,
                stops / n, commas / n, newlines / n, len(np.unique(hashes[a:b])) / n, len(np.unique(near)) / max(1, len(near)), 1 - len(np.unique(text_lines)) / max(1, len(text_lines)), stop[a:b].mean(), (each <= 3).mean(), capital[a:b].mean(),
            )
    return out


class Forest:
    """Trees of one depth, flat: split columns and thresholds by node (level by level), values by leaf."""

    def __init__(self, column: np.ndarray, threshold: np.ndarray, value: np.ndarray, bias: float):
        self.column, self.threshold, self.value, self.bias = column, threshold, value, bias

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches, for all trees at once."""
        if not len(self.value):
            return np.full(len(x), self.bias)
        trees, rows = np.arange(len(self.value))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.value)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.column[trees, node]] > self.threshold[trees, node])
        return self.bias + self.value[trees, node - (2**DEPTH - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The odds of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(x: np.ndarray, label: np.ndarray) -> Forest:
    """Boost TREES trees on the log loss."""
    n1, n0 = int((label == 1).sum()), int((label == 0).sum())
    bias = float(np.log((n1 + 1) / (n0 + 1)))
    if not n0 or not n1:
        return Forest(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)), bias)
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(m)], axis=1)
    columns, thresholds, values = [], [], []
    margin = np.full(n, bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = p - label, p * (1 - p)
        node = np.zeros(n, np.int64)
        column, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for depth in range(DEPTH):
            first, wide = 2**depth - 1, 2**depth
            best = np.zeros(wide)
            for f in range(m):
                if not len(cuts[f]):
                    continue
                cell = (node - first) * BINS + binned[:, f]
                g, h, c = (np.bincount(cell, w, wide * BINS).reshape(wide, BINS).cumsum(axis=1) for w in (slope, curve, None))
                gl, hl, cl, gt, ht, ct = g[:, :-1], h[:, :-1], c[:, :-1], g[:, -1:], h[:, -1:], c[:, -1:]
                gain = gl**2 / (hl + SHRINK) + (gt - gl) ** 2 / (ht - hl + SHRINK) - gt**2 / (ht + SHRINK)
                gain = np.where((cl >= LEAST) & (ct - cl >= LEAST), gain, 0)[:, : len(cuts[f])]
                spot = gain.argmax(axis=1)
                top = gain[np.arange(wide), spot]
                better = top > best + 1e-9
                best[better] = top[better]
                column[first : first + wide][better] = f
                threshold[first : first + wide][better] = cuts[f][spot[better]]
            node = 2 * node + 1 + (x[np.arange(n), column[node]] > threshold[node])
        leaf = node - (2**DEPTH - 1)
        value = -RATE * np.bincount(leaf, slope, 2**DEPTH) / (np.bincount(leaf, curve, 2**DEPTH) + SHRINK)
        margin += value[leaf]
        columns.append(column)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.stack(columns), np.stack(thresholds), np.stack(values), bias)


@tidy
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(list(statistics(batch.column(2))), pa.float64())], names=["doc_id", "label", "x"])


@tidy
def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    forest = shared.value
    for batch in batches:
        x = statistics(batch.column(2))
        score = np.concatenate([forest.score(x[a : a + 1024]) for a in range(0, len(x), 1024)]) if len(x) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["doc_id", "held_out", "score"])


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> Forest:
    """Fit on labelled rows outside the held-out fold (crc32 of the id, modulo 4, is 2)."""
    chosen = sample(labels, "quality", remainder(F.col("doc_id"), 4) == 2, SAMPLE, False)
    table = texts_of(docs, chosen, text_col).mapInArrow(_measure, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, x array<double>").toArrow()
    if not table.num_rows:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    table = table.take(pa.array(np.argsort(table.column("doc_id").to_numpy(), kind="stable")))
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    return fit(x, table.column("label").to_numpy().astype(np.int64))


def scores(df: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    held = F.coalesce(remainder(F.col(id_col), 4) == 2, F.lit(False))
    rows = df.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(lambda x: _score(x, shared), f"doc_id {dict(df.dtypes)[id_col]}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
