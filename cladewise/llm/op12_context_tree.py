"""Language-model scores by context-tree weighting of byte contexts, and a unigram base.

A text is its words joined by one space and closed by an end byte (0xFF, which no
UTF-8 text holds); before it stand ``DEPTH`` end bytes. Each byte is eight binary
decisions, and each decision (a prefix of the byte's bits) has a tree of contexts:
the last 0, 1, ... ``DEPTH`` bytes. A node's Krichevsky-Trofimov estimate and the
product of its children's weighted probabilities are mixed half and half, from the
deepest contexts up; on the way down each depth gets its share of the prediction.
The logarithm of the chance of a byte after a context is then a constant, and a
text's score the sum over its bytes.

Nothing that is learned has a fixed size or goes through the driver or into a
broadcast:

* Documents are laid out in splits of at most ``SPLIT`` bytes and written once.
* Each split asks for its distinct keys (byte runs of DEPTH + 1, words), with what it
  counted of them among training rows; the keys are summed in one shuffle.
* Tree levels are tables by node; a level is one aggregation of the level below it.
* Every split gets back the values of its own keys and scores its texts.

So the shuffles carry distinct keys of splits and not occurrences. A word that only
one split holds is answered by the split's own count.

Words are known by 63-bit hashes. Defined results: null and empty texts are the end
token alone. A null id counts as the empty text in the fold. Rows of one doc_id are
rows of their own, repeated rows are learned from each time. Without training rows
every estimate is one half (a byte costs eight bits) and the base score of a token 0.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.arrow_text import LOWER, NOT_WHITE, give_back, hash_words, pieces, texts, tidy, words
from cladewise.plans.storage import written

DEPTH = 5
#: Bytes of text that are scored together at most, with the values of their keys beside them; one longer text is alone.
SPLIT = 32 << 20
#: Bytes of text in a row of a split.
PART = 1 << 20
#: Keys that wait before they are merged.
WAITING = 2_000_000
FOLDS, HELD_OUT = 7, 2

END = 0xFF
_WORD = NOT_WHITE.copy()
_WORD[END] = False
_END_KEY = -1


# ---- texts
def laid_out(data: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts as they are predicted, end to end, each after ``depth`` end bytes and closed by one; and where each begins (one more than texts)."""
    n = len(bounds) - 1
    begin = bounds + np.arange(n + 1) * (depth + 1)
    out = np.full(int(begin[-1]), END, np.uint8)
    for i in range(n):
        out[begin[i] + depth : begin[i + 1] - 1] = data[bounds[i] : bounds[i + 1]]
    out = LOWER[out]
    white = ~NOT_WHITE[out]
    keep = ~white
    edge = np.diff(white.view(np.int8), prepend=0, append=0)
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # White space between two words is one space; at either end of a text it goes.
    between = first[_WORD[out[first - 1]] & _WORD[out[np.minimum(after, len(out) - 1)]]] if len(first) else first
    keep[between], out[between] = True, 0x20
    sizes = np.add.reduceat(keep, begin[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)
    return out[keep], np.concatenate([[0], np.cumsum(sizes)])


@tidy
def _splits(batches: Iterator[pa.RecordBatch], depth: int, split: int) -> Iterator[pa.RecordBatch]:
    """Rows of parts: the split, ids, folds, bounds and the bytes (compressed)."""
    number, size = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        data, bounds = texts(batch.column(2))
        for lo, hi in pieces(bounds, PART):
            if size and size + bounds[hi] - bounds[lo] > split:
                number, size = number + 1, 0
            size += int(bounds[hi] - bounds[lo])
            out, begin = laid_out(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], depth)
            row = [number, len(out), pa.compress(out.tobytes(), codec="zstd", asbytes=True)]
            columns = [pa.array([x], kind) for x, kind in zip(row, (pa.int64(), pa.int64(), pa.binary()), strict=True)]
            held = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(begin[1:]))]
            yield pa.RecordBatch.from_arrays([*columns, *held], names=["split", "size", "bytes", "ids", "held_out", "ends"])


def _part(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and bounds of a row of a split."""
    data = np.frombuffer(pa.decompress(row["bytes"], decompressed_size=row["size"], codec="zstd", asbytes=True), np.uint8)
    return data, np.concatenate([[0], np.array(row["ends"], np.int64)])


def runs(data: np.ndarray, begin: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The run of depth + 1 bytes that ends at each predicted byte, as a number, and where each text's runs begin."""
    out = np.zeros(max(0, len(data) - depth), np.int64)
    for k in range(depth + 1):
        out = (out << 8) | data[k : len(data) - depth + k]
    # A run that ends among the end bytes before a text predicts nothing.
    real = np.ones(len(data), bool)
    for k in range(depth):
        real[begin[:-1] + k] = False
    sizes = np.diff(begin) - depth
    return out[real[depth:]], np.cumsum(sizes) - sizes


def word_keys(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A negative key for each word, and each text's first word (one more than texts)."""
    starts, ends, rows = words(data, begin, _WORD)
    return (hash_words(data, starts, ends, lower=False) | np.uint64(1 << 63)).view(np.int64), rows


# ---- keys
def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _counted(key: np.ndarray, trained: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys of training texts with their counts, and those of held-out ones with 0."""
    some, n = np.unique(key[trained], return_counts=True)
    rest = np.unique(key[~trained])
    return [some, rest], [n.astype(np.int64), np.zeros(len(rest), np.int64)]


@tidy
def _keys(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """``key, split, n`` of each distinct key of a split: n times among its training texts."""
    now, keys, counts = None, [], []

    def rows() -> Iterator[pa.RecordBatch]:
        key, n = _merged(keys, counts)
        for a in range(0, len(key), 1 << 17):
            part = slice(a, a + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(np.full(len(key[part]), now)), pa.array(n[part])], names=["key", "split", "n"])
        keys.clear()
        counts.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if keys and row["split"] != now:
                yield from rows()
            now = row["split"]
            (data, begin), trained = _part(row), ~np.array(row["held_out"], bool)
            run, at = runs(data, begin, depth)
            word, first = word_keys(data, begin)
            for key, sizes in ((run, np.diff(np.append(at, len(run)))), (word, np.diff(first))):
                some, n = _counted(key, np.repeat(trained, sizes))
                keys += some
                counts += n
            keys.append(np.array([_END_KEY]))
            counts.append(np.array([int(trained.sum())]))
            if sum(map(len, keys)) > WAITING:
                key, n = _merged(keys, counts)
                keys[:], counts[:] = [key], [n]
    if keys:
        yield from rows()


# ---- trees
def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of x >= 1/2, by Stirling's series at x + 8."""
    far, steps = x + 8, np.ones_like(x)
    for k in range(8):
        steps = steps * (x + k)
    inverse = 1 / far
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return (far - 0.5) * np.log(far) - far + 0.5 * np.log(2 * np.pi) + series - np.log(steps)


@tidy
def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, n0, n1, below`` → ``node, n0, n1, share, weighted``: the share of what reaches a node that stops there, and the logarithm of its weighted probability."""
    for batch in batches:
        n0, n1, below = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2, 3))
        own = log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1)
        deepest = np.isnan(below)
        below = np.where(deepest, own, below)
        weighted = np.where(deepest, own, np.logaddexp(own, below) - np.log(2))
        share = np.where(deepest, 1.0, np.exp(own - np.logaddexp(own, below)))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2)), pa.array(share), pa.array(weighted)], names=["node", "n0", "n1", "share", "weighted"])


_LEVEL = "node bigint, n0 bigint, n1 bigint, share double, weighted double"


def tree_levels(counts: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes of each depth from 0 on, from ``key, n`` of byte runs. A node is its context's bytes, then a prefix of the next byte's bits behind a leading one."""
    byte = F.col("key").bitwiseAND(F.lit(255))
    steps = []
    for j in range(8):
        bit = F.shiftright(byte, 7 - j).bitwiseAND(F.lit(1))
        prefix = F.lit(1 << j).bitwiseOR(F.shiftright(byte, 8 - j))
        steps.append(F.struct((F.col("key") - byte + prefix).alias("node"), (F.col("n") * (1 - bit)).alias("n0"), (F.col("n") * bit).alias("n1")))
    deepest = counts.select(F.explode(F.array(*steps)).alias("s")).select("s.*").groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.lit(None).cast("double").alias("below"))
    levels = [written(deepest.mapInArrow(_weigh, _LEVEL), "level").df]
    for d in range(depth, 0, -1):
        up = levels[0].groupBy(F.col("node").bitwiseAND(F.lit((1 << (8 * d)) - 1)).alias("node"))
        levels.insert(0, written(up.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below")).mapInArrow(_weigh, _LEVEL), "level").df)
    return levels


def predictions(levels: list[DataFrame]) -> DataFrame:
    """``node, p``: the chance of a 1 at each of the deepest nodes, mixed over all depths."""
    p = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    state = levels[0].select("node", (F.col("share") * p).alias("p"), (1 - F.col("share")).alias("rest"))
    for d, level in enumerate(levels[1:], 1):
        above = state.select(F.col("node").alias("_up"), F.col("p").alias("_p"), F.col("rest").alias("_rest"))
        both = level.withColumn("_up", F.col("node").bitwiseAND(F.lit((1 << (8 * d)) - 1))).join(above, "_up")
        state = both.select("node", (F.col("_p") + F.col("_rest") * F.col("share") * p).alias("p"), (F.col("_rest") * (1 - F.col("share"))).alias("rest"))
    return state.select("node", "p")


@tidy
def _byte_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``context, next (bytes), nodes (prefix, p)`` → ``key, value``: log10 of the chance of each byte after its context."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 4096):
            batch = whole.slice(lo, 4096)
            following, nodes = batch.column(1), batch.column(2)
            chance = np.full((batch.num_rows, 256), 0.5)
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(nodes).to_numpy())
            inner = nodes.flatten()
            chance[of, inner.field(0).to_numpy()] = inner.field(1).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(following).to_numpy())
            byte = following.flatten().to_numpy().astype(np.int64)
            value = np.zeros(len(byte))
            for j in range(8):
                p = chance[row, (1 << j) | (byte >> (8 - j))]
                value += np.log10(np.where((byte >> (7 - j)) & 1, p, 1 - p))
            key = (batch.column(0).to_numpy()[row] << 8) | byte
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value)], names=["key", "value"])


def byte_values(counts: DataFrame, depth: int) -> DataFrame:
    """``key, value``: log10 of the chance of the last byte of each run after the bytes before it, learned from ``key, n``. Runs with n = 0 have a value too."""
    nodes = predictions(tree_levels(counts, depth))
    by = lambda c: F.shiftright(c, 8).alias("context")
    low = lambda c: F.col(c).bitwiseAND(F.lit(255)).cast("int")
    chances = nodes.groupBy(by("node")).agg(F.collect_list(F.struct(low("node").alias("prefix"), F.col("p"))).alias("nodes"))
    following = counts.groupBy(by("key")).agg(F.collect_list(low("key")).alias("next"))
    return following.join(chances, "context").select("context", "next", "nodes").mapInArrow(_byte_values, "key bigint, value double")


# ---- scores
def _scorer(depth: int, train_tokens: int, types: int):
    """The kernel of a split: its parts and the values of its keys → rows of scores."""
    least = -np.log10(train_tokens + types + 1)

    def score(parts: pa.Table, found: pa.Table) -> pa.Table:
        rows = parts.to_pylist()
        key, value = (found.column(c).to_numpy() for c in ("key", "value"))
        held, got = [], []
        # Words that no other split holds have no value; what this split counted is all there is.
        for row in rows:
            data, begin = _part(row)
            word, first = word_keys(data, begin)
            some, n = np.unique(word[np.repeat(~np.array(row["held_out"], bool), np.diff(first))], return_counts=True)
            held.append(some)
            got.append(n.astype(np.int64))
        held.append(np.array([_END_KEY]))
        got.append(np.array([sum(row["held_out"].count(False) for row in rows)]))
        own, count = _merged(held, got)
        alone = ~np.isin(own, key)
        run = key >= 0
        of_run, of_word = pd.Index(key[run]), pd.Index(np.concatenate([key[~run], own[alone]]))
        chance = value[run]
        seen = np.concatenate([value[~run], count[alone].astype(float), [0.0]])
        token = np.log10(seen + 1) + least
        out = []
        for row in rows:
            data, begin = _part(row)
            keys, at = runs(data, begin, depth)
            logs = np.add.reduceat(chance[of_run.get_indexer(keys)], at)
            word, first = word_keys(data, begin)
            # A word that is found nowhere is at -1: the last place, which counts 0.
            place, end = of_word.get_indexer(word), int(of_word.get_indexer([_END_KEY])[0])
            sums = [np.concatenate([[0], np.cumsum(x[place])]) for x in (token, (seen > 0).astype(np.int64))]
            base, known = (s[first[1:]] - s[first[:-1]] + x[end] for s, x in zip(sums, (token, (seen > 0).astype(np.int64)), strict=True))
            size = np.diff(begin) - depth
            out.append(pa.table({
                "doc_id": pa.array(row["ids"], parts.schema.field("ids").type.value_type), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": pa.array(np.diff(first) + 1, pa.int64()), "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array(np.full(len(size), train_tokens)), "base_score": pa.array(base), "score": pa.array(logs), "bits_per_byte": pa.array(-logs * np.log2(10) / size),
            }))
        return pa.concat_tables(out)

    def tidied(parts: pa.Table, found: pa.Table) -> pa.Table:
        try:
            return score(parts, found)
        finally:
            give_back()

    return tidied


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row, learned from those that aren't held out. ``depth`` is 6 at most."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    parts = written(rows.mapInArrow(lambda x: _splits(x, depth, SPLIT), f"split bigint, size bigint, bytes binary, ids array<{kind}>, held_out array<boolean>, ends array<bigint>"), "splits").df
    asked = parts.select("split", "size", "bytes", "held_out", "ends").mapInArrow(lambda x: _keys(x, depth), "key bigint, split bigint, n bigint")
    totals = asked.groupBy("key").agg(F.sum("n").alias("n"), F.collect_set("split").alias("splits"))
    seen, word = Observation(), F.col("key") < 0
    totals = totals.observe(seen, F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0)).alias("tokens"), F.count_if(word & (F.col("n") > 0)).alias("types"))
    keys = written(totals.filter(~word | (F.size("splits") > 1)), "keys").df
    train_tokens, types = seen.get["tokens"], seen.get["types"]
    of_runs = keys.filter("key >= 0")
    valued = of_runs.select("key", "splits").join(byte_values(of_runs.select("key", "n"), depth), "key").select("key", "value", "splits")
    answers = valued.union(keys.filter(word).select("key", F.col("n").cast("double"), "splits")).select(F.explode("splits").alias("split"), "key", "value")
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return parts.groupBy("split").cogroup(answers.groupBy("split")).applyInArrow(_scorer(depth, train_tokens, types), schema)


def held_out_fold(doc_id: Column) -> Column:
    """Whether an id's CRC-32 falls into the held-out fold."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def op12_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out_fold(F.col("doc_id")))
