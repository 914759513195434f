"""BPE encoding and decoding with a pair occurrence index.

The distinct pieces (pre-tokens) of a stretch of a partition are laid end to end
as one array of symbols with links between neighbours. An index maps each pair
that has a merge to all its positions. Active ranks are taken in ascending
order; all positions of a rank merge at once, from left to right where they
overlap, and the pairs they create join the lists of their own, higher ranks.
Texts are then put together from the ids of their pieces, and decoded from the
ids alone.

Special tokens in a text become their ids, as the library does by default.
Defined results: null and empty texts have no ids and decode to the empty text.
One output row for each input row, in any order; nulls in other columns, repeated
rows and extra columns have no effect. Whole texts, no truncation.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.arrow_text import pieces, texts, tidy
from cladewise.llm.vocabulary import BYTE_BPE, Vocabulary, default_path, load

# Fixed value: the pattern of byte-level pre-tokens.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Bytes of text whose pieces are indexed together; pieces kept between stretches.
STRETCH = 4 << 20
KEPT_PIECES = 150_000
FEW = 24
#: Texts of one outgoing batch.
SLICE = 256


class PairIndex:
    """Symbols of many pieces, and the positions of each pair that can merge."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]):
        self.v = vocabulary
        lens = np.array([len(w) for w in words], np.int64)
        n = int(lens.sum())
        self.bounds = np.concatenate([[0], np.cumsum(lens)])
        data = np.frombuffer(b"".join(words), np.uint8)
        self._sym, self._next, self._prev = (array("i", bytes(4 * n)) for _ in range(3))
        self.sym, self.next, self.prev = (np.frombuffer(x, np.int32) if n else np.zeros(0, np.int32) for x in (self._sym, self._next, self._prev))
        self.sym[:] = vocabulary.byte_ids[data]
        self.next[:] = np.arange(1, n + 1)
        self.prev[:] = np.arange(-1, n - 1)
        some = lens > 0
        self.next[self.bounds[1:][some] - 1] = -1
        self.prev[self.bounds[:-1][some]] = -1
        self.index: dict[int, list] = {}
        self.active: list[int] = []
        self._add(np.flatnonzero(self.next >= 0))

    def _add(self, at: np.ndarray) -> None:
        """Put the pairs that begin at these positions into the index."""
        keys, ranks = self.v.sorted_pairs
        pair = (self.sym[at].astype(np.int64) << 20) | self.sym[self.next[at]]
        spot = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = keys[spot] == pair
        at, rank = at[hit], ranks[spot[hit]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.concatenate([[0], cuts])].tolist() if len(rank) else [], np.split(at, cuts), strict=False):
            self._entry(r).append(part)

    def _entry(self, rank: int) -> list:
        found = self.index.get(rank)
        if found is None:
            found = self.index[rank] = []
            heapq.heappush(self.active, rank)
        return found

    def run(self) -> "PairIndex":
        """Apply the active ranks in ascending order."""
        while self.active:
            rank = heapq.heappop(self.active)
            found = self.index.pop(rank)
            total = sum(1 if type(x) is int else len(x) for x in found)
            if total <= FEW:
                self._few(rank, sorted({y for x in found for y in ((x,) if type(x) is int else x.tolist())}))
            else:
                loose = [x for x in found if type(x) is int]
                self._many(rank, np.unique(np.concatenate([x for x in found if type(x) is not int] + ([np.array(loose)] if loose else []))))
        return self

    def _few(self, rank: int, at: list[int]) -> None:
        left, right, made = int(self.v.left[rank]), int(self.v.right[rank]), int(self.v.made[rank])
        sym, nxt, prv, ranks = self._sym, self._next, self._prev, self.v.ranks
        for i in at:
            j = nxt[i]
            if sym[i] != left or j < 0 or sym[j] != right:
                continue
            k = nxt[j]
            sym[i], sym[j], nxt[i] = made, -1, k
            if k >= 0:
                prv[k] = i
                if (r := ranks.get(made << 20 | sym[k])) is not None:
                    self._entry(r).append(i)
            if (p := prv[i]) >= 0 and (r := ranks.get(sym[p] << 20 | made)) is not None:
                self._entry(r).append(p)

    def _many(self, rank: int, at: np.ndarray) -> None:
        left, right, made = int(self.v.left[rank]), int(self.v.right[rank]), int(self.v.made[rank])
        at = at[(self.sym[at] == left) & (self.next[at] >= 0)]
        at = at[self.sym[self.next[at]] == right]
        if left == right and len(at) > 1:
            # In a run of overlapping pairs every second one merges.
            n = np.arange(len(at))
            fresh = np.concatenate([[True], self.prev[at[1:]] != at[:-1]])
            at = at[(n - np.maximum.accumulate(np.where(fresh, n, 0))) % 2 == 0]
        gone = self.next[at]
        after = self.next[gone]
        self.sym[at], self.sym[gone], self.next[at] = made, -1, after
        there = after >= 0
        self.prev[after[there]] = at[there]
        before = self.prev[at]
        self._add(np.unique(np.concatenate([before[before >= 0], at[there]])))

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each piece has."""
        alive = self.sym >= 0
        upto = np.concatenate([[0], np.cumsum(alive)])
        return self.sym[alive], np.diff(upto[self.bounds])


def gather(flat: np.ndarray, begins: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The stretches of ``flat``, end to end."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(begins - (ends - lens), lens)]


class Encoder:
    """Encodes texts; keeps the ids of pieces it has met, up to KEPT_PIECES between stretches."""

    def __init__(self, path: str):
        self.v = load(path)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.v.special)) + ")") if self.v.special else None
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begins, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pieces(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.v.special):
            return PATTERN.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += ["\0" + part] if k % 2 else PATTERN.findall(part)
        return out

    def pieces(self, found: list[str]) -> list[np.ndarray]:
        """For each text, the numbers of its pieces; the ids of all these pieces are known afterwards."""
        if len(self.known) > KEPT_PIECES:
            self._clear()
        known, old = self.known, len(self.known)
        numbers = [np.array([known.setdefault(w, len(known)) for w in self._pieces(text)], np.int32) for text in found]
        if len(known) > old:
            fresh = list(islice(known, old, None))
            # A special token's name follows a null byte, which no other piece holds before a letter.
            marked = {k: self.v.special[w[1:]] for k, w in enumerate(fresh) if w[0] == "\0" and w[1:] in self.v.special}
            ids, lens = PairIndex(self.v, [b"" if k in marked else w.encode() for k, w in enumerate(fresh)]).run().ids()
            if marked:
                spots = np.cumsum(lens) - lens
                ids = np.insert(ids, [spots[k] for k in marked], list(marked.values()))
                lens[list(marked)] = 1
            self.begins = np.concatenate([self.begins, np.cumsum(lens) - lens + len(self.flat)])
            self.lens, self.flat = np.concatenate([self.lens, lens]), np.concatenate([self.flat, ids])
        return numbers

    def ids(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of these pieces end to end, and how many each text has."""
        which = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        each = self.lens[which]
        upto = np.concatenate([[0], np.cumsum(each)])
        sizes = np.array([len(x) for x in numbers], np.int64)
        return gather(self.flat, self.begins[which], each), np.diff(upto[np.concatenate([[0], np.cumsum(sizes)])])

    def encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and how many each text has."""
        return self.ids(self.pieces(found))


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
    flat, begins, lens = v.flat_bytes
    return gather(flat, begins[ids], lens[ids]).tobytes().decode("utf-8", "replace")


@tidy
def _round_trip(batches: Iterator[pa.RecordBatch], path: str, decode: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for batch in batches:
        _, bounds = texts(batch.column(1))
        for lo, hi in pieces(bounds, STRETCH):
            numbers = encoder.pieces([x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()])
            for a in range(0, len(numbers), SLICE):
                ids, sizes = encoder.ids(numbers[a : a + SLICE])
                upto = np.concatenate([[0], np.cumsum(sizes)])
                columns = [batch.column(0).slice(lo + a, len(sizes)), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))]
                if decode:
                    columns.append(pa.array([decode_ids(encoder.v, ids[x:y]) for x, y in zip(upto[:-1], upto[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])


@tidy
def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = load(path)
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            out = [decode_ids(v, x.values.to_numpy()) if x.is_valid else "" for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["doc_id", "decoded"])


def _rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), dict(df.dtypes)[id_col]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row. ``path`` must be readable on the executors."""
    path = path or default_path(BYTE_BPE)
    rows, kind = _rows(df, id_col, text_col)
    return rows.mapInArrow(lambda x: _round_trip(x, path, False), f"doc_id {kind}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``doc_id, decoded`` of every row; null ids decode to the empty text."""
    path = path or default_path(BYTE_BPE)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda x: _decode(x, path), f"doc_id {dict(df.dtypes)[id_col]}, decoded string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` of every row, in one pass: ``decoded`` is made from ``ids``."""
    path = path or default_path(BYTE_BPE)
    rows, kind = _rows(df, id_col, text_col)
    return rows.mapInArrow(lambda x: _round_trip(x, path, True), f"doc_id {kind}, ids array<int>, decoded string")


def digests(df: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of a round trip."""
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the encoded and decoded documents."""
    return digests(round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet")))
