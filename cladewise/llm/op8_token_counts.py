"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word are linked; a heap gives the lowest-rank adjacent pair
(the leftmost of equals), which merges and offers its new neighbours. A word
counts its first symbols less its merges; no identifier is put out. A worker
keeps the counts of the words of up to ``KEPT_LETTERS`` letters that it has met, up
to ``KEPT_WORDS``.

Texts are normalised as the vocabulary's file says: NFC, then lower case letter
by letter; white space is dropped. Special tokens standing in a text count one
each, as the library does by default.

Defined results: null and empty texts have 0 bytes and 0 tokens. One output row
for each input row; extra columns are ignored. Whole texts, no truncation.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.arrow_text import texts, tidy
from cladewise.llm.vocabulary import WORD_BPE, Vocabulary, default_path, load

# Fixed value: the pattern of words.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Capitals that Python's Unicode tables don't know yet, and their lower case.
NEW_CAPITALS = (("\ua7cb", "\u0264"), ("\ua7dc", "\u019b"))
KEPT_WORDS, KEPT_LETTERS = 400_000, 48
LIMIT = 2048


class Counts(dict):
    """Word → tokens, counted when first asked for."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.ranks, self.made = v.ranks, v.made.tolist()
        self.first, self.last = v.byte_ids.tolist(), v.last_byte_ids.tolist()

    def __missing__(self, word: str) -> int:
        data = word.encode()
        first = self.first
        sym = [first[b] for b in data]
        sym[-1] = self.last[data[-1]]
        found = self.count(sym)
        if len(word) <= KEPT_LETTERS:
            self[word] = found
        return found

    def count(self, sym: list[int]) -> int:
        """Symbols that remain of ``sym`` (which is used up)."""
        n = count = len(sym)
        if n == 1:
            return 1
        ranks, made = self.ranks, self.made
        # An entry is (rank << 32 | position): the lowest rank, then the leftmost.
        heap = [r << 32 | i for i in range(n - 1) if (r := ranks.get(sym[i] << 20 | sym[i + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            # Stale where the pair at i is no longer that of the rank.
            if sym[i] < 0 or j >= n or ranks.get(sym[i] << 20 | sym[j]) != rank:
                continue
            count -= 1
            sym[i], sym[j] = made[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(sym[i] << 20 | sym[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (p := before[i]) >= 0 and (r := ranks.get(sym[p] << 20 | sym[i])) is not None:
                heappush(heap, r << 32 | p)
        return count


def normal(text: str) -> str:
    """NFC and lower case, letter by letter: a capital sigma has one lower case wherever it stands."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        for capital, small in NEW_CAPITALS:
            text = text.replace(capital, small)
    return text.lower()


@tidy
def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = load(path)
    counts = Counts(v)
    special = regex.compile("|".join(map(regex.escape, v.special)))
    for batch in batches:
        _, bounds = texts(batch.column(1))
        tokens = np.zeros(batch.num_rows, np.int64)
        for k, text in enumerate(batch.column(1)):
            text = text.as_py() or ""
            if "<|" in text and (parts := special.split(text))[1:]:
                tokens[k] = len(parts) - 1 + sum(sum(map(counts.__getitem__, PATTERN.findall(normal(x)))) for x in parts)
            else:
                tokens[k] = sum(map(counts.__getitem__, PATTERN.findall(normal(text))))
            if len(counts) > KEPT_WORDS:
                counts.clear()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row. ``path`` must be readable on the executors."""
    path = path or default_path(WORD_BPE)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda x: _count(x, path), f"doc_id {dict(df.dtypes)[id_col]}, n_bytes bigint, n_tokens bigint")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and whether they pass the limit."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
