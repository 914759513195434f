"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Every word n-gram of every item is a seed. The items go to all tasks, in parts
   of about ``MAX_SEEDS`` seeds with a pass over the texts each. Rare seeds, of at
   most ``RARE`` items, name their items at once. The place of a common one (the
   wording that many items begin with) names those of its items of which the
   words around it hold so many, the most common quarter aside, as an alignment
   of ``THRESHOLD`` needs; an index of each item's rarest words finds them.
2. A document's places of an item's own seeds, with a margin of twice the item's
   words, make passages: an alignment of ``THRESHOLD`` spans no more words. Long
   passages are cut into overlapping windows of four times the item's words, so
   the work grows with the places, however many items a document holds. A window
   is left out only if no alignment with it can reach ``THRESHOLD``.
3. Smith-Waterman alignment of words (match 2, mismatch -1, gap -1) scores each
   pair of passage and item; the score is divided by that of the item against
   itself. Pairs of ``THRESHOLD`` or more are leaks: copies of which words were
   replaced, dropped or added, and copies of the larger part of an item, where
   one n-gram is whole.

Words are runs of ASCII letters and digits and of all characters beyond ASCII.
Items with equal words are one item, named by its smallest id and counted in
``n_items``. Items with fewer words than a seed are seeds whole.

Defined results: items without words match nothing; null or empty texts leak
nothing; each row of the documents is judged by itself, and equal result rows of
repeated rows are one. Null ids are kept as they are. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.arrow_text import hash_words, lists, pieces, texts, tidy, windows, words
from cladewise.plans.storage import written

SEED = 3
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Seeds (some 30 bytes each, with the words of their items) of one broadcast; items with more go out in parts.
MAX_SEEDS = 2_000_000
#: Items that hold a rare seed, at most.
RARE = 16
#: Pairs of a place and an item taken at a time, about.
PLACES = 1 << 18
#: Cells of one batch of alignments.
CELLS = 1 << 21
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True


def _hashed(column) -> Iterator[tuple]:
    """For each text: its word hashes, and what is needed to cut its words out."""
    data, bounds = texts(column)
    for lo, hi in pieces(bounds):
        part, own = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        starts, ends, rows = words(part, own, WORD)
        hashes = hash_words(part, starts, ends)
        whole = windows(hashes, SEED)
        yield lo, part, starts, ends, rows, hashes, whole


def _seeds_of(hashes: np.ndarray) -> np.ndarray:
    """An item's seeds as signed values: its n-grams, or all of it where it is shorter."""
    return windows(hashes, min(SEED, len(hashes))).view(np.int64)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, sizes, digests = [], [], []
        for _, _, _, _, rows, hashes, _ in _hashed(batch.column(1)):
            for a, b in zip(rows[:-1], rows[1:], strict=True):
                found.append(np.unique(_seeds_of(hashes[a:b])) if b > a else np.zeros(0, np.int64))
                digests.append(hashes[a:b].view(np.int64))
                sizes.append(b - a)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(sizes, np.int64)), lists(digests, pa.int64()), lists(found, pa.int64())], names=["item_id", "n_words", "words", "seeds"])


def items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct items: ``item_id`` (smallest), ``n_items, n_words, words`` (hashes), ``seeds``."""
    kind = dict(benchmark.dtypes)[id_col]
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    rows = rows.mapInArrow(_item_seeds, f"item_id {kind}, n_words bigint, words array<bigint>, seeds array<bigint>").filter("n_words > 0")
    return rows.groupBy("words").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"), F.first("n_words").alias("n_words"), F.first("seeds").alias("seeds"))


class Items(NamedTuple):
    """Items as the tasks get them: sorted seeds, of each the items that hold it (``owners`` from ``first``), and each item's id, count and words (from ``begins``).

    ``keys``: sorted words. Of an item the most common quarter aside, its words (``mine`` from ``own``, as places in ``keys``) and how often it holds each (``times``), rarest first; ``least``: so many of these an alignment holds.
    A window with so many holds one of the item's rarest, all but ``least`` - 1 of them; of each word the items that have it among these are ``holders`` from ``spread``.
    ``lengths``: of each seed the orders of length of its items, as bits.
    """

    seeds: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    ids: pa.Array
    counts: pa.Array
    words: np.ndarray
    begins: np.ndarray
    keys: np.ndarray
    own: np.ndarray
    mine: np.ndarray
    times: np.ndarray
    least: np.ndarray
    spread: np.ndarray
    holders: np.ndarray
    lengths: np.ndarray


def _packed(table: pa.Table) -> Items:
    seeds, words_ = (table.column(name).combine_chunks() for name in ("seeds", "words"))
    each, sizes = (pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (seeds, words_))
    n = len(each)
    values, owners = seeds.flatten().to_numpy(), np.repeat(np.arange(n), each)
    order = np.argsort(values, kind="stable")
    distinct, first = np.unique(values[order], return_index=True)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    hashes, item = words_.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(n), sizes)
    keys, at = np.unique(hashes, return_inverse=True)
    held = np.bincount(np.unique(at * n + item) // max(1, n), minlength=len(keys))
    common_first = np.lexsort((-held[at], item))
    rarer = common_first[np.arange(len(at)) - begins[item[common_first]] >= sizes[item[common_first]] // 4]
    pairs, times = np.unique(item[rarer] * len(keys) + at[rarer], return_counts=True)
    whose, word = pairs // max(1, len(keys)), pairs % max(1, len(keys))
    by_rarity = np.lexsort((word, held[word], whose))
    whose, word, times = whose[by_rarity], word[by_rarity], times[by_rarity]
    least = np.ceil(THRESHOLD * sizes).astype(np.int64) - sizes // 4
    own = np.searchsorted(whose, np.arange(n + 1))
    before = np.concatenate([[0], np.cumsum(times)])
    telling = np.flatnonzero(before[:-1] - before[own[whose]] <= before[own[whose + 1]] - before[own[whose]] - least[whose])
    telling = telling[np.argsort(word[telling], kind="stable")]
    spread = np.searchsorted(word[telling], np.arange(len(keys) + 1))
    ids, counts = (table.column(name).combine_chunks() for name in ("item_id", "n_items"))
    owned = owners[order]
    lengths = np.bitwise_or.reduceat(np.int64(1) << np.frexp(sizes)[1][owned].astype(np.int64), first) if len(first) else first
    return Items(distinct, np.append(first, len(values)), owned, ids, counts, hashes, begins, keys, own, word, times, least, spread, whose[telling], lengths)


def _find(seeds: np.ndarray, rows: np.ndarray, hashes: np.ndarray, whole: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and indexes into seeds of the seeds in a piece, by place."""
    sizes = [(SEED, whole)] + ([(n, windows(hashes, n)) for n in range(1, SEED)] if short else [])
    spots, which, last = [], [], []
    for n, values in sizes:
        values = values.view(np.int64)
        at = np.minimum(np.searchsorted(seeds, values), len(seeds) - 1)
        hit = np.flatnonzero(seeds[at] == values)
        spots.append(hit)
        which.append(at[hit])
        last.append(hit + n - 1)
    spots, which, last = np.concatenate(spots), np.concatenate(which), np.concatenate(last)
    row = np.searchsorted(rows, spots, "right") - 1
    inside = last < rows[row + 1]
    spots, which, row = spots[inside], which[inside], row[inside]
    order = np.argsort(spots, kind="stable")
    return row[order], spots[order], which[order]


def _windows(rows: np.ndarray, r: np.ndarray, first: np.ndarray, last: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of two margins, one margin apart, over stretches of places with a margin on either side: the stretch of each, begin and end. What is no longer than a margin lies in one of them."""
    begin, end = np.maximum(rows[r], first - margin), np.minimum(rows[r + 1], last + margin)
    count = np.maximum(1, -(-(end - begin) // margin) - 1)
    of = np.repeat(np.arange(len(r)), count)
    begin = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * margin[of]
    return of, begin, np.minimum(end[of], begin + 2 * margin[of])


def _rare(known: Items, rows: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, item, begin and end of the windows around the places of each item's rare seeds, for some places at a time.

    An alignment that holds a place lies within that place's own margin, so the places may be parted anywhere.
    """
    row, spots, which = found
    many = known.first[which + 1] - known.first[which]
    upto = np.concatenate([[0], np.cumsum(many)])
    for a, b in pieces(upto, PLACES):
        k = np.repeat(np.arange(a, b), many[a:b])
        if not len(k):
            continue
        item = known.owners[known.first[which[k]] + np.arange(len(k)) - (upto[k] - upto[a])]
        order = np.lexsort((spots[k], item, row[k]))
        r, item, at = row[k][order], item[order], spots[k][order]
        margin = 2 * (known.begins[item + 1] - known.begins[item])
        new = np.ones(len(k), bool)
        new[1:] = (r[1:] != r[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > 2 * margin[1:])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(k)) - 1
        of, begin, end = _windows(rows, r[head], at[head], at[tail], margin[head])
        yield r[head][of], item[head][of], begin, end


def _common(known: Items, rows: np.ndarray, hashes: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for common seeds: around their places, for the items of each order of length, those of which the window holds enough words."""
    row, spots, which = found
    sizes = np.diff(known.begins)
    order = np.frexp(sizes)[1]
    bits = known.lengths[which]
    for length in range(int(np.bitwise_or.reduce(bits, initial=0)).bit_length()):
        mine = np.flatnonzero((bits >> length) & 1)
        if not len(mine):
            continue
        r, at, seed = row[mine], spots[mine], which[mine]
        margin = 2 * int(sizes[order == length].max())
        new = np.ones(len(mine), bool)
        new[1:] = (r[1:] != r[:-1]) | (at[1:] - at[:-1] > 2 * margin)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(mine)) - 1
        of, begins, ends = _windows(rows, r[head], at[head], at[tail], np.full(len(head), margin))
        for stretch, begin, end in zip(of.tolist(), begins.tolist(), ends.tolist(), strict=True):
            inside = np.unique(seed[np.searchsorted(at, begin) : np.searchsorted(at, end)])
            item = _likely(known, inside, hashes[begin:end]) if len(inside) else inside
            item = item[order[item] == length]
            if len(item):
                yield np.full(len(item), r[head[stretch]]), item, np.full(len(item), begin), np.full(len(item), end)


def _reach(begins: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists ``which`` of many laid end to end, and the length of each."""
    each = begins[which + 1] - begins[which]
    return np.repeat(begins[which] - (np.cumsum(each) - each), each) + np.arange(int(each.sum())), each


def _likely(known: Items, inside: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The items with a seed of ``inside`` of which the window holds enough words. Only lists of words that tell items apart are read, so wording that all items share costs nothing."""
    here = np.unique(window)
    key = np.minimum(np.searchsorted(known.keys, here), len(known.keys) - 1)
    key = key[known.keys[key] == here]
    item = np.unique(known.holders[_reach(known.spread, key)[0]])
    holds = np.zeros(len(item), bool)
    for seed in inside:
        owners = known.owners[known.first[seed] : known.first[seed + 1]]
        holds |= owners[np.minimum(np.searchsorted(owners, item), len(owners) - 1)] == item
    item = item[holds]
    post, each = _reach(known.own, item)
    present = np.minimum(np.searchsorted(key, known.mine[post]), max(0, len(key) - 1))
    found = known.times[post] * (key[present] == known.mine[post]) if len(post) else post
    return item[np.bincount(np.repeat(np.arange(len(item)), each), found, len(item)) >= known.least[item]]


def _passages(known: Items, rows: np.ndarray, hashes: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, item, begin and end of all windows to align."""
    rare = known.first[found[2] + 1] - known.first[found[2]] <= RARE
    yield from _rare(known, rows, tuple(x[rare] for x in found))
    yield from _common(known, rows, hashes, tuple(x[~rare] for x in found))


def most(passage: np.ndarray, wanted: np.ndarray) -> int:
    """A score that no alignment of the two exceeds: that of the item's best stretch if all its words that the passage holds anywhere matched."""
    up = np.concatenate([[0], np.cumsum(np.where(np.isin(wanted, passage), MATCH, max(MISMATCH, GAP)))])
    return int((up - np.minimum.accumulate(up)).max())


def align(passages: list[np.ndarray], wanted: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of each passage with its item (word hashes): best score, and start and end in the passage of the aligned words.

    Row by row over all pairs of a batch: within a row, gaps are a running maximum.
    """
    n = len(passages)
    score, begin, end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = sorted(range(n), key=lambda i: (len(passages[i]), len(wanted[i])))
    at = 0
    while at < n:
        upto = at + 1
        while upto < n and (upto - at + 1) * (len(passages[order[upto]]) + 1) <= CELLS // 8:
            upto += 1
        pick = order[at:upto]
        wide, deep = max(len(passages[i]) for i in pick), max(len(wanted[i]) for i in pick)
        text, item = np.zeros((len(pick), wide), np.uint64), np.full((len(pick), deep), 1, np.uint64)
        real = np.zeros((len(pick), wide), bool)
        for k, i in enumerate(pick):
            text[k, : len(passages[i])], real[k, : len(passages[i])] = passages[i], True
            item[k, : len(wanted[i])] = wanted[i]
        depth = np.array([len(wanted[i]) for i in pick])
        slope = np.arange(wide + 1) * -GAP
        # A cell packs its score above the start of its alignment, so that one maximum carries both (the nearer start wins ties).
        unit = np.int64(1) << 32
        here = np.broadcast_to(np.arange(wide + 1, dtype=np.int64), (len(pick), wide + 1)).copy()
        above, best, where = here.copy(), np.zeros(len(pick), np.int64), np.zeros(len(pick), np.int64)
        for d in range(deep):
            step = np.where((text == item[:, d : d + 1]) & real, MATCH, MISMATCH) * unit
            now = here.copy()
            now[:, 1:] = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] + GAP * unit), here[:, 1:])
            now = np.maximum.accumulate(now + slope * unit, axis=1) - slope * unit
            now = np.where(now < unit, here, now)
            live = np.where(d < depth, 1, 0)
            spot = now.argmax(axis=1)
            top = now[np.arange(len(pick)), spot] * live
            better = top // unit > best // unit
            best, where = np.where(better, top, best), np.where(better, spot, where)
            above = now
        score[pick], begin[pick], end[pick] = best // unit, best % unit, where
        at = upto
    return score, begin, end


@tidy
def _copies(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    known, short = shared.value
    sizes = np.diff(known.begins)
    for batch in batches:
        for lo, _, _, _, rows, hashes, whole in _hashed(batch.column(1)):
            for r, item, begin, end in _passages(known, rows, hashes, _find(known.seeds, rows, hashes, whole, short)):
                texts_ = [hashes[a:b] for a, b in zip(begin, end, strict=True)]
                wanted = [known.words[known.begins[i] : known.begins[i + 1]] for i in item]
                pick = [k for k, (x, y) in enumerate(zip(texts_, wanted, strict=True)) if most(x, y) >= THRESHOLD * MATCH * len(y)]
                score, start, stop = align([texts_[k] for k in pick], [wanted[k] for k in pick])
                share = score / (MATCH * sizes[item[pick]])
                keep = np.flatnonzero(share >= THRESHOLD)
                if not len(keep):
                    continue
                at = np.array(pick)[keep]
                base, which = begin[at] - rows[r[at]], pa.array(item[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + r[at])), known.ids.take(which), known.counts.take(which), pa.array(share[keep]), pa.array(base + start[keep]), pa.array(base + stop[keep])],
                    names=["doc_id", "item_id", "n_items", "score", "first_word", "end_word"],
                )


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item that it holds a copy of: ``doc_id, item_id, n_items, score, first_word, end_word`` (of the best copy)."""
    spark = docs.sparkSession
    texts_ = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    kind = dict(texts_.dtypes)["doc_id"]
    known = written(items(benchmark), "items")
    bounds = known.df.agg(F.min("n_words").alias("least"), F.sum(F.size("seeds")).alias("n")).first()
    out = f"doc_id {kind}, item_id {dict(known.df.dtypes)['item_id']}, n_items bigint, score double, first_word bigint, end_word bigint"
    # Beyond the bound the items go out in parts, each with its own pass over the texts.
    parts, found = -(-(bounds["n"] or 0) // MAX_SEEDS), []
    for k in range(parts):
        table = known.df.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == k).toArrow()
        if table.num_rows:
            shared = spark.sparkContext.broadcast((_packed(table), bounds["least"] < SEED))
            found.append(texts_.mapInArrow(lambda x, shared=shared: _copies(x, shared), out))
    known.drop()
    if not found:
        return spark.createDataFrame([], out)
    scored = found[0]
    for more in found[1:]:
        scored = scored.union(more)
    best = F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"), -F.col("end_word")))
    return scored.groupBy("doc_id", "item_id", "n_items").agg(best.alias("b")).select("doc_id", "item_id", "n_items", "b.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of benchmark items into all documents."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
