"""Near duplicates by bottom-k sketches from one hash function.

1. Each text gives its set of 5-word shingle hashes; texts with equal sets fall
   into one class at once, so exact copies never meet again. A class is known by
   the 128-bit digest of its set and numbered once it is written; ids come back
   in only when the components are named.
2. A class keeps the ``K`` smallest hashes of its set, its sketch. Values that
   more than ``HOT`` sketches retain are counted; in each sketch they come last.
3. Two sets with Jaccard >= 0.75 share most of their sketches (see ``needed``),
   hence a value among the first ``len - needed + 1`` of both, in any common
   order (the prefix principle). Only those values get inverted lists. A list
   of at most ``HOT`` classes gives its pairs.
   Classes that have a hot value among their first ones get lists anew, from
   their full sets: values in the order of rarity among these classes, of which
   a set of n needs n - ceil(0.75 n) + 1, and a value's place bounds what can be
   common. Each list gives the pairs of one class, the pivot, with all others;
   once these are confirmed and joined to components, it gives the pairs that
   the bounds leave possible between components. So a large group of near
   copies costs one pair for each member and list, not all pairs.
4. The union-sketch estimate filters pairs; the exact Jaccard on the full sets,
   computed once from the whole texts of the classes that are still candidates,
   confirms them. Alternating stars give the components.

The one probabilistic step is ``needed`` for sets larger than a sketch: the odds
that a pair at exactly 0.75 shares too few values are below 1.2e-8, and fall
steeply above 0.75. Sets are compared as sets of 63-bit hashes.

Defined results: null, empty and blank texts have an empty set, component
``doc_id`` and no link. A text with fewer than 5 words is one shingle. Repeated
rows each give a row. An id is one node: rows that share it but not the text
share their component, whatever set each has. Rows with a null id link with
nothing, have a null component and are kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.arrow_text import hash_words, lists, pieces, texts, tidy, windows, words
from cladewise.operators.components import star_forest
from cladewise.plans.storage import Written, small_batches, written

N = 5
K = 96
#: Values a pair must share where one of its sets is larger than a sketch.
NEEDED = 47
HOT = 24
#: More hot values than this (16 bytes each) are not broadcast but joined.
MAX_HOT = 500_000
#: More candidate classes than this (an id and a digest, some 32 bytes each) are not broadcast but joined.
MAX_BROADCAST_IDS = 500_000
#: Rows of one Arrow batch, which carries whole texts.
BATCH = 1000


def shingle_sets(column) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 63-bit hashes of its shingles."""
    data, bounds = texts(column)
    for lo, hi in pieces(bounds):
        part, own = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        starts, ends, rows = words(part, own)
        hashes = hash_words(part, starts, ends)
        whole = windows(hashes, N)
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            if b - a >= N:
                yield np.unique(whole[a : b - N + 1] >> np.uint64(1))
            elif b > a:
                yield windows(hashes[a:b], int(b - a)) >> np.uint64(1)
            else:
                yield np.zeros(0, np.uint64)


def needed(n: int) -> int:
    """Sketch values that a set of ``n`` shares with every set of Jaccard >= 0.75.

    Up to 0.75 K both sets are whole in their sketches and the count is exact.
    """
    return -(-3 * n // 4) if 4 * n <= 3 * K else NEEDED


def digest(found: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of a set's digest."""
    return np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)


@tidy
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, digests, sketches, firsts = [], [], [], []

        def out(at: int):
            one, two = np.array(digests, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at - len(sets), len(sets)), pa.array(np.array(sets, np.int64)), pa.array(one), pa.array(two), pa.array(np.array(firsts, np.int32)), lists(sketches, pa.int64())],
                names=["doc_id", "n_shingles", "d1", "d2", "n_first", "sketch"],
            )

        at = 0
        for at, found in enumerate(shingle_sets(batch.column(1)), 1):
            sets.append(len(found))
            digests.append(digest(found))
            kept = found[:K].view(np.int64)
            sketches.append(kept)
            firsts.append(len(kept) - needed(len(found)) + 1)
            if len(sets) == 1024:
                yield out(at)
                sets, digests, sketches, firsts = [], [], [], []
        if sets:
            yield out(at)


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, d1, d2`` (digest of the set), ``n_first`` (values to index) and ``sketch``."""
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_sketch, f"doc_id {kind}, n_shingles bigint, d1 bigint, d2 bigint, n_first int, sketch array<bigint>")


@tidy
def _order(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    """The first values of each sketch, in the order (hot values last and by count, hash)."""
    values, counts = hot.value
    for batch in batches:
        sizes, firsts, column = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
        bounds = column.offsets.to_numpy().astype(np.int64)
        flat = column.values.to_numpy()[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        rank = np.zeros(len(flat), np.int64)
        if len(values):
            spot = np.minimum(np.searchsorted(values, flat), len(values) - 1)
            rank = np.where(values[spot] == flat, counts[spot], 0)
        row = np.repeat(np.arange(len(firsts)), np.diff(bounds))
        order = np.lexsort((flat, rank, row))
        keep = order[np.arange(len(flat)) - bounds[row] < firsts[row]]
        of = pa.array(row[keep])
        yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), batch.column(0).take(of), pa.array(sizes[row[keep]]), pa.array(rank[keep] > 0)], names=["value", "rep", "n", "hot"])


def first_values(classes: DataFrame) -> DataFrame:
    """``value, rep, n, hot`` for each value of a class that gets into the inverted lists."""
    spark = classes.sparkSession
    counts = written(classes.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count("*").alias("n")).filter(F.col("n") > HOT), "hot")
    if counts.df.count() <= MAX_HOT:
        table = counts.df.orderBy("value").toArrow()
        hot = spark.sparkContext.broadcast((table.column("value").to_numpy(), table.column("n").to_numpy()))
        counts.drop()
        return classes.select("rep", "n_shingles", "n_first", "sketch").mapInArrow(lambda x: _order(x, hot), "value bigint, rep bigint, n bigint, hot boolean")
    rows = classes.select("rep", "n_shingles", "n_first", F.explode("sketch").alias("value")).join(counts.df, "value", "left")
    whole = rows.groupBy("rep", "n_shingles", "n_first").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("rank"), "value"))).alias("s"))  # K values at most
    return whole.select("rep", F.col("n_shingles").alias("n"), F.explode(F.slice("s", 1, F.col("n_first"))).alias("e")).select("e.value", "rep", "n", (F.col("e.rank") > 0).alias("hot"))


SIZES = "4 * least(n1, n2) >= 3 * greatest(n1, n2)"


def short_pairs(firsts: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the lists that are not hot: at most HOT classes each."""
    got = firsts.filter("not hot").groupBy("value").agg(F.collect_list(F.struct("rep", "n")).alias("l")).filter(F.size("l") > 1)
    one = got.select(F.posexplode("l").alias("i", "x"), "l")
    two = one.select(F.col("x.rep").alias("r1"), F.col("x.n").alias("n1"), F.explode(F.expr("slice(l, i + 2, size(l))")).alias("y"))
    return _pairs(two.select("r1", "n1", F.col("y.rep").alias("r2"), F.col("y.n").alias("n2")))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.filter(f"{SIZES} and r1 <> r2").select(F.least("r1", "r2").alias("a"), F.greatest("r1", "r2").alias("b")).distinct()


@tidy
def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(shingle_sets(batch.column(1)))
        for a in range(0, len(found), 256):
            part = found[a : a + 256]
            one, two = np.array([digest(x) for x in part], np.int64).reshape(-1, 2).T
            sizes = pa.array(np.array([len(x) for x in part], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), pa.array(one), pa.array(two), sizes, lists([x.view(np.int64) for x in part], pa.int64())], names=["doc_id", "d1", "d2", "n", "set"])


def full_sets(classes: DataFrame, reps: DataFrame, docs: DataFrame) -> Written:
    """``rep, n, set`` of the classes in ``reps``, each from the whole text of one of its rows."""
    ids = written(classes.join(reps.distinct(), "rep", "left_semi").select(F.col("least").alias("doc_id"), "d1", "d2", "rep"), "ids")
    few = ids.df.count()
    hint = F.broadcast if few <= MAX_BROADCAST_IDS else lambda x: x
    # An id may stand for several texts: the digest says which is the class's.
    some = docs.select("doc_id", "text").join(hint(ids.df.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = some.mapInArrow(_full_sets, f"doc_id {dict(docs.dtypes)['doc_id']}, d1 bigint, d2 bigint, n bigint, set array<bigint>")
    found = written(rows.join(hint(ids.df), ["doc_id", "d1", "d2"]).select("rep", "n", "set"), "sets")
    ids.drop()
    if found.df.count() == few:
        return found
    once = written(found.df.dropDuplicates(["rep"]), "sets")  # repeated rows gave a set each
    found.drop()
    return once


def long_lists(sets: DataFrame) -> Written:
    """``value, rep, n, i``: the full sets' rarest values, enough of them that two sets with Jaccard >= 0.75 share one.

    ``i`` is the value's place in its set, rarest first (by sets among these
    that hold it, then by hash). At most n - i + 1 values can be common from
    there on, so a row goes where that is too few for the smallest set of its
    list; and values of one set have no list.
    """
    values = written(sets.select("rep", "n", F.explode("set").alias("value")), "values")
    counts = values.df.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = values.df.join(counts, "value", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    ranked = ranked.withColumn("i", F.expr("row_number() over (partition by rep order by df, value)").cast("long"))
    first = written(ranked.filter("df > 1 and i <= n - ceil(0.75 * n) + 1").select("value", "rep", "n", "i"), "first")
    values.drop()
    least = first.df.groupBy("value").agg(F.min("n").alias("least"), F.count("*").alias("c")).filter("c > 1").drop("c")
    out = written(first.df.join(least, "value").filter("7 * (n - i + 1) >= 3 * (n + greatest(least, ceil(0.75 * n)))").drop("least"), "lists")
    first.drop()
    return out


#: What two places of one value leave possible: sizes, and the values common from there on.
PLACES = f"{SIZES} and 7 * (1 + least(n1 - i1, n2 - i2)) >= 3 * (n1 + n2)"


def star_pairs(lists_: DataFrame) -> DataFrame:
    """Pairs of each list's pivot, the class with the most values that can be common, with the list's other classes."""
    pivot = lists_.groupBy("value").agg(F.min(F.struct("i", "n", "rep")).alias("p"))
    both = lists_.join(pivot, "value").select(F.col("p.rep").alias("r1"), F.col("p.n").alias("n1"), F.col("p.i").alias("i1"), F.col("rep").alias("r2"), F.col("n").alias("n2"), F.col("i").alias("i2"))
    return _pairs(both.filter(PLACES))


def rest_pairs(lists_: DataFrame) -> DataFrame:
    """All pairs between components that the lists' places leave possible: classes outside the component of their list's pivot, with all."""
    pivot = lists_.groupBy("value").agg(F.min(F.struct("i", "n", "rep", "component")).alias("p"))
    one = lists_.join(pivot, "value").filter("component <> p.component").select("value", F.col("rep").alias("r1"), F.col("n").alias("n1"), F.col("i").alias("i1"), F.col("component").alias("c1"))
    two = lists_.select("value", F.col("rep").alias("r2"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("component").alias("c2"))
    return _pairs(one.join(two, "value").filter(f"c1 <> c2 and {PLACES}"))


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b, whole``: pairs that the sketch of the union leaves possible.

    Sets that are whole in their sketches are compared exactly, and these pairs
    are links (``whole``). Else the K smallest values of both sketches are a
    sample of the union, of which at least NEEDED must be in both.
    """
    side = lambda k, n: classes.select(F.col("rep").alias(k), F.col("n_shingles").alias(f"n{n}"), F.col("sketch").alias(f"s{n}"))
    both = pairs.join(side("b", 2), "b").join(side("a", 1), "a").withColumns({"whole": F.expr(f"n1 <= {K} and n2 <= {K}"), "common": F.array_intersect("s1", "s2")})
    # 100 c >= 75 (n1 + n2 - c)
    both = both.filter(f"if(whole, 7L * size(common) >= 3 * (n1 + n2), size(common) >= {NEEDED})")
    both = both.withColumn("last", F.expr(f"get(sort_array(array_union(s1, s2)), {K - 1})"))
    return both.filter(f"whole or size(filter(common, x -> x <= last)) >= {NEEDED}").select("a", "b", "whole")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of ``estimated`` whose full sets have a Jaccard of 0.75 or more."""
    side = lambda k, n: sets.select(F.col("rep").alias(k), F.col("n").alias(f"n{n}"), F.col("set").alias(f"s{n}"))
    both = pairs.filter("not whole").join(side("b", 2), "b").join(side("a", 1), "a")
    return pairs.filter("whole").select("a", "b").union(both.filter(7 * F.size(F.array_intersect("s1", "s2")).cast("long") >= 3 * (F.col("n1") + F.col("n2"))).select("a", "b"))


def linked(classes: DataFrame, docs: DataFrame) -> Written | None:
    """The star forest of the confirmed links between classes: all of the short lists, and of the long ones enough to connect what is connected."""
    firsts = first_values(classes)
    hot = written(firsts.filter("hot").select("rep").distinct(), "reps")
    short = written(estimated(short_pairs(firsts), classes), "pairs")
    left = short.df.filter("not whole")
    sets = full_sets(classes, left.select(F.col("a").alias("rep")).union(left.select("b")).union(hot.df), docs)
    links = confirmed(short.df, sets.df)
    if hot.df.isEmpty():
        forest, made = star_forest(links, "a", "b"), []
    else:
        long = long_lists(sets.df.join(hot.df, "rep", "left_semi"))
        stars = written(estimated(star_pairs(long.df), classes), "pairs")
        forest = star_forest(links.union(confirmed(stars.df, sets.df)), "a", "b")
        rest = written(estimated(rest_pairs(_with_component(long.df, forest)), classes), "rest")
        made = [long, stars, rest]
        if not rest.df.isEmpty():
            more = confirmed(rest.df, sets.df)
            was, forest = forest, star_forest(more if forest is None else more.union(forest.df), "a", "b")
            made += [was] if was else []
    for table in [hot, short, sets, *made]:
        table.drop()
    return forest


def _with_component(rows: DataFrame, forest: Written | None) -> DataFrame:
    if forest is None:
        return rows.withColumn("component", F.col("rep"))
    found = forest.df.select(F.col("node").alias("rep"), F.col("component").alias("_c"))
    return rows.join(found, "rep", "left").withColumn("component", F.coalesce("_c", "rep")).drop("_c")


def _bridged(forest: Written | None, classes: DataFrame, own: DataFrame) -> Written | None:
    """The forest with the classes joined that rows of one id (``doc_id, d1, d2``) belong to."""
    of = own.distinct().join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "rep")
    ties = of.join(of.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b")
    out = star_forest(ties if forest is None else ties.union(forest.df), "a", "b")
    if forest is not None:
        forest.drop()
    return out


def _members(classes: DataFrame, forest: Written | None) -> DataFrame:
    """``d1, d2, component`` of each class: the smallest id of its component."""
    if forest is None:
        return classes.select("d1", "d2", F.col("least").alias("component"))
    nodes = forest.df.select("node", "component").union(forest.df.select(F.col("component").alias("node"), "component").distinct())
    ids = nodes.join(classes.select(F.col("rep").alias("node"), "least"), "node")
    named = ids.select("node", F.col("component").alias("root")).join(ids.groupBy(F.col("component").alias("root")).agg(F.min("least").alias("lowest")), "root")
    return classes.join(named.select(F.col("node").alias("rep"), "lowest"), "rep", "left").select("d1", "d2", F.coalesce("lowest", "least").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: ``doc_id, n_shingles, component_id, kept``."""
    with small_batches(df.sparkSession, BATCH):
        return _near_duplicates(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def _near_duplicates(docs: DataFrame) -> DataFrame:
    rows = written(sketches(docs), "sketches")
    some = rows.df.filter("n_shingles > 0 and doc_id is not null")
    one = F.min_by(F.struct("n_shingles", "n_first", "sketch"), "doc_id")
    grouped = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), one.alias("s"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("rep"), "d1", "d2", "least", "s.*"), "classes")
    halves = F.struct("d1", "d2")
    mixed = rows.df.filter("doc_id is not null").groupBy("doc_id").agg(F.min(halves).alias("lo"), F.max(halves).alias("hi")).filter("lo < hi")
    several = written(mixed.select("doc_id"), "several")  # ids of several sets
    repeated = not several.df.isEmpty()
    forest = linked(classes.df, docs)
    if repeated:
        forest = _bridged(forest, classes.df, some.join(several.df, "doc_id", "left_semi").select("doc_id", "d1", "d2"))
    members = written(_members(classes.df, forest), "members")
    for table in [classes, *([forest] if forest else [])]:
        table.drop()
    own = rows.df.select("doc_id", "n_shingles", "d1", "d2").join(members.df, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    out = own.select("doc_id", "n_shingles", component.alias("component_id"))
    if repeated:
        least = out.join(several.df, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    else:
        several.drop()
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Independent of the Spark form: all shingles joined, links by counting, components by recursion.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
n AS MATERIALIZED (SELECT rid, doc_id, count(*) AS n FROM s GROUP BY 1, 2),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM c JOIN n x ON x.rid = c.a JOIN n y ON y.rid = c.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.least, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN m ON m.a = d.doc_id
"""
