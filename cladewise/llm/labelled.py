"""Bounded samples of labelled rows, and the folds that ids fall into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def sample(labels: DataFrame, column: str, fold: Column, most: int, by_class: bool) -> DataFrame:
    """``doc_id, label`` of at most ``most`` labelled ids outside ``fold`` (of each class, with ``by_class``), in the order of a hash.

    An id labelled twice takes the larger label; null ids and labels are left out. The bound makes the result fit to be broadcast.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~fold).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    if not by_class:
        return one.orderBy(*order).limit(most)
    return one.filter("label = 0").orderBy(*order).limit(most).union(one.filter("label = 1").orderBy(*order).limit(most))


def shares(labels: DataFrame, column: str, fold: Column) -> tuple[int, int]:
    """How many ids outside ``fold`` have label 0 and label 1."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~fold).groupBy("doc_id").agg(F.max(column).alias("label"))
    row = one.agg(F.count(F.when(F.col("label") == 0, 1)).alias("n0"), F.count(F.when(F.col("label") == 1, 1)).alias("n1")).first()
    return row["n0"], row["n1"]


def texts_of(docs: DataFrame, chosen: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, label, text`` of the sample's ids, one row each: where an id has several texts, the first in their order."""
    rows = docs.select("doc_id", F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
