"""Keyword search by an index of trigrams.

The index is a table of postings (three letters, the column, the key of a record),
written once, in buckets by the letters. A search reads from its regular expression
the letters that any match must hold, fetches only the postings of their trigrams
(buckets are folders, and within them the files are sorted), and matches the
expression itself against the records that hold all of them. An expression that
says nothing certain, or that isn't understood, is matched against all records: the
index never changes what is found.
"""

from __future__ import annotations

import re
import zlib
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.operators.metadata import checked, search

#: Folders that the postings fall into.
BUCKETS = 64
SIZE = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Trigrams of an expression that are looked up, at most (any of them may be left out).
MOST = 32


def _low(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def _runs(items, now: str, out: list[str]) -> str:
    """Collect runs of letters that a match holds, in order; what is left open at the end."""
    for kind, value in items:
        if kind is kinds.LITERAL:
            now += chr(value)
        elif kind is kinds.SUBPATTERN:
            now = _runs(value[3], now, out)
        elif kind is not kinds.AT:
            out.append(now)
            now = ""
            if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] >= 1:
                out.append(_runs(value[2], "", out))
    return now


def certain(pattern: str) -> list[str]:
    """Trigrams (A-Z lower-cased) that any match of a pattern holds; none where nothing is certain."""
    # Flags and the signs of one dialect alone are left to the full scan.
    if re.search(r"\(\?(?!:)|\\[^.^$|?*+()\[\]{}\\/\-wWdDsSbBntrf]", pattern):
        return []
    try:
        found: list[str] = []
        found.append(_runs(parser.parse(pattern), "", found))
    except (re.error, OverflowError, RecursionError):
        return []
    grams = {_low(run)[i : i + SIZE] for run in found for i in range(len(run) - SIZE + 1)}
    return sorted(grams)[:MOST]


def bucket(gram: Column) -> Column:
    """The folder of a trigram."""
    return (F.crc32(gram) % BUCKETS).cast("int")


def build(rows: DataFrame, path: str, key: str = "ID") -> None:
    """Write the postings of all columns of ``rows``. Sorted by ranges in which keys come last, so a trigram that most records hold is spread over files."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.translate(F.col(c).cast("string"), UPPER, LOWER).alias("text")) for c in rows.columns])).alias("f")
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("f.text") - SIZE + 1), lambda i: F.substr(F.col("f.text"), i, F.lit(SIZE))))).alias("gram")
    each = rows.select(F.col(key).alias("key"), fields).filter(F.length("f.text") >= SIZE).select("key", "f.column", grams)
    ordered = each.withColumn("bucket", bucket(F.col("gram"))).repartitionByRange("bucket", "gram", "column", "key").sortWithinPartitions("bucket", "gram", "column")
    ordered.write.partitionBy("bucket").parquet(path)


def postings(index: DataFrame, grams: list[str], column: str | None = None) -> DataFrame:
    """The postings of some trigrams: filters on the folder and on the letters, which the scan takes over."""
    found = index.filter(F.col("bucket").isin(sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})) & F.col("gram").isin(grams))
    return found.filter(F.col("column") == column) if column else found


def indexed_search(rows: DataFrame, index: DataFrame, pattern: str, column: str | None = None, key: str = "ID") -> DataFrame:
    """What ``metadata.search`` finds in ``rows``, with only the records looked at of which the index holds all certain trigrams."""
    grams = certain(pattern) if checked(pattern) is not None else []
    if not grams:
        return search(rows, pattern, column, key)
    whole = postings(index, grams, column).groupBy("key", "column").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams))
    likely = rows.join(whole.select(F.col("key").alias(key)).distinct(), key, "left_semi")
    return search(likely.select(*rows.columns), pattern, column, key)
