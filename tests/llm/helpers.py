"""Small dirty tables shared by the tests of the llm operators."""

import re
import zlib

LONG = " ".join(f"word{i} of text{i * 7 % 101}" for i in range(6000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, words int, kept string, sketch string"


def dirty(spark, more=()):
    """Nulls in any column, empty and blank and very long texts, ties, repeated rows, a null id, and columns whose names clash with the operators' own."""
    rows = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, LONG), (5, "the same words again and again"), (6, "the same words again and again"), (6, "the same words again and again"), (7, "ÉÀ ß 日本 😀\x00\x1f"), (None, "a text without an id"), (8, "one"), (-9, "one two three four five"), *more]
    return spark.createDataFrame([(i, t, None, None, None, None, "x", 3, "no", None) for i, t in rows], COLUMNS)


def empty(spark):
    """No rows."""
    return spark.createDataFrame([], COLUMNS)


def lower(text):
    """A-Z only."""
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    """Runs without white space."""
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(i):
    """crc32 of an id as text."""
    return zlib.crc32(str(i).encode())


def tuples(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
