"""Column names of tables that aren't the operators' own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def own(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever their names.

    Names that differ only in case need ``spark.sql.caseSensitive`` to be true, as for any use of such a table: without it Spark neither reads nor writes them.
    """
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def packed(df: DataFrame) -> Column:
    """A row as one struct, so that no name of its columns meets an operator's."""
    return F.struct(*own(df))
