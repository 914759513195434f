"""Grid queries: filter, sort, page, nested groups with totals, edits by id, row differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.operators.numbering import numbered

SEPARATOR = ":|:"


def bad_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    """Ids that are missing or occur more than once; empty for a valid grid."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNull() | (F.col("n") > 1))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows; size 0 is all rows."""
    ordered = rows.orderBy(*order)
    return ordered.offset(number * size).limit(size) if size else ordered


def clamp_page(total: int, number: int, size: int) -> int:
    """The page nearest to ``number`` that exists."""
    return min(max(number, 0), max(0, -(-total // size) - 1)) if size else 0


def insert(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with new ones added."""
    return rows.unionByName(new)


def update(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of known ids replaced."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new.join(rows.select(key), key, "left_semi"))


def delete(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows without those of the ids."""
    return rows.join(ids.select(key), key, "left_anti")


def number(value: str) -> Column:
    """A value as a number, null where it is none (empty, text, NaN)."""
    parsed = F.expr(f"try_cast(`{value}` as double)")
    return F.when(~F.isnan(parsed), parsed)


def aggregates(columns: dict[str, tuple[str, ...]]) -> list[Column]:
    """``kind_column`` for kinds avg, sum, min, max, n: averages and sums skip what is no number, least and greatest compare values as they are."""
    make = {"avg": lambda c: F.avg(number(c)), "sum": lambda c: F.sum(number(c)), "min": lambda c: F.min(F.col(c)), "max": lambda c: F.max(F.col(c)), "n": lambda c: F.count(number(c))}
    return [make[kind](c).alias(f"{kind}_{c}") for c, kinds in columns.items() for kind in kinds]


def group_levels(rows: DataFrame, keys: list[str], columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """A row for each group of each nesting level: ``level, group_key, keys..., n`` and totals. Levels come from one rollup."""
    level = sum((F.grouping(k) == 0).cast("int") for k in keys) - 1
    out = rows.rollup(*keys).agg(level.alias("level"), F.count("*").alias("n"), *aggregates(columns)).filter("level >= 0")
    text = [F.when(F.col("level") >= i, F.coalesce(F.col(k).cast("string"), F.lit("null"))) for i, k in enumerate(keys)]
    return out.withColumn("group_key", F.concat_ws(SEPARATOR, *text))


def predefined(groups: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Groups of one level, with empty ones (n = 0) for the predefined values that have no rows."""
    wanted = groups.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return groups.join(wanted, key, "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))


def flattened(rows: DataFrame, keys: list[str], order: list[str], collapsed: DataFrame | None = None) -> DataFrame:
    """Group rows and item rows interleaved: ``place, level, group_key, id`` (level = number of keys for items). Items and groups within a collapsed group (``group_key``) are left out."""
    groups = group_levels(rows, keys, {}).select(*keys, "level", "group_key", F.lit(None).cast("string").alias("id"), *[F.lit(None).cast(dict(rows.dtypes)[o]).alias(f"_o{i}") for i, o in enumerate(order)])
    text = [F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]
    items = rows.select(*keys, F.lit(len(keys)).alias("level"), F.concat_ws(SEPARATOR, *text).alias("group_key"), F.col("id").cast("string"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    both = groups.unionByName(items)
    if collapsed is not None:
        shut = collapsed.select(F.col("group_key").alias("_shut"))
        inside = F.col("group_key").startswith(F.concat("_shut", F.lit(SEPARATOR))) | ((F.col("group_key") == F.col("_shut")) & (F.col("level") == len(keys)))
        both = both.join(F.broadcast(shut), inside, "left_anti")
    by = [x for i, k in enumerate(keys) for x in ((F.col("level") >= i).asc(), F.col(k).asc_nulls_first(), (F.col("level") > i).asc())]
    return numbered(both, [*by, *[f"_o{i}" for i in range(len(order))], "id"]).select("place", "level", "group_key", "id")


def row_diff(old: DataFrame, new: DataFrame, place: str = "place") -> DataFrame:
    """Places whose row differs, appears or goes."""
    columns = [c for c in old.columns if c != place]
    pack = lambda df, name: df.select(place, F.struct(*columns).alias(name))
    return pack(old, "a").join(pack(new, "b"), place, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(place)


def percent(value: Column) -> Column:
    """A share of 100 as text; a dash for null."""
    return F.when(value.isNull(), "-").otherwise(F.format_string("%d%%", F.round(value).cast("long")))


def yes_no(value: Column) -> Column:
    """Yes or No."""
    return F.when(F.coalesce(value, F.lit(False)), "Yes").otherwise("No")


def refiltered(rows: DataFrame, shown: DataFrame | None, condition: Column, narrowing: bool = False) -> DataFrame:
    """The rows of a new filter: from those shown before where it only narrows the old one, else from all."""
    return (shown if narrowing and shown is not None else rows).filter(condition)
