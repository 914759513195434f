"""Metadata: upserts, counts by category, compositions, searches, sorts and column rewrites."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.model import CategorySpec
from cladewise.operators.numbering import numbered

PALETTE = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")
NO_COLOUR = "#FFFFFF"


def upsert(old: DataFrame, new: DataFrame, key: str = "ID") -> DataFrame:
    """Rows of ``new`` overwrite those of ``old`` column by column (a null leaves the old value); rows of new keys are added, with ``__Node`` as the key."""
    columns = [c for c in old.columns if c != key] + [c for c in new.columns if c not in old.columns]
    a, b = old.alias("a"), new.alias("b")
    out = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    pick = lambda c: F.coalesce(*([F.col(f"b.`{c}`")] if c in new.columns else []), *([F.col(f"a.`{c}`")] if c in old.columns else []))
    out = out.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[pick(c).alias(c) for c in columns])
    return out.withColumn("__Node", F.coalesce("__Node", key)) if "__Node" in out.columns else out.withColumn("__Node", F.col(key))


def with_nodes(nodes: DataFrame, metadata: DataFrame, node: str = "node_id", key: str = "ID") -> DataFrame:
    """Each node with all of its records; a node without any has one row of nulls."""
    return nodes.join(metadata, nodes[node] == metadata[key], "left")


def blank(value: Column, zero: bool = False) -> Column:
    """Null, empty and undefined; with ``zero`` also 0."""
    text = value.cast("string")
    out = text.isNull() | text.isin("", "NaN")
    return out | (text == "0") if zero else out


def category_counts(metadata: DataFrame, spec: CategorySpec, nodes: DataFrame | None = None, key: str = "ID") -> DataFrame:
    """``value, n, place``: counts of a column's values among the tree's nodes, by size or by value; blank values (but not 0) are left out."""
    rows = metadata if nodes is None else metadata.join(nodes.select(F.col("node_id").alias(key)).distinct(), key, "left_semi")
    counts = rows.filter(~blank(F.col(spec.column))).groupBy(F.col(spec.column).cast("string").alias("value")).agg(F.count("*").alias("n")).filter(F.col("n") >= spec.least)
    by_value = [F.expr("try_cast(value as double)")] if spec.numeric else []
    order = [F.desc("n"), *by_value, "value"] if spec.by_size else [*by_value, "value"]
    return numbered(counts, order)


def top_and_others(counts: DataFrame, top: int, palette: tuple[str, ...] = PALETTE, custom: dict[str, str] | None = None) -> DataFrame:
    """``value, n, colour``: the first ``top`` values with colours of the palette (custom ones first), the rest together as ``Others``."""
    kept = F.col("place") <= top
    colour = F.array(*[F.lit(c) for c in palette])[((F.col("place") - 1) % len(palette)).cast("int")]
    for value, own in (custom or {}).items():
        colour = F.when(F.col("value") == value, own).otherwise(colour)
    return counts.groupBy(F.when(kept, F.col("value")).otherwise("Others").alias("value")).agg(F.sum("n").alias("n"), F.max(F.when(kept, colour).otherwise(NO_COLOUR)).alias("colour"))


def composition(members: DataFrame, metadata: DataFrame, column: str, key: str = "ID") -> DataFrame:
    """``group_id, value, n`` of each display node's members' records; blank values, 0 among them, and members without records are ``missing``."""
    both = members.join(metadata.select(F.col(key).alias("node_id"), F.col(column).cast("string").alias("_v")), "node_id", "left")
    return both.groupBy("group_id", F.when(blank(F.col("_v"), zero=True), "missing").otherwise(F.col("_v")).alias("value")).agg(F.count("*").alias("n"))


def one_by_one(parts: DataFrame) -> DataFrame:
    """A row for each item of a composition, numbered from 1."""
    return parts.withColumn("item", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")


def node_labels(nodes: DataFrame, metadata: DataFrame, column: str, order: str, key: str = "ID") -> DataFrame:
    """``node_id, label``: the field of the node's first record, or ``ND``."""
    first = metadata.groupBy(F.col(key).alias("node_id")).agg(F.min_by(F.col(column).cast("string"), order).alias("label"))
    return nodes.select("node_id").join(first, "node_id", "left").select("node_id", F.when(blank(F.col("label")), "ND").otherwise(F.col("label")).alias("label"))


def checked(pattern: str) -> str | None:
    """The pattern, case-insensitive; None where it is no regular expression."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    return f"(?i){pattern}"


def search(metadata: DataFrame, pattern: str, column: str | None = None, key: str = "ID") -> DataFrame:
    """Distinct keys of records that match in one column, or in any."""
    if (found := checked(pattern)) is None:
        return metadata.select(key).limit(0)
    columns = [column] if column else metadata.columns
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c).cast("string").rlike(found), F.lit(False))
    return metadata.filter(test).select(key).distinct()


def column_filter(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Rows that match in every column that has a (valid) pattern."""
    for column, pattern in patterns.items():
        if pattern and (found := checked(pattern)) is not None:
            rows = rows.filter(F.coalesce(F.col(column).cast("string"), F.lit("")).rlike(found))
    return rows


def typed_order(column: str, descending: bool = False, tie: str = "id") -> list[Column]:
    """Numbers before other strings, by value; both turn round when descending, the tie-break doesn't."""
    text = F.col(column).cast("string")
    parsed = F.expr(f"try_cast(`{column}` as double)")
    keys = [parsed.isNull(), parsed, text]
    return [*(k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys), F.col(tie).asc()]


def reindexed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows numbered from 1 in an order."""
    return numbered(rows, order, name)


def visible(metadata: DataFrame, nodes: DataFrame, show_hypothetical: bool = False, key: str = "ID") -> DataFrame:
    """Records whose node exists and is not hypothetical (or is shown)."""
    return metadata.join(nodes.filter(F.lit(show_hypothetical) | ~F.col("is_hypo")).select(F.col("node_id").alias(key)).distinct(), key, "left_semi")


def replace_range(rows: DataFrame, value: str, first: int, last: int, columns: list[str], place: str = "place") -> DataFrame:
    """A value put into the columns of the rows first .. last."""
    return rows.withColumns({c: F.when(F.col(place).between(first, last), F.lit(value)).otherwise(F.col(c)) for c in columns})


def moved_column(rows: DataFrame, column: str, by: int) -> DataFrame:
    """A column moved left (negative) or right."""
    names = [c for c in rows.columns if c != column]
    names.insert(min(max(rows.columns.index(column) + by, 0), len(names)), column)
    return rows.select(*names)


def select_value(metadata: DataFrame, column: str, value: str, key: str = "ID") -> DataFrame:
    """Distinct nodes of the records that hold a value."""
    return metadata.filter(F.col(column).cast("string") == value).select(key).distinct()


def date_extent(rows: DataFrame, column: str, form: str = "yyyy-MM-dd") -> DataFrame:
    """``first, last, middle, n_undated`` of a column of dates as text."""
    parsed = F.try_to_date(F.col(column).cast("string"), form) if hasattr(F, "try_to_date") else F.expr(f"try_to_date(cast(`{column}` as string), '{form}')")
    out = rows.select(parsed.alias("d")).agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.when(F.col("d").isNull(), 1)).alias("n_undated"))
    return out.withColumn("middle", F.expr("date_add(first, cast(floor(datediff(last, first) / 2) as int))"))


def aliased(rows: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns named by the first existing column that a pattern matches, else a constant: name → (pattern, constant)."""
    out = {}
    for name, (pattern, other) in wanted.items():
        found = next((c for c in rows.columns if re.search(pattern, c, re.I)), None)
        out[name] = F.col(found) if found else F.lit(other)
    return rows.withColumns(out)


def whole_number(value: Column) -> Column:
    """The first whole number in a text, or empty where there is none or it is negative."""
    found = F.regexp_extract(value.cast("string"), r"(-*\d+)", 1)
    return F.when((found == "") | found.startswith("-"), "").otherwise(found)


def colours(value: Column, table: dict[str, str]) -> Column:
    """A value's colour, white by default."""
    out = F.lit(NO_COLOUR)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def distinct_columns(names: list[str]) -> list[str]:
    """Names without those that differ from an earlier one only by case."""
    seen: set[str] = set()
    return [n for n in names if not (n.lower() in seen or seen.add(n.lower()))]


def address(rows: DataFrame, patterns: tuple[str, ...], latitude: str, longitude: str, country: str) -> Column:
    """The non-blank geographic columns and the country, where a position is blank; else empty."""
    parts = [F.when(~blank(F.col(c)), F.col(c)) for c in rows.columns if any(re.search(p, c, re.I) for p in patterns) and c != country]
    return F.when(blank(F.col(latitude)) | blank(F.col(longitude)), F.concat_ws(" ", *parts, F.when(~blank(F.col(country)), F.col(country)))).otherwise("")


def best_places(candidates: DataFrame, key: str = "place_key") -> DataFrame:
    """Geocoder answers (``importance, x0, x1, y0, y1, country, city``) for each key as one: those within 0.7 of the best, whose boxes overlap the best one's by 90 % of either axis, and a field's value if more than half of them agree."""
    w = Window.partitionBy(key)
    near = candidates.withColumn("top", F.max("importance").over(w)).filter("importance >= 0.7 * top")
    best = near.groupBy(key).agg(F.max_by(F.struct("x0", "x1", "y0", "y1"), "importance").alias("b"))
    share = lambda a, b: F.greatest(F.least(f"{b}", f"b.{b}") - F.greatest(f"{a}", f"b.{a}"), F.lit(0.0)) >= 0.9 * F.least(F.col(b) - F.col(a), F.col(f"b.{b}") - F.col(f"b.{a}"))
    kept = near.join(best, key).filter((share("x0", "x1") & share("y0", "y1")) | (F.col("importance") >= 0.85 * F.col("top")))
    vote = lambda c: F.expr(f"case when count_if({c} = m_{c}) * 2 > count(*) then max(m_{c}) else '' end").alias(c)
    modes = kept.groupBy(key).agg(F.mode("country").alias("m_country"), F.mode("city").alias("m_city"))
    return kept.join(modes, key).groupBy(key).agg(F.avg((F.col("x0") + F.col("x1")) / 2).alias("longitude"), F.avg((F.col("y0") + F.col("y1")) / 2).alias("latitude"), vote("country"), vote("city"))


# The stops of the gradients, as parts of the way.
GRADIENTS: dict[str, tuple[tuple[float, str], ...]] = {
    "cool": ((0, "FFFF00"), (0.25, "00FF00"), (0.5, "00FFFF"), (0.75, "0000FF"), (1, "00007D")),
    "heat": ((0, "FFFF7D"), (0.25, "FFFF00"), (0.75, "FF0000"), (1, "7D0000")),
    "rainbow": ((0, "FF0000"), (0.2, "FFFF00"), (0.4, "00FF00"), (0.6, "00FFFF"), (0.8, "0000FF"), (1, "FF00FF")),
}


def gradient(place: Column, count: Column, name: str = "cool") -> Column:
    """The colour of the value at ``place`` (from 1) of ``count``, between the stops of a gradient (mixed in red, green and blue)."""
    at = F.when(count <= 1, F.lit(0.0)).otherwise((place - 1) / (count - 1))
    out = F.lit("#" + GRADIENTS[name][-1][1])
    for (low, one), (high, two) in reversed(list(zip(GRADIENTS[name], GRADIENTS[name][1:], strict=False))):
        share = (at - low) / (high - low)
        parts = [F.lpad(F.hex(F.floor(int(one[k : k + 2], 16) + share * (int(two[k : k + 2], 16) - int(one[k : k + 2], 16)) + 0.5).cast("long")), 2, "0") for k in (0, 2, 4)]
        out = F.when(at < high, F.concat(F.lit("#"), *parts)).otherwise(out)
    return out


def selected_only(rows: DataFrame, chosen: DataFrame, key: str = "ID") -> DataFrame:
    """Records of the selected nodes (``node_id``)."""
    return rows.join(chosen.select(F.col("node_id").alias(key)).distinct(), key, "left_semi")


def with_selection(rows: DataFrame, chosen: DataFrame, key: str = "ID") -> DataFrame:
    """The records with ``selected``, in step with the nodes selected in the tree."""
    flags = chosen.select(F.col("node_id").alias(key)).distinct().withColumn("selected", F.lit(True))
    return rows.join(flags, key, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def add_column(rows: DataFrame, name: str, value: str = "") -> DataFrame:
    """A new column of one value; one that is there keeps its own."""
    return rows if name in rows.columns else rows.withColumn(name, F.lit(value))


def remove_column(rows: DataFrame, name: str, key: str = "ID") -> DataFrame:
    """The records without a column; the key stays."""
    return rows if name == key else rows.drop(name)
