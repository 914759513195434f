"""A grid's rows kept in order while they are edited.

The rows are sorted once, by ranges; each range is a run, written in order. An edit
touches the runs that held the rows and those that will hold them: these few are
read, merged and written anew, all others stay as they are. A list of the runs (for
each where its files are, how many rows it has and its first row) is all that the
driver keeps. Rows are numbered by the sizes of the runs before and their place in
their own, so a page reads the runs it lies in alone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from cladewise.plans.storage import room

#: Rows of a run, about; a run of more than twice as many falls apart when it is next written.
RUN = 100_000


@dataclass(frozen=True)
class Run:
    """Where a run is written, its number there, its rows and the place of the first one in the order."""

    path: str
    number: int
    rows: int
    low: Row


@dataclass(frozen=True)
class SortedView:
    """Rows in the order of some columns, ascending, then of the key."""

    spark: SparkSession
    key: str
    order: tuple[str, ...]
    columns: tuple[str, ...]
    types: tuple[str, ...]
    runs: tuple[Run, ...]
    run_rows: int = RUN

    def _at(self) -> Column:
        """The place of a row in the order."""
        return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate((*self.order, self.key))])

    def _read(self, runs: tuple[Run, ...]) -> DataFrame:
        """The rows of some runs, each with the number ``_run`` of its run in the view. Other runs' folders are not opened."""
        out = self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in zip(self.columns, self.types, strict=True)) + ", _run int")
        of: dict[str, list[Run]] = {}
        for run in runs:
            of.setdefault(run.path, []).append(run)
        for path, some in of.items():
            number = F.create_map(*[x for run in some for x in (F.lit(run.number).cast("long"), F.lit(self.runs.index(run)))])
            rows = self.spark.read.parquet(path).filter(F.col("_part").isin([run.number for run in some]))
            out = out.union(rows.select(*self.columns, F.element_at(number, F.col("_part").cast("long")).alias("_run")))
        return out

    def _write(self, rows: DataFrame) -> tuple[Run, ...]:
        """Rows with a column ``_group`` (of whole stretches of the order) as runs, in order."""
        path, order = room(self.spark, "runs"), ["_group", *self.order, self.key]
        sorted_ = rows.repartitionByRange(max(1, -(-rows.count() // self.run_rows)), *order).sortWithinPartitions(*order)
        part = F.spark_partition_id().cast("long") * (1 << 24) + F.col("_group")
        sorted_.withColumn("_part", part).select(*self.columns, "_part").write.partitionBy("_part").parquet(path)
        if not _written(self.spark, path):
            return ()
        found = self.spark.read.parquet(path).groupBy("_part").agg(F.count("*").alias("n"), F.min(self._at()).alias("low")).collect()
        return tuple(Run(path, r["_part"], r["n"], r["low"]) for r in found)

    def rows(self) -> DataFrame:
        """All rows with ``place`` from 1."""
        return self._numbered(self.runs)

    def _numbered(self, runs: tuple[Run, ...]) -> DataFrame:
        before, upto = {}, 0
        for i, run in enumerate(self.runs):
            before[i], upto = upto, upto + run.rows
        rows = self._read(runs)
        if not runs:
            return rows.select(*self.columns, F.lit(0).cast("long").alias("place"))
        offset = F.element_at(F.create_map(*[F.lit(x) for i in before for x in (i, before[i])]), F.col("_run"))
        own = F.row_number().over(Window.partitionBy("_run").orderBy(self._at()))
        return rows.withColumn("place", (offset + own).cast("long")).select(*self.columns, "place")

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 0) of ``size`` rows, in order, of the runs that it lies in."""
        low, high, upto, some = number * size, (number + 1) * size, 0, []
        for run in self.runs:
            if upto < high and upto + run.rows > low:
                some.append(run)
            upto += run.rows
        return self._numbered(tuple(some)).filter((F.col("place") > low) & (F.col("place") <= high)).orderBy("place")

    def edited(self, changes: DataFrame | None = None, deleted: DataFrame | None = None) -> SortedView:
        """The view with rows of known keys replaced and others inserted, and rows of some keys gone."""
        parts = [x.select(self.key) for x in (changes, deleted) if x is not None]
        gone = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
        gone = gone.distinct()
        new = self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in zip(self.columns, self.types, strict=True)))
        if changes is not None:
            new = new.unionByName(changes.select(*self.columns))
        if deleted is not None:
            new = new.join(deleted.select(self.key), self.key, "left_anti").select(*self.columns)
        # A new row goes to the last run that begins before it, or to the first.
        lows = self.spark.createDataFrame([(i, *run.low) for i, run in enumerate(self.runs)], f"_to int, {', '.join(f'k{i} {t}' for i, t in enumerate(self._key_types()))}") if self.runs else None
        if lows is None:
            placed = new.withColumn("_group", F.lit(0))
        else:
            first = F.array_sort(F.collect_list(F.struct(F.struct(*[f"k{i}" for i in range(len(self.order) + 1)]).alias("low"), "_to")))
            placed = new.crossJoin(F.broadcast(lows.agg(first.alias("_lows")))).withColumn("_group", F.greatest(F.size(F.filter("_lows", lambda x: x["low"] <= self._at())) - 1, F.lit(0))).drop("_lows")
        held = self._read(self.runs).join(gone, self.key, "left_semi").select("_run").distinct()
        touched = sorted({r[0] for r in held.union(placed.select("_group").distinct()).collect()} & set(range(len(self.runs))))
        old = self._read(tuple(self.runs[i] for i in touched)).join(gone, self.key, "left_anti").select(*self.columns, F.col("_run").alias("_group"))
        merged = old.unionByName(placed.select(*self.columns, "_group"))
        rest = tuple(run for i, run in enumerate(self.runs) if i not in touched)
        runs = sorted((*rest, *self._write(merged)), key=lambda run: _comparable(run.low))
        return replace(self, runs=tuple(runs))

    def _key_types(self) -> list[str]:
        kinds = dict(zip(self.columns, self.types, strict=True))
        return [kinds[c] for c in (*self.order, self.key)]


def _comparable(low: Row) -> tuple:
    """A place in the order that Python compares as Spark does: nulls first."""
    return tuple((x is not None, x) if x is not None else (False,) for x in low)


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds any file of rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return any(s.isDirectory() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))


def sorted_view(rows: DataFrame, order: list[str], key: str, run_rows: int = RUN) -> SortedView:
    """Sort ``rows`` into runs of about ``run_rows``. Keys are distinct and not null."""
    view = SortedView(rows.sparkSession, key, tuple(order), tuple(rows.columns), tuple(t for _, t in rows.dtypes), (), run_rows)
    runs = view._write(rows.withColumn("_group", F.lit(0)))
    return replace(view, runs=tuple(sorted(runs, key=lambda run: _comparable(run.low))))
