"""Totals of nested groups over a stream of changes, with retractions.

A change carries a row as it was and as it is (either may be missing: a new or a
deleted row). It is taken from the groups of every level that held it and added to
those that hold it now, so a row may move between groups. State by group holds the
number of rows, the number and sum of their values, and how often each value
occurs, so that the least and the greatest are right after a deletion too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cladewise.operators.grid import SEPARATOR

#: What ``totals_stream`` needs of the session.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SCHEMA = "level int, group_key string, n bigint, valued bigint, sum_value double, min_value double, max_value double"


class Totals(StatefulProcessor):
    """The totals of one group, updated by signed rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        """State: rows, rows with a value, the sum; and the count of each value."""
        self.sums = handle.getValueState("sums", "n bigint, valued bigint, total double")
        self.values = handle.getMapState("values", "value double", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """One row with the group's totals after the rows of a batch."""
        n, valued, total = self.sums.get() if self.sums.exists() else (0, 0, 0.0)
        changed: dict[float, int] = {}
        for frame in rows:
            n += int(frame["sign"].sum())
            some = frame[frame["value"].notna()]
            valued += int(some["sign"].sum())
            total += float((some["sign"] * some["value"]).sum())
            for value, times in some.groupby("value")["sign"].sum().items():
                changed[value] = changed.get(value, 0) + int(times)
        for value, times in changed.items():
            now = (self.values.getValue((value,))[0] if self.values.containsKey((value,)) else 0) + times
            if now:
                self.values.updateValue((value,), (now,))
            elif self.values.containsKey((value,)):
                self.values.removeKey((value,))
        if not valued:
            total = 0.0
        self.sums.update((n, valued, total))
        kept = [k[0] for k in self.values.keys()]  # noqa: SIM118
        yield pd.DataFrame({"level": [int(key[0])], "group_key": [key[1]], "n": [n], "valued": [valued], "sum_value": [total if valued else None], "min_value": [min(kept, default=None)], "max_value": [max(kept, default=None)]})

    def close(self) -> None:
        """Nothing is held outside the state."""


def signed(changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``level, group_key, sign, value`` of changes ``before, after`` (structs of a row, or null): a row for each level that a row leaves or enters."""
    sides = F.array(*[F.struct(F.lit(s).alias("sign"), F.col(c).alias("row")) for c, s in (("before", -1), ("after", 1))])
    rows = changes.select(F.explode(sides).alias("s")).filter("s.row is not null")
    text = [F.coalesce(F.col(f"s.row.{k}").cast("string"), F.lit("null")) for k in keys]
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.concat_ws(SEPARATOR, *text[: i + 1]).alias("group_key")) for i in range(len(keys))])).alias("g")
    return rows.select(levels, "s.sign", F.expr(f"try_cast(s.row.`{value}` as double)").alias("value")).select("g.level", "g.group_key", "sign", "value")


def totals_stream(changes: DataFrame, keys: list[str], value: str, folder: str, checkpoint: str | None = None) -> StreamingQuery:
    """Write ``folder/v<batch>``: the totals of all groups of all levels after each batch; a group without rows goes. A batch that runs again overwrites its own version."""
    spark = changes.sparkSession
    spark.conf.set(*PROVIDER)
    updates = signed(changes, keys, value).groupBy("level", "group_key").transformWithStateInPandas(statefulProcessor=Totals(), outputStructType=SCHEMA, outputMode="Update", timeMode="None")

    def apply(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.parquet(f"{folder}/v{number - 1}") if number else batch.limit(0)
        rest = before.join(batch.select("level", "group_key"), ["level", "group_key"], "left_anti")
        rest.unionByName(batch.filter("n > 0")).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return updates.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint or f"{folder}/_checkpoint").trigger(availableNow=True).start()
