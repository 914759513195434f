"""Metadata that arrives as a stream: each micro-batch is upserted into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cladewise.operators.metadata import upsert


def upsert_stream(changes: DataFrame, folder: str, key: str = "ID", checkpoint: str | None = None) -> StreamingQuery:
    """Write ``folder/v<batch>``: the table after each batch. A batch that runs again overwrites its own version, so a restart loses and doubles nothing.

    Of rows of one key within a batch, one of the largest (column by column) counts.
    """

    def apply(batch: DataFrame, number: int) -> None:
        from pyspark.sql import functions as F

        spark = batch.sparkSession
        one = batch.groupBy(key).agg(F.max(F.struct(*[c for c in batch.columns if c != key])).alias("r")).select(key, "r.*")
        before = spark.read.parquet(f"{folder}/v{number - 1}") if number else None
        (upsert(before, one, key) if before is not None else upsert(one.limit(0), one, key)).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint or f"{folder}/_checkpoint").trigger(availableNow=True).start()
