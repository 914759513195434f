"""Tables that cut lineage: written to the folder every executor shares.

The folder is the one the session names in ``spark.checkpoint.dir``. A local
session that names none (as a shell does) has its warehouse; on a cluster that is
an error.
"""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return base.rstrip("/")


_kept: set[str] = set()
_made: contextvars.ContextVar[list | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def made():
    """The list of the tables written within, for the caller to drop those that nothing reads any more."""
    tables: list[Written] = []
    token = _made.set(tables)
    try:
        yield tables
    finally:
        _made.reset(token)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int, size: int | None = None):
    """Arrow batches of at most so many rows (and bytes, of which one row may have more) for what is written within; the session's settings come back afterwards."""
    held = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows} | ({"spark.sql.execution.arrow.maxBytesPerBatch": size} if size else {})
    before = {name: spark.conf.get(name) for name in held}
    for name, most in held.items():
        now = int(before[name].rstrip("bB"))
        spark.conf.set(name, str(min(most, now) if now > 0 else most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def room(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for ``sweep`` to delete."""
    path = f"{shared_dir(spark)}/cladewise-{name}-{uuid.uuid4().hex}"
    _kept.add(path)
    return path


class Written:
    """A DataFrame written as Parquet (or, with one string column, as lines of text) and read again; ``drop()`` deletes the files."""

    def __init__(self, df: DataFrame, name: str = "table", form: str = "parquet"):
        spark = df.sparkSession
        self.path = room(spark, name)
        df.write.format(form).save(self.path)
        self.df = spark.read.schema(df.schema).format(form).load(self.path)
        if (tables := _made.get()) is not None:
            tables.append(self)

    def drop(self) -> None:
        """Delete the files; later reads of ``df`` fail."""
        _delete(self.df.sparkSession, self.path)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _kept.discard(where)


def sweep(spark: SparkSession) -> int:
    """Delete all tables of this process that are left, once the results that read them are written; how many there were."""
    left = list(_kept)
    for where in left:
        _delete(spark, where)
    return len(left)


def written(df: DataFrame, name: str = "table", form: str = "parquet") -> Written:
    """Write ``df`` to the shared folder and return the table read back."""
    return Written(df, name, form)
