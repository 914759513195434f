"""Corpus pipeline: quality rules, toxicity, near-duplicates, decontamination, BPE.

Each stage takes all that its predecessor kept and lets its decisions take
effect; all but the last return the columns of the documents, under any names
(names that differ only in case need ``spark.sql.caseSensitive``, without which
Spark can't read such a table). A row without a doc_id goes by a number made from
its text. Rows that share a doc_id but not the text are documents of their own;
of rows equal in both the near-duplicate stage keeps the one whose other columns
come first as JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm import op3_decontaminate, op5_bpe, op6_near_dedup, op7_toxicity, op9_quality_rules
from cladewise.llm.names import packed
from cladewise.plans.storage import made, small_batches, written

#: More ids than this (8 bytes each) are not broadcast but joined in a shuffle.
MAX_BROADCAST_IDS = 500_000
#: Rows and bytes of an Arrow batch of the last stage.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """The documents as ``row``, with ``text`` and ``key``, one for each pair of id and text, in the order of the ids; and whether any key may have several rows.

    Usually the key is the id. Where ids repeat or are null, the pairs are numbered.
    """
    rows = docs.select(packed(docs).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("key"))
    if docs.select("doc_id").groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return rows, False
    # A null id is a number above all usual ids. The bytes of the text: under a collation, different texts may be equal.
    number = F.coalesce(F.col("key"), F.shiftrightunsigned(F.xxhash64("text"), 1).bitwiseOR(F.lit(1 << 62)))
    digest = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))
    rows = rows.select("row", "text", number.alias("id"), digest.alias("digest"))
    pairs = written(rows.select("id", "digest").distinct().orderBy("id", "digest").withColumn("key", F.monotonically_increasing_id()), "keys").df
    return rows.join(pairs, ["id", "digest"]).select("row", "text", "key"), True


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (with ``key``) whose key is none of ``ids`` (a column ``key``)."""
    table = written(ids, "ids").df
    return rows.join(F.broadcast(table) if table.count() <= MAX_BROADCAST_IDS else table, "key", "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the quality rules keeps."""
    return op9_quality_rules.keep_rows(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic by a model fitted on those that got here."""
    model = op7_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op7_toxicity.keep_rows(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id."""
    rows, repeated = _keyed(docs)
    left = _without(rows, op6_near_dedup.near_duplicates(rows, "key").filter("not kept").select(F.col("doc_id").alias("key")).distinct())
    if repeated:
        rest = F.to_json(F.col("row").dropFields("text"), {"ignoreNullFields": "false"})
        left = left.groupBy("key").agg(F.min_by("row", rest).alias("row"))
    return left.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    rows, _ = _keyed(docs)
    found = op3_decontaminate.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key")
    return _without(rows, found.select(F.col("doc_id").alias("key")).distinct()).select("row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded documents, written in batches of few bytes: ids, texts and pieces of a batch take many times its room."""
    with small_batches(spark, BATCH_ROWS, BATCH_BYTES):
        return written(op5_bpe.digests(op5_bpe.round_trip(docs)), "digests").df


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: A fitted classifier stands among the stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each written and read again for the next; only the last one's result is left."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with made() as tables:
            new = written(stage(spark, docs, sf_dir), name)
        for table in last + [t for t in tables if t is not new]:
            table.drop()
        docs, last = new.df, [new]
    return docs
