"""Profiles, a tree and metadata derived from the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_CODES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
PRIORITIES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User x hour of day with the first event type, as a string; ``0`` where there is none."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), F.hour("ts").alias("locus"), "event_type")
    seen = events.groupBy("sample", "locus").agg(F.min("event_type").alias("allele"))
    spine = events.select("sample").distinct().withColumn("locus", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return spine.join(seen, ["sample", "locus"], "left").withColumn("allele", F.coalesce("allele", F.lit("0")))


def events_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1: user x hour of day, packed."""
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample"), F.hour("ts").alias("locus")).agg(F.min("event_type").alias("t"))
    code = F.coalesce(*[F.when(F.col("t") == k, v) for k, v in EVENT_CODES.items()], F.lit(0))
    cells = seen.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("locus", code))).alias("m"))
    return cells.select("sample", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))).alias("alleles"))


def orders_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2: customer x order priority, with up to 3 orders as the allele: many duplicates."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("locus")).agg(F.least(F.count("*"), F.lit(3)).cast("int").alias("a"))
    cells = counts.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("locus", "a"))).alias("m"))
    return cells.select("sample", F.transform(F.sequence(F.lit(0), F.lit(PRIORITIES - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))).alias("alleles"))


def embeddings_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3: vector x dimension, in steps of a tenth: complete."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.transform("embedding", lambda x: (F.floor((x.cast("double") + 0.6) * 10) + 1).cast("int")).alias("alleles"))


def nations_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation x (market segment, quarter of balances), with up to 9 customers as the allele: 25 samples whatever the scale."""
    place = F.coalesce(*[F.when(F.col("c_mktsegment") == x, i) for i, x in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"))], F.lit(4)) * 4 + F.least(F.greatest(F.floor((F.col("c_acctbal") + 1000) / 2750), F.lit(0)), F.lit(3)).cast("int")
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("sample"), place.alias("locus")).agg(F.least(F.count("*"), F.lit(9)).cast("int").alias("a"))
    cells = counts.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("locus", "a"))).alias("m"))
    return cells.select("sample", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))).alias("alleles"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World, regions, nations (hypothetical) and customers: ``node_id, parent_id, length, depth, is_hypo, ord``."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    text = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    root = spark.range(1).select(F.lit("w").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("double").alias("length"), F.lit(0).alias("depth"), F.lit(True).alias("is_hypo"), F.lit(0).cast("long").alias("ord"))
    regions = region.select(text("r", "r_regionkey"), F.lit("w"), (F.col("r_regionkey") % 3).cast("double"), F.lit(1), F.lit(True), F.lit(0).cast("long"))
    nations = nation.select(text("n", "n_nationkey"), text("r", "n_regionkey"), (F.col("n_nationkey") % 4).cast("double"), F.lit(2), F.lit(True), F.lit(0).cast("long"))
    leaves = customer.select(text("c", "c_custkey"), text("n", "c_nationkey"), (F.col("c_custkey") % 7).cast("double"), F.lit(3), F.lit(False), F.col("c_custkey"))
    return root.union(regions).union(nations).union(leaves)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ID, segment, nation, balance`` of customers."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.join(F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"]).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ID"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.floor("c_acctbal").cast("string").alias("balance"), F.col("c_custkey").alias("ord"))


_CODES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_CODES.items())
P1 = f"""cells AS (SELECT s.sid, l.locus, coalesce(o.a, 0) AS allele FROM (SELECT DISTINCT user_id AS sid FROM events) s CROSS JOIN (SELECT range AS locus FROM range(24)) l
  LEFT JOIN (SELECT user_id AS sid, hour(ts) AS locus, CASE min(event_type) {_CODES} END AS a FROM events GROUP BY 1, 2) o ON o.sid = s.sid AND o.locus = l.locus)"""
P2 = """cells AS (SELECT s.sid, l.locus, coalesce(o.a, 0) AS allele FROM (SELECT DISTINCT o_custkey AS sid FROM orders) s CROSS JOIN (SELECT range AS locus FROM range(5)) l
  LEFT JOIN (SELECT o_custkey AS sid, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS locus, least(count(*), 3) AS a FROM orders GROUP BY 1, 2) o ON o.sid = s.sid AND o.locus = l.locus)"""
P3 = """cells AS (SELECT vec_id AS sid, unnest(range(64)) AS locus, unnest(list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 0.6) * 10) AS INT) + 1)) AS allele FROM embeddings)"""
#: Distinct profiles of ``cells``, in order, and their cells again.
REPS = """packed AS (SELECT sid, list(CAST(allele AS INT) ORDER BY locus) AS v FROM cells GROUP BY sid HAVING max(allele) > 0),
reps AS (SELECT min(sid) AS rep, count(*) AS size, v, list(sid ORDER BY sid) AS members, row_number() OVER (ORDER BY list_reverse(v)) - 1 AS idx FROM packed GROUP BY v),
p AS (SELECT rep AS sid, unnest(range(len(v))) AS locus, unnest(v) AS allele FROM reps)"""
TREE = """tree AS (SELECT 'w' AS node_id, NULL AS parent_id, CAST(NULL AS DOUBLE) AS length, 0 AS depth, true AS is_hypo, CAST(0 AS BIGINT) AS ord
  UNION ALL SELECT 'r' || r_regionkey, 'w', r_regionkey % 3, 1, true, 0 FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey % 4, 2, true, 0 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey % 7, 3, false, c_custkey FROM customer)"""
META = """meta AS (SELECT 'c' || c_custkey AS ID, c_mktsegment AS segment, n_name AS nation, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS balance, c_custkey AS ord FROM customer JOIN nation ON n_nationkey = c_nationkey)"""
#: Cells of ``nations_profile``.
PN = """cells AS (SELECT s.sid, l.locus, coalesce(o.a, 0) AS allele FROM (SELECT DISTINCT c_nationkey AS sid FROM customer) s CROSS JOIN (SELECT range AS locus FROM range(20)) l
  LEFT JOIN (SELECT c_nationkey AS sid, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END * 4 + CAST(least(greatest(floor((c_acctbal + 1000) / 2750), 0), 3) AS INT) AS locus,
    least(count(*), 9) AS a FROM customer GROUP BY 1, 2) o ON o.sid = s.sid AND o.locus = l.locus)"""
