"""Profile operators.

Long form: ``sample, locus, allele`` (string alleles as read, or codes with 0 for
missing). Packed form: ``sample, alleles`` (an array with a code for each locus).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.operators.numbering import numbered

#: Upper-cased tokens that stand for a missing allele; the empty string is an allele.
MISSING = ("0", "N", "-")


def clean_allele(allele: Column) -> Column:
    """Upper-case."""
    return F.upper(allele)


def clean_name(name: Column) -> Column:
    """Replace the characters that trees can't hold by ``_``."""
    return F.regexp_replace(name, r"[() ,\"';]", "_")


def encode(long: DataFrame) -> DataFrame:
    """Codes from 1 by the sorted distinct strings of each locus; missing tokens use up a code and become 0.

    Only distinct alleles of a locus are ranked in one place, not its samples.
    """
    seen = long.select("locus", "allele").distinct()
    codes = seen.select("locus", "allele", F.expr("row_number() over (partition by locus order by allele)").alias("code"))
    coded = F.when(F.col("allele").isin(*MISSING), 0).otherwise(F.col("code")).cast("int")
    return long.join(codes, ["locus", "allele"]).select("sample", "locus", coded.alias("allele"))


def pack(long: DataFrame, loci: int) -> DataFrame:
    """Arrays over loci 0 .. loci - 1; a locus that a sample lacks is 0."""
    cells = F.map_from_entries(F.collect_list(F.struct("locus", "allele")))
    return long.groupBy("sample").agg(cells.alias("m")).select("sample", F.transform(F.sequence(F.lit(0), F.lit(loci - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))).alias("alleles"))


def unpack(packed: DataFrame, sample: str = "sample") -> DataFrame:
    """The long form of a packed profile."""
    return packed.select(F.col(sample).alias("sample"), F.posexplode("alleles").alias("locus", "allele"))


def complete_loci(packed: DataFrame) -> list[int]:
    """The loci that no sample lacks. (The list is as long as a profile is wide.)"""
    rows = packed.select(F.posexplode("alleles").alias("locus", "allele")).groupBy("locus").agg(F.min("allele").alias("least")).filter("least > 0").select("locus").collect()
    return sorted(r["locus"] for r in rows)


def complete_delete(packed: DataFrame) -> DataFrame:
    """Keep the loci that no sample lacks."""
    keep = F.array(*[F.lit(i) for i in complete_loci(packed)]) if packed.columns else None
    return packed.withColumn("alleles", F.transform(keep.cast("array<int>"), lambda i: F.get("alleles", i)))


def drop_empty(packed: DataFrame) -> DataFrame:
    """Drop samples that lack every locus."""
    return packed.filter(F.exists("alleles", lambda a: a > 0))


def duplicate_names(packed: DataFrame) -> DataFrame:
    """Sample names that occur more than once (an error for trees)."""
    return packed.groupBy("sample").count().filter("count > 1").select("sample")


def dedup(packed: DataFrame) -> DataFrame:
    """Samples of equal alleles, missing included, as one: ``rep, size, members, alleles``. The first sample represents."""
    return packed.groupBy("alleles").agg(F.min("sample").alias("rep"), F.count("*").alias("size"), F.array_sort(F.collect_list("sample")).alias("members")).select("rep", "size", "members", "alleles")


def indexed(reps: DataFrame) -> DataFrame:
    """``reps`` with ``idx`` from 0 in the order of the last locus, then the one before it, and so on."""
    return numbered(reps, [F.reverse("alleles")], "idx").withColumn("idx", F.col("idx") - 1)


def call_alleles(sequences: DataFrame, window: int = 900, step: int = 1000) -> DataFrame:
    """Alleles of aligned ``sample, sequence``: each ``window`` letters every ``step``, numbered by first occurrence in ``ord``."""
    genes = F.sequence(F.lit(0), F.greatest(F.floor((F.length("sequence") - 1) / step), F.lit(0)).cast("int"))
    cut = sequences.select("ord", "sample", "sequence", F.explode(genes).alias("locus")).select("ord", "sample", "locus", F.expr(f"substring(sequence, locus * {step} + 1, {window})").alias("gene"))
    first = cut.groupBy("locus", "gene").agg(F.min("ord").alias("first"))
    codes = first.select("locus", "gene", F.expr("row_number() over (partition by locus order by first)").alias("allele"))
    return cut.join(codes, ["locus", "gene"]).select("sample", "locus", "allele")
