"""Profiles, aligned sequences and metadata: files or literal text to DataFrames."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.operators.profile import clean_allele, clean_name

SKIPPED_COLUMNS = ("st_id", "st")


def lines(spark: SparkSession, source: str) -> DataFrame:
    """``line, ord``: of a literal text (it holds a newline), or of a file or folder (gzip by its name), whose files follow one another by name."""
    if "\n" in source:
        return spark.createDataFrame(list(enumerate(source.split("\n"))), "ord long, line string").select("line", "ord")
    # A line's place: its file, its block of the file, and its place in the task that reads the block.
    place = [F.lpad(c.cast("string"), 20, "0") for c in (F.col("_metadata.file_block_start"), F.monotonically_increasing_id())]
    return spark.read.text(source).select(F.col("value").alias("line"), F.concat_ws(" ", "_metadata.file_path", *place).alias("ord"))


def header(rows: DataFrame) -> tuple[list[str], bool]:
    """The header's fields, and whether it was an ordinary line: the last line of ``#`` before the data (``##`` is a comment), else the first line."""
    first = rows.filter("line not like '#%'").agg(F.min("ord").alias("ord"), F.min_by("line", "ord").alias("line")).first()
    named = rows.filter("line like '#%' and line not like '##%'")
    last = (named if first["ord"] is None else named.filter(F.col("ord") < first["ord"])).agg(F.max_by("line", "ord")).first()[0]
    return (last or first["line"] or "").strip("\r\n").split("\t"), last is None and first["ord"] is not None


def loci(fields: list[str]) -> list[int]:
    """Positions of the columns that are loci."""
    return [i for i, name in enumerate(fields) if i > 0 and not name.startswith("#") and name.lower() not in SKIPPED_COLUMNS]


def read_profile(spark: SparkSession, source: str) -> DataFrame:
    """``sample, locus, allele`` (upper-case strings; loci numbered from 0) of a tab-separated profile or aligned sequences.

    Rows without a name are dropped; a row with fewer fields than the header raises when it is read.
    """
    rows = lines(spark, source)
    if not rows.filter("line like '>%'").limit(1).isEmpty():
        return read_fasta(spark, source)
    fields, plain = header(rows)
    data = rows.filter("line not like '#%'")
    if plain:
        first = data.agg(F.min("ord")).first()[0]
        data = data.filter(F.col("ord") != (first if first is not None else -1))
    keep = loci(fields)
    cells = data.select(F.split(F.regexp_replace("line", r"[\r\n]+$", ""), "\t").alias("f")).filter("trim(f[0]) <> ''")
    checked = F.when(F.size("f") < max(keep, default=0) + 1, F.raise_error(F.concat(F.lit("a profile row has too few fields: "), F.col("f")[0]))).otherwise(F.array(*[F.col("f")[i] for i in keep]))
    return cells.select(clean_name(F.trim(F.col("f")[0])).alias("sample"), F.posexplode(checked).alias("locus", "allele")).withColumn("allele", clean_allele(F.col("allele")))


def read_fasta(spark: SparkSession, source: str) -> DataFrame:
    """The same of aligned sequences: a letter is a locus, the name is the header's first word."""
    if "\n" in source:
        records = spark.createDataFrame([(x,) for x in source.split(">")], "value string")
    else:
        records = spark.read.text(source, lineSep=">")
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\\n', 1)) + 1)"), r"\s", "")
    named = records.filter("trim(value) <> ''").select(clean_name(F.split(F.trim(head), r"\s+")[0]).alias("sample"), F.upper(body).alias("s"))
    return named.select("sample", F.posexplode(F.filter(F.split("s", ""), lambda c: c != "")).alias("locus", "allele"))


def read_metadata(spark: SparkSession, source: str, separator: str | None = None) -> DataFrame:
    """All columns as strings. Unless given, the separator is a comma if the header has one, else a tab; no quoting. Of rows with one key (``ID``, else the first column) the last wins."""
    rows = lines(spark, source)
    first = rows.filter("line <> ''").orderBy("ord").first()
    sep = separator or ("," if "," in first["line"] else "\t")
    names = first["line"].strip("\r\n").split(sep)
    key = "ID" if "ID" in names else names[0]
    cells = rows.filter((F.col("line") != "") & (F.col("ord") != first["ord"])).select("ord", F.split(F.regexp_replace("line", "\r$", ""), re.escape(sep)).alias("f"))
    table = cells.select("ord", *[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])
    last = F.max_by(F.struct(*names), "ord").alias("r")
    return table.groupBy(F.col(key).alias("_key")).agg(last).select("r.*")


def format_of(text: Column) -> Column:
    """``profile``, ``metadata`` or ``tree``, from the first line of the first 2048 letters."""
    first = F.substring_index(F.substring(text, 1, 2048), "\n", 1)
    tree = first.rlike(r"^[(\[ {]")
    return (
        F.when(first.startswith(">") | (first.startswith("#") & ~F.upper(first).startswith("#NEXUS")), "profile")
        .when((F.contains(first, F.lit(",")) | F.contains(first, F.lit("\t"))) & ~tree, "metadata")
        .otherwise("tree")
    )


def detect_format(text: str) -> str:
    """The same of one text at hand."""
    first = text[:2048].split("\n")[0]
    if first.startswith(">") or first.startswith("#") and not first.upper().startswith("#NEXUS"):
        return "profile"
    if ("," in first or "\t" in first) and not first.startswith(("(", "[", " ", "{")):
        return "metadata"
    return "tree"


def direct_url(url: str) -> str:
    """The address of the file itself, for links of shared folders and code hosts (nothing is fetched)."""
    url = unquote(url)
    if "dropbox.com" in url:
        return re.sub(r"([?&])dl=0", r"\1dl=1", url) if "dl=0" in url else url + ("&" if "?" in url else "?") + "dl=1"
    if m := re.search(r"drive\.google\.com/file/d/([^/?]+)", url):
        return f"https://drive.google.com/uc?export=download&id={m[1]}"
    if m := re.match(r"https?://github\.com/([^/]+/[^/]+)/blob/(.+)", url):
        return f"https://raw.githubusercontent.com/{m[1]}/{m[2]}"
    return url
