"""Quality rules as a bitmask ledger, in DataFrame functions only.

``measure`` computes each measurement of a text once. ``ledger`` evaluates every
rule once on the measurements and stores one failure bit for each rule.
``apply_policy`` keeps the rows in which no bit of a versioned policy is set, and
``ablations`` counts from the bits alone, so that neither reads a text again.

Defined results: a null or empty text has no words and fails ``few_words``. Each
input row gives one output row, repeated rows included; nulls in other columns
and extra columns have no effect. All work is within a row, so no group of rows
meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.names import packed

#: Bit, name and failure test of each rule. Bits keep their meaning for ever; new rules take new bits.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "100 * n_symbols > 40 * n_words"),
    (3, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    (4, "short_words", "10 * word_chars < 15 * n_words"),
    (5, "long_words", "word_chars > 20 * n_words"),
    (6, "shouting", "100 * n_bangs > 50 * n_words"),
)
#: The bits a policy looks at, by version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "shouting"),
}
WHITE = r"[\x20\x09-\x0D]"


def policy_mask(policy: str) -> int:
    """The bits of a policy as a number."""
    return sum(1 << bit for bit, name, _ in RULES if name in POLICIES[policy])


def _repeat_words(words: str) -> Column:
    """Words in 3-word windows that occur twice or more: sort the windows' hashes, keep those equal to a neighbour, and add up what each of the kept positions newly covers."""
    hashed = f"if(size({words}) < 3, array(), transform(slice({words}, 1, greatest(size({words}) - 2, 0)), (w, i) -> struct(xxhash64(w, {words}[i + 1], {words}[i + 2]) as h, i as i)))"
    return F.expr(f"sort_array({hashed})")


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """One row for each row of ``df``: the id and the measurements of its text, and with ``whole_rows`` the row itself as the struct ``row``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = ["row"] if whole_rows else []
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("_text"), *[packed(df).alias(x) for x in row])
    rows = rows.select(
        "doc_id",
        *row,
        "_text",
        F.expr(rf"filter(split(_text, r'{WHITE}+'), w -> w <> '')").alias("_words"),
        F.expr(r"filter(split(_text, r'\n'), l -> l rlike r'[^\x20\x09-\x0D]')").alias("_lines"),
    )
    rows = rows.select("doc_id", *row, "_text", "_words", "_lines", _repeat_words("_words").alias("_sorted"))
    rows = rows.withColumn("_again", F.expr("sort_array(transform(filter(_sorted, (e, j) -> coalesce(e.h = get(_sorted, j - 1).h, false) or coalesce(e.h = get(_sorted, j + 1).h, false)), e -> e.i))"))
    return rows.select(
        "doc_id",
        *row,
        # Adds 0. A filter on the results isn't moved below a projection that isn't deterministic; there it would compute the arrays anew for each of their elements.
        (F.size("_words") + F.when(F.monotonically_increasing_id() < 0, 1).otherwise(0)).cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", rf"{WHITE}+", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)").alias("n_dup_lines"),
        F.expr("aggregate(_again, struct(-3 as last, 0L as n), (a, x) -> struct(x as last, a.n + least(3, x - a.last) as n), a -> a.n)").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("!!"), F.lit("!")))).cast("long").alias("n_bangs"),
    )


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """The measurements and ``fail_bits``: bit b is set where the rule of bit b fails."""
    bits = " | ".join(f"if({test}, {1 << bit}, 0)" for bit, _, test in RULES)
    return measure(df, id_col, text_col, whole_rows).withColumn("fail_bits", F.expr(bits).cast("long"))


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """A ledger with ``kept``: no rule of the policy fails."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0)


def keep_rows(df: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that a policy keeps, with their own columns."""
    return apply_policy(ledger(df, id_col, text_col, whole_rows=True), policy).filter("kept").select("row.*")


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: rows it fails, rows it alone fails, and rows kept without it.

    The ledger is first counted by its bits, so at most 2^rules rows remain for
    the bitwise sums. An empty ledger gives a row of zeros for each rule.
    """
    mask = policy_mask(policy)
    counts = rows.groupBy((F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))).alias("b")).agg(F.count("*").alias("n"))
    sums = []
    for bit, name, _ in RULES:
        if name in POLICIES[policy]:
            one = 1 << bit
            sums.append(
                F.struct(
                    F.lit(name).alias("rule"),
                    F.coalesce(F.expr(f"sum(if((b & {one}) <> 0, n, 0))"), F.lit(0)).alias("n_failed"),
                    F.coalesce(F.expr(f"sum(if(b = {one}, n, 0))"), F.lit(0)).alias("n_only"),
                    F.coalesce(F.expr(f"sum(if((b & ~{one}L) = 0, n, 0))"), F.lit(0)).alias("n_kept_without"),
                )
            )
    return counts.agg(F.array(*sums).alias("a")).select(F.inline("a"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policy v1; ``kept`` is false wherever a base rule fails."""
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("fail_bits").bitwiseAND(F.lit(policy_mask("base")).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "n_bangs", "fail_bits")


#: Independent of the Spark form: windows are unnested and counted as strings.
OP9_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text,
        list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
k AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS s FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM k) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT i + o) AS n FROM r CROSS JOIN (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(length(text) - length(replace(text, '!!', '!')) AS BIGINT) AS n_bangs
      FROM w LEFT JOIN c ON c.rid = w.rid),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * n_symbols > 40 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN 10 * word_chars < 15 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
        + (CASE WHEN 100 * n_bangs > 50 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  fail_bits = 0 AS kept, n_lines, n_bangs, fail_bits FROM f
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 fails, alone fails, and would keep if it were left out, over all documents."""
    return ablations(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _ablations_sql() -> str:
    mask = policy_mask("v1")
    each = [
        f"SELECT '{name}' AS rule, CAST(count(*) FILTER (b & {1 << bit} <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (b = {1 << bit}) AS BIGINT) AS n_only, CAST(count(*) FILTER (b & {mask & ~(1 << bit)} = 0) AS BIGINT) AS n_kept_without FROM b"
        for bit, name, _ in RULES
        if name in POLICIES["v1"]
    ]
    return f"WITH led AS ({OP9_SQL}), b AS (SELECT fail_bits & {mask} AS b FROM led)\n" + "\nUNION ALL ".join(each)


ABLATIONS_SQL = _ablations_sql()
