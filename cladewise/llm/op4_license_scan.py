"""License scans by diagonal voting, in DataFrame functions only.

All rolling word 3-gram hashes of a text join the positions of the templates'
3-grams (a broadcast bounded by the constant ``TEMPLATES``). The words behind a
hash are compared at once. Hits vote for an offset diagonal, word position minus
template position; each diagonal keeps bitmasks of the template's 3-grams that
voted, ``WIDE`` of them in each mask, so templates may have any length.
Neighbouring diagonals merge, and a span is verified by the template words that
its votes cover and by the template's marked words (a version, a variant of the
license), each of which must stand after the word before it. A base phrase's
place is a diagonal on which every 3-gram of the phrase voted. Names of one or two
words ("GPLv3", "MIT License") are looked up by hashes of one and two words, of
which only hits leave the row; each is a diagonal of its own.

Only hits and one row for each text are shuffled; rows repeated in different
partitions of the input stay apart, so that no task makes all copies of a row.
Defined results: null and empty texts have no words, no labels and score 0; each
input row gives one output row, repeated rows and null ids included; extra
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K = 3
#: Diagonals at most so far apart belong to one span.
NEAR = 2
#: 3-grams in one bitmask: two bits of a long are left for the words of its last one.
WIDE = 60
#: Words of a template that may be missing: one in FEW_OF for templates of fewer than LONG words, else one in MANY_OF.
LONG, FEW_OF, MANY_OF = 16, 8, 5
# The base phrases, which count only where they stand whole, and the further templates. A marked word (!) must stand after the word before it.
BASE: tuple[tuple[str, str], ...] = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
GNU = "public license as published by the free software foundation either version"
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    ("mit", "released under the mit license"),
    ("mit", "the mit license mit"),
    ("mit", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    (
        "apache-2",
        "licensed under the apache license version !2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("apache-2", "apache license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "bsd 3 clause"),
    ("bsd", "bsd 2 clause"),
    ("bsd", "3 clause bsd"),
    ("bsd", "2 clause bsd"),
    ("bsd", "new bsd license"),
    ("bsd", "simplified bsd license"),
    ("bsd", "bsd license"),
    ("gpl-1", "gnu general public license version 1"),
    ("gpl-1", "gnu gpl version 1"),
    ("gpl-3", "gplv3"),
    ("gpl-2", "gplv2"),
    ("lgpl", "lgplv2"),
    ("lgpl", "lgplv3"),
    ("agpl", "agplv3"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-3", "gnu general public license v3"),
    ("gpl-3", "gnu gpl version 3"),
    ("gpl-3", f"it under the terms of the gnu !general {GNU} !3 of the license"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-2", "gnu general public license v2"),
    ("gpl-2", "gnu gpl version 2"),
    ("gpl-2", f"it under the terms of the gnu !general {GNU} !2 of the license"),
    ("lgpl", "gnu lesser general public license"),
    ("lgpl", "gnu library general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla !public license"),
    ("mpl", "mozilla public license version 2"),
    ("mpl", "mozilla public license v 2 0"),
    ("mpl", "mozilla public license 2 0"),
    ("mpl", "mpl 2 0"),
    ("epl", "eclipse public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the !eclipse public license"),
    ("cc0", "cc0 1 0"),
    ("cc0", "cc0 public domain dedication"),
    ("cc0", "creative commons zero"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "this work is licensed under a creative commons attribution !4 0 international license"),
    ("cc-by", "creative commons attribution 4 0"),
    ("cc-by", "creative commons attribution 3 0"),
    ("cc-by", "cc by 4 0"),
    ("cc-by", "cc by 3 0"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-sa", "creative commons attribution share alike"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "creative commons attribution noderivatives"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "isc license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "zlib license"),
    ("boost", "boost software license version 1 0"),
    ("boost", "boost software license"),
    ("boost", "distributed under the boost software license version !1 0"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("artistic", "the artistic license 2 0"),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited"),
)
#: Identifiers after "SPDX-License-Identifier:".
SPDX: tuple[tuple[str, str], ...] = (
    ("mit", "MIT"), ("apache-2", "Apache-2.0"), ("bsd", "BSD-2-Clause"), ("bsd", "BSD-3-Clause"), ("gpl-2", "GPL-2.0"), ("gpl-3", "GPL-3.0"), ("lgpl", "LGPL-2.1"), ("lgpl", "LGPL-3.0"), ("agpl", "AGPL-3.0"), ("mpl", "MPL-2.0"),
    ("epl", "EPL-2.0"), ("cc0", "CC0-1.0"), ("cc-by", "CC-BY-4.0"), ("cc-by-sa", "CC-BY-SA-4.0"), ("cc-by-nd", "CC-BY-ND-4.0"), ("cc-by-nc", "CC-BY-NC-4.0"), ("isc", "ISC"), ("unlicense", "Unlicense"), ("zlib", "Zlib"), ("boost", "BSL-1.0"), ("wtfpl", "WTFPL"), ("artistic", "Artistic-2.0"),
    ("gpl-1", "GPL-1.0"), ("lgpl", "LGPL-2.0"), ("agpl", "AGPL-1.0"), ("apache-1", "Apache-1.0"), ("apache-1", "Apache-1.1"), ("bsd", "0BSD"), ("bsd", "BSD-4-Clause"), ("mpl", "MPL-1.0"), ("mpl", "MPL-1.1"), ("epl", "EPL-1.0"), ("artistic", "Artistic-1.0"), ("mit", "MIT-0"), ("mit", "X11"),
    *((f"cc-by{part}", f"CC-BY{part.upper()}-{version}") for part in ("", "-sa", "-nd", "-nc") for version in ("2.0", "2.5", "3.0")), ("cc-by-nc", "CC-BY-NC-SA-4.0"), ("cc-by-nc", "CC-BY-NC-ND-4.0"),
)
#: The hash of the row that each text has besides its 3-grams; a 3-gram with this hash joins it too, and the comparison of words drops that pair.
OWN = -1
#: A hit of a short name goes by its number among the names, times this, and its position.
PLACES = 1 << 40


def _templates() -> list[tuple[int, str, bool, list[str], list[int], int]]:
    """Number, label, base, words, marked words and the least words to cover of each template; those that aren't base also with the other spelling of licence."""
    spdx = [(label, "spdx license identifier " + " ".join(re.findall("[a-z0-9]+", name.lower()))) for label, name in SPDX]
    both = [(label, text) for label, one in (*TEMPLATES, *spdx) for text in sorted({one, re.sub(r"\blicense\b", "licence", one)})]
    rows = []
    for tid, (label, text, base) in enumerate([(*x, True) for x in BASE] + [(*x, False) for x in both]):
        marked = [i for i, w in enumerate(text.split()) if w.startswith("!")]
        words = text.replace("!", "").split()
        n = len(words)
        if base and n < K or 0 in marked:
            raise ValueError(f"a base phrase needs {K} words, and a template no mark on its first: {text}")
        rows.append((tid, label, base, words, marked, n if base else n - n // (FEW_OF if n < LONG else MANY_OF)))
    return rows


def _masks() -> int:
    """How many masks the longest template needs."""
    return -(-max(len(words) - K + 1 for _, _, _, words, _, _ in _templates()) // WIDE)


def _short(n: int) -> list[str]:
    """The distinct names of ``n`` words, fewer than K."""
    return sorted({" ".join(words) for _, _, _, words, _, _ in _templates() if len(words) == n})


def _array(kind: str, values: list) -> str:
    return f"cast(array({', '.join(repr(v) for v in values)}) as array<{kind}>)"


def _template_grams(spark: SparkSession) -> DataFrame:
    """``tid, tpos, t1, t2, t3, hash`` of each 3-gram (of a shorter name: of all of it, with nulls behind), and the row that joins each text's own."""
    values = ", ".join(f"({tid}, {_array('string', words)})" for tid, _, _, words, _, _ in _templates())
    grams = spark.sql(f"select tid, posexplode(transform(sequence(1, greatest(size(w) - {K - 1}, 1)), i -> slice(w, i, {K}))) as (tpos, g) from values {values} as t(tid, w)")
    grams = grams.select("tid", "tpos", *[F.get("g", i).alias(f"t{i + 1}") for i in range(K)])
    hashed = grams.withColumn("hash", F.when(F.col("t2").isNull(), F.xxhash64("t1")).when(F.col("t3").isNull(), F.xxhash64("t1", "t2")).otherwise(F.xxhash64("t1", "t2", "t3")))
    return hashed.union(spark.sql(f"select -1, 0, cast(null as string), cast(null as string), cast(null as string), {OWN}L"))


def _template_facts(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"({tid}, '{label}', {str(base).lower()}, {len(words)}, {least}, {_array('int', marked)})" for tid, label, base, words, marked, least in _templates())
    return spark.sql(f"select * from values {values} as t(tid, label, base, len, least, marked)")


def _short_hits(n: int) -> str:
    """SQL of an array: for each place of ``words`` with a name of ``n`` words, the name's number times PLACES, and the place (from 1)."""
    names = f"array({', '.join(f'xxhash64({", ".join(repr(w) for w in name.split())})' for name in _short(n))})"
    here = ", ".join(f"words[i - 1 + {k}]" for k in range(n))
    found = f"transform(sequence(1, size(words) - {n - 1}), i -> (array_position({names}, xxhash64({here})) - 1) * {PLACES}L + i)"
    return f"if(size(words) < {n}, array(), filter({found}, x -> x > 0))"


def _may_be_short() -> str:
    """SQL of whether a text holds the longest word of any short name: most texts hold none, and are looked at no further for these."""
    longest = {max(name.split(), key=len) for n in range(1, K) for name in _short(n)}
    return " or ".join(f"contains(_text, '{w}')" for w in sorted(longest) if not any(x in w for x in longest - {w}))


def _covered() -> Column:
    """Template words that the masks' 3-grams cover."""
    whole = (1 << WIDE) - 1
    words = f"(masks[j] | (masks[j] << 1) | (masks[j] << 2)) & {whole}L"
    over = f"if(j = 0, 0L, ((masks[j - 1] << 1) | (masks[j - 1] << 2)) >>> {WIDE})"
    return F.expr(f"aggregate(sequence(0, size(masks)), 0, (n, j) -> n + if(j < size(masks), cast(bit_count(({words}) | ({over})) as int), cast(bit_count({over}) as int)))")


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Merged diagonals: ``doc_id, digest, part, tid, label, base, len, first_diagonal, last_diagonal, covered`` (template words covered), ``found`` (verified), and, for the row of null ``label`` that each distinct text of a partition has, ``n_words`` and ``copies`` (its repeated rows)."""
    # U+212A and U+0130 are the characters whose lower case holds a letter of a-z.
    text = F.lower(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\u212a\u0130", "éé"))
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("digest"), F.spark_partition_id().alias("part"), text.alias("_text"))
    rows = rows.select("doc_id", "digest", "part", F.expr(r"filter(split(_text, r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), w -> w <> '')").alias("words"), F.expr(_may_be_short()).alias("named"))
    grams = f"if(size(words) < {K}, array(), transform(slice(words, 1, greatest(size(words) - {K - 1}, 0)), (w, i) -> xxhash64(w, words[i + 1], words[i + 2])))"
    # Behind the 3-grams come the hits of two words, then those of one, known by the signs of their numbers.
    every = f"concat(array({OWN}L), {grams}, if(named, concat({_short_hits(2)}, transform({_short_hits(1)}, x -> -x)), array()))"
    rows = rows.select("doc_id", "digest", "part", "words", F.size("words").alias("n_words"), F.expr(every).alias("grams"))
    # _outer: the filter that an inner explode brings would be pushed below and split each text once for each 3-gram.
    rows = rows.select("doc_id", "digest", "part", "words", "n_words", F.posexplode_outer("grams").alias("pos", "hash"))
    short = f"pos > greatest(n_words - {K - 1}, 0)"
    rows = rows.withColumns({"pos": F.expr(f"if({short}, cast(abs(hash) % {PLACES} as int), pos)"), "hash": F.expr(f"if({short}, if(hash > 0, xxhash64(words[cast(hash % {PLACES} as int) - 1], get(words, cast(hash % {PLACES} as int))), xxhash64(words[cast(-hash % {PLACES} as int) - 1])), hash)"), "size": F.expr(f"if({short}, if(hash > 0, 2, 1), {K})")})
    same = "words[pos - 1] = t1 and if(size > 1, words[pos] = t2, t2 is null) and if(size > 2, words[pos + 1] = t3, t3 is null)"
    hits = rows.join(F.broadcast(_template_grams(df.sparkSession)), "hash").filter(f"if(pos = 0, tid = -1, {same})")
    key = ["doc_id", "digest", "part"]
    masks = [f"m{j}" for j in range(_masks())]
    voted = [F.expr(f"bit_or(if(tpos div {WIDE} = {j}, shiftleft(1L, cast(tpos % {WIDE} as int)), 0L))").alias(m) for j, m in enumerate(masks)]
    diagonals = hits.groupBy(*key, "tid", F.expr("pos - 1 - tpos").alias("diagonal")).agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"), *voted)
    order = f"partition by {', '.join(key)}, tid order by diagonal"
    # A base phrase's diagonals stay apart: each is a place of its own.
    new = F.expr(f"if(tid < {len(BASE)} or coalesce(diagonal - lag(diagonal) over ({order}) > {NEAR}, true), 1, 0)")
    marked = diagonals.withColumn("new", new).withColumn("cluster", F.expr(f"sum(new) over ({order})"))
    merged = marked.groupBy(*key, "tid", "cluster").agg(
        F.min("diagonal").cast("long").alias("first_diagonal"), F.max("diagonal").cast("long").alias("last_diagonal"), F.max("n_words").cast("long").alias("n_words"), F.max("copies").alias("copies"), *[F.bit_or(m).alias(m) for m in masks]
    )
    out = merged.withColumn("masks", F.array(*masks)).drop(*masks, "cluster").join(F.broadcast(_template_facts(df.sparkSession)), "tid", "left")
    after = f"forall(marked, i -> exists(array(i - 2, i - 1), g -> g >= 0 and g div {WIDE} < size(masks) and (shiftright(masks[cast(g div {WIDE} as int)], cast(g % {WIDE} as int)) & 1) = 1))"
    return out.withColumn("covered", F.least(_covered(), F.coalesce("len", F.lit(0)))).withColumn("found", F.expr(f"label is not null and covered >= least and {after}")).drop("masks", "marked", "least")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: words, base places, labels and the best coverage."""
    place = F.expr("base and found")
    joined = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    out = spans(df, id_col, text_col).groupBy("doc_id", "digest", "part").agg(
        F.max("n_words").alias("n_words"), F.count(F.when(place, 1)).alias("n_base"), F.min(F.when(place, F.col("first_diagonal"))).alias("first_word"), F.max(F.when(place, F.col("first_diagonal"))).alias("last_word"),
        joined(place).alias("base_labels"), joined(F.col("found")).alias("labels"), F.max(F.expr("if(label is null, 0D, covered / len)")).alias("score"), F.max(F.expr("if(label is null, copies, 0)")).alias("copies"),
    )
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copy")


def _oracle() -> str:
    facts = ",\n  ".join(f"({tid}, '{label}', {str(base).lower()}, {least}, CAST({marked} AS INT[]), '{' '.join(words)}')" for tid, label, base, words, marked, least in _templates())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM d WHERE len(ws) >= 3), o AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS p FROM d WHERE len(ws) >= 1),
f(tid, label, base, least, marked, phrase) AS (VALUES {facts}),
v AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
u AS (SELECT tid, w, unnest(range(0, len(w) - 2)) AS tpos FROM v WHERE len(w) >= 3),
t AS (SELECT tid, tpos, w[tpos+1] || ' ' || w[tpos+2] || ' ' || w[tpos+3] AS s FROM u),
h AS (SELECT rid, tid, tpos, p - 1 - tpos AS diag FROM g JOIN t ON t.s = ws[p] || ' ' || ws[p+1] || ' ' || ws[p+2] UNION ALL SELECT rid, tid, 0, p - 1 FROM o JOIN v ON phrase = ws[p] WHERE len(w) = 1 UNION ALL SELECT rid, tid, 0, p - 1 FROM o JOIN v ON phrase = ws[p] || ' ' || ws[p+1] WHERE len(w) = 2),
c AS (SELECT *, CASE WHEN tid < {len(BASE)} THEN diag ELSE sum(new) OVER (PARTITION BY rid, tid ORDER BY diag RANGE UNBOUNDED PRECEDING) END AS cluster FROM
  (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY rid, tid ORDER BY diag, tpos) <= {NEAR} THEN 0 ELSE 1 END AS new FROM h)),
k AS (SELECT rid, tid, min(diag) AS diag, list(DISTINCT tpos) AS gs, count(DISTINCT tpos + o) AS cov
  FROM c CROSS JOIN (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid, tid, cluster),
s AS (SELECT rid, label, base, diag, least(cov, len(w)) AS cov, len(w) AS n, cov >= least AND len(list_filter(marked, lambda i: list_contains(gs, i - 1) OR list_contains(gs, i - 2))) = len(marked) AS found FROM k JOIN v USING (tid)),
a AS (SELECT rid, count(*) FILTER (base AND found) AS n_base, min(diag) FILTER (base AND found) AS first_word, max(diag) FILTER (base AND found) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (base AND found))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list(label) FILTER (found))), ',') AS labels,
  max(CAST(cov AS DOUBLE) / n) AS score FROM s GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN a ON a.rid = d.rid
"""


OP4_SQL = _oracle()
