"""License scans by diagonal voting, in SQL expressions only.

Every run of ``k`` words of a text is hashed and joined with the positions of the same run in templates of license
texts (a fixed list, so the broadcast side is bounded). A hit lies on the diagonal text position minus template
position; a copied passage puts its hits on one diagonal, and a word more or less moves the rest to a neighbouring one.
So hits are counted by diagonal, diagonals up to ``GAP`` apart are merged, and a merged span is verified: its runs have
been compared word by word, together they must cover ``COVER`` of the template, and their diagonals may drift by ``DRIFT`` of
its length at most: words in another order, or far apart, lie on diagonals far from each other.

Defined results: null counts as empty; a text without words has no labels and score 0; texts of any length are taken
whole; repeated rows (equal key and text) get equal results, one each; a null key is a key of its own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, GAP, COVER, DRIFT = 4, 2, 0.6, 0.25

# Phrases and labels of the base rule.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Openings and whole texts of public licenses, lower case, words parted by single blanks.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    (
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the software the "
        "software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the "
        "authors or copyright holders be liable for any claim damages or other liability whether in an action of "
        "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings "
        "in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the software "
        "is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct "
        "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether "
        "in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list "
        "of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software permission is granted to anyone to use this "
        "software for any purpose including commercial applications and to alter it and redistribute it freely subject "
        "to the following restrictions",
    ),
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _BREAK), "")


def _runs(words: str, at: str) -> list[Column]:
    return [F.expr(f"{words}[{at} + {i}]") for i in range(K)]


def _starts(words: str) -> Column:
    return F.expr(f"CASE WHEN size({words}) >= {K} THEN sequence(0, size({words}) - {K}) END")


def templates(spark: SparkSession) -> DataFrame:
    """One row for each run of a template: label, template, length, position, words and hash."""
    rows = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(TEMPLATES))
    listed = spark.sql(f"SELECT template, label, split(text, ' ') AS t_words FROM VALUES {rows} t(template, label, text)")
    placed = listed.select("template", "label", "t_words", F.explode(_starts("t_words")).alias("t_at"))
    runs = _runs("t_words", "t_at")
    return placed.select(
        "template",
        "label",
        F.size("t_words").alias("t_len"),
        "t_at",
        F.xxhash64(*runs).alias("run_hash"),
        *[w.alias(f"t_{i}") for i, w in enumerate(runs)],
    )


def hits(docs: DataFrame) -> DataFrame:
    """Places where a run of a text is a run of a template; docs: key, same, words."""
    placed = docs.select("key", "same", "words", F.explode(_starts("words")).alias("d_at"))
    runs = _runs("words", "d_at")
    hashed = placed.select(
        "key", "same", "d_at", F.xxhash64(*runs).alias("run_hash"), *[w.alias(f"d_{i}") for i, w in enumerate(runs)]
    )
    equal = F.expr(" AND ".join(["d.run_hash = t.run_hash", *(f"d_{i} = t_{i}" for i in range(K))]))
    table = templates(docs.sparkSession).alias("t")
    return (
        hashed.alias("d")
        .join(F.broadcast(table), equal)
        .select("key", "same", "template", "label", "t_len", "t_at", (F.col("d_at") - F.col("t_at")).alias("diagonal"))
    )


def spans(found: DataFrame) -> DataFrame:
    """Verified spans: key, same, label, cover."""
    of = ["key", "same", "template", "label", "t_len"]
    votes = found.groupBy(*of, "diagonal").agg(F.collect_set("t_at").alias("votes"))  # at most the template's length
    order = Window.partitionBy("key", "same", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(True))
    merged = (
        votes.withColumn("fresh", fresh.cast("int"))
        .withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*of, "span")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("votes"))).alias("votes"),
            (F.max("diagonal") - F.min("diagonal")).alias("drift"),
        )
        .filter(F.col("drift") <= F.greatest(F.lit(GAP), F.floor(F.col("t_len") * F.lit(DRIFT))))
    )
    covered = F.expr(f"size(array_distinct(flatten(transform(votes, p -> sequence(p, p + {K - 1})))))")
    return merged.select("key", "same", "label", (covered / F.col("t_len")).alias("cover")).filter(F.col("cover") >= COVER)


def _places(phrase: str) -> Column:
    """Starts of a phrase; looked for only where the text holds its words."""
    parts = phrase.split()
    last = f"size(words) - {len(parts)}"
    guard = " AND ".join([f"size(words) >= {len(parts)}", *(f"array_contains(words, '{p}')" for p in parts)])
    test = " AND ".join(f"words[i + {n}] = '{p}'" for n, p in enumerate(parts))
    return F.expr(f"CASE WHEN {guard} THEN filter(sequence(0, {last}), i -> {test}) ELSE array() END").cast("array<int>")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    worded = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("same"), _words(F.col(text)).alias("words"))
    places = [f"p{n}" for n in range(len(PHRASES))]
    based = worded.select("key", "same", "words", *[_places(p).alias(c) for c, (p, _) in zip(places, PHRASES)])
    every = F.concat(*places)
    base = based.select(
        "key",
        "same",
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(c) > 0, label) for c, (_, label) in zip(places, PHRASES)])).alias("base"),
    )
    voted = (
        spans(hits(worded))
        .groupBy("key", "same")
        .agg(F.collect_set("label").alias("voted"), F.max("cover").alias("cover"))
        .withColumnsRenamed({"key": "v_key", "same": "v_same"})
    )
    joined = base.join(voted, F.expr("key <=> v_key AND same = v_same"), "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("voted", none)))
    return joined.select(
        F.col("key").alias(key),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", F.array_sort("base")).alias("base_labels"),
        F.concat_ws(",", labels).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL: the runs are joined as words, not as hashes."""
    rows = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(TEMPLATES))
    run = lambda words, at: f"list_slice({words}, {at} + 1, {at} + {K})"
    tests = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        listed = "[" + ", ".join(f"'{p}'" for p in parts) + "]"
        tests.append(f"SELECT doc_id, i, '{label}' AS label FROM places WHERE list_slice(w, i + 1, i + {len(parts)}) = {listed}")
    return f"""
WITH words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
    '{_BREAK}'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM words),
base AS ({" UNION ALL ".join(tests)}),
per_base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
    list_distinct(list(label)) AS base FROM base GROUP BY doc_id),
t AS (SELECT template, label, string_split(text, ' ') AS tw FROM (VALUES {rows}) v(template, label, text)),
t_runs AS (SELECT template, label, len(tw) AS t_len, unnest(range(0, len(tw) - {K - 1})) AS t_at, tw FROM t),
hits AS (SELECT DISTINCT doc_id, template, label, t_len, t_at, i - t_at AS diagonal FROM places
    JOIN t_runs ON {run('w', 'i')} = {run('tw', 't_at')} WHERE i + {K} <= len(w)),
diagonals AS (SELECT DISTINCT doc_id, template, diagonal FROM hits),
lagged AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER o > {GAP}, true)::INTEGER AS fresh FROM diagonals
    WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
merged AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal
    ROWS UNBOUNDED PRECEDING) AS span FROM lagged),
drifts AS (SELECT doc_id, template, span, max(diagonal) - min(diagonal) AS drift FROM merged GROUP BY ALL),
covered AS (SELECT DISTINCT doc_id, template, label, t_len, span, t_at + unnest(range(0, {K})) AS p
    FROM hits JOIN merged USING (doc_id, template, diagonal) JOIN drifts USING (doc_id, template, span)
    WHERE drift <= greatest({GAP}, floor(t_len * {DRIFT}))),
spans AS (SELECT doc_id, label, count(*) / t_len AS cover FROM covered GROUP BY doc_id, template, label, t_len, span),
voted AS (SELECT doc_id, list_distinct(list(label)) AS voted, max(cover) AS cover FROM spans WHERE cover >= {COVER}
    GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(voted, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(cover, 0.0)::DOUBLE END AS score
FROM words LEFT JOIN per_base USING (doc_id) LEFT JOIN voted USING (doc_id)"""
