"""License scan by diagonal voting, in DataFrame operations only.

All texts are cut into lower-case words; every word starts a rolling bigram and trigram. Their
hashes are joined to those of the license templates (a fixed list, so the broadcast has a fixed
size), and the words themselves must agree. A hit votes for a diagonal: its place in the text less
its place in the template. Short phrases (bigrams) count where a diagonal has every vote, which is
where the phrase stands word by word. Longer notices (trigrams) may differ by some words: their
neighbouring diagonals, at most GAP apart, are merged, and a merged span counts if it has at least
COVER of the template's votes and is not longer than STRETCH times the template.

Hits are few beside the words; only they and one row for each text are shuffled, by row. Nothing
is collected. Null and empty texts have no words and no labels (empty strings), null places and
score 0. Rows with the same id are scanned each for itself, and other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP, COVER, STRETCH = 3, 0.6, 1.5

#: Phrases of the contract, with their labels.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

#: Opening sentences of public licenses and their usual notices, with their labels.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(i, label, text, 2) for i, (label, text) in enumerate(PHRASES)] + [(len(PHRASES) + i, label, text, 3) for i, (label, text) in enumerate(NOTICES)]
    values = ", ".join(f"({i}, '{label}', '{text}', {k})" for i, label, text, k in rows)
    return spark.sql(f"SELECT t, label, split(body, ' ') AS w, k, size(split(body, ' ')) AS n FROM VALUES {values} AS v(t, label, body, k)")


def _positions(templates: DataFrame, k: int) -> DataFrame:
    """Each k-gram of the templates with its hash and all places where it stands."""
    w = templates.where(F.col("k") == k).select("t", "label", "n", F.posexplode(F.arrays_zip("w", F.slice("w", 2, F.col("n")), F.slice("w", 3, F.col("n")))).alias("p", "g"))
    w = w.select("t", "label", "n", "p", F.col("g.w").alias("x1"), F.col("g.1").alias("x2"), F.col("g.2").alias("x3")).where(F.col("p") <= F.col("n") - k)
    words = [f"x{i + 1}" for i in range(k)]
    return w.groupBy(F.xxhash64(*words).alias(f"h{k}"), *[F.col(x).alias(f"{x}_{k}") for x in words]).agg(F.collect_list(F.struct("t", "label", "n", "p", F.lit(k).alias("k"))).alias(f"hit{k}"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: id, n_words, and spans (array of label, start, end, score, phrase), of phrases and
    merged diagonals that hold; start and end are words from 0.
    """
    spark = docs.sparkSession
    templates = _templates(spark)
    words = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.array_remove(F.split(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER), SPLIT), "").alias("w"))
    zipped = words.select("id", "row", F.size("w").cast("bigint").alias("n_words"), F.arrays_zip("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), F.slice("w", 3, F.greatest(F.size("w"), F.lit(1)))).alias("z"))
    each = zipped.select("id", "row", "n_words", F.posexplode_outer("z").alias("at", "g"))
    each = each.select("id", "row", "n_words", "at", F.col("g.w").alias("w1"), F.col("g.1").alias("w2"), F.col("g.2").alias("w3"))
    each = each.withColumns({"g2": F.xxhash64("w1", "w2"), "g3": F.xxhash64("w1", "w2", "w3")})
    two, three = F.broadcast(_positions(templates, 2)), F.broadcast(_positions(templates, 3))
    hits = each.join(two, (F.col("g2") == F.col("h2")) & (F.col("w1") == F.col("x1_2")) & (F.col("w2") == F.col("x2_2")), "left")
    hits = hits.join(three, (F.col("g3") == F.col("h3")) & (F.col("w1") == F.col("x1_3")) & (F.col("w2") == F.col("x2_3")) & (F.col("w3") == F.col("x3_3")), "left")
    # One row stays of each text, found or not.
    hits = hits.where(F.col("hit2").isNotNull() | F.col("hit3").isNotNull() | F.col("at").isNull() | (F.col("at") == 0))
    none = F.array().cast("array<struct<t: int, label: string, n: int, p: int, k: int>>")
    hits = hits.select("id", "row", "n_words", "at", F.explode_outer(F.concat(F.coalesce("hit2", none), F.coalesce("hit3", none))).alias("m"))
    hits = hits.select("id", "row", "n_words", "at", "m.*").withColumn("diagonal", F.col("at") - F.col("p"))
    # By row from here on: the rest needs no other exchange.
    votes = hits.repartition("row").groupBy("row", "id", "n_words", "t", "label", "n", "k", "diagonal").agg(F.count("p").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"))
    by_template = Window.partitionBy("row", "t").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_template) > GAP, F.lit(True)) | (F.col("k") == 2)
    merged = votes.withColumn("new", apart.cast("int")).withColumn("band", F.sum("new").over(by_template.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("row", "id", "n_words", "t", "label", "n", "k", "band").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"))
    cover = F.least(F.col("votes") / (F.col("n") - F.col("k") + 1), F.lit(1.0))
    span = F.col("high") + F.col("k") - F.col("low")
    holds = F.when(F.col("k") == 2, F.col("votes") == F.col("n") - 1).otherwise((cover >= COVER) & (span <= STRETCH * F.col("n")))
    found = F.when(holds, F.struct("label", F.col("low").cast("bigint").alias("start"), (F.col("high") + F.col("k")).cast("bigint").alias("end"), cover.alias("score"), (F.col("k") == 2).alias("phrase")))
    return merged.groupBy("row", "id", "n_words").agg(F.collect_list(found).alias("spans")).select(F.col("id").alias(id_col), "n_words", F.array_sort("spans").alias("spans"))


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda s: s["phrase"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return df.select(
        id_col,
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)), 6).alias("score"),
    )


def sql() -> str:
    """The same digest in DuckDB's SQL."""
    values = ", ".join(f"({i}, '{label}', '{text}', {k})" for i, (label, text, k) in enumerate([(*p, 2) for p in PHRASES] + [(*p, 3) for p in NOTICES]))
    return rf"""
WITH tpl AS (SELECT t, label, string_split(body, ' ') AS w, k, len(string_split(body, ' ')) AS n FROM (VALUES {values}) v(t, label, body, k)),
pos AS (SELECT t, label, n, k, p - 1 AS p, w[p] AS x1, w[p + 1] AS x2, CASE WHEN k = 3 THEN w[p + 2] END AS x3 FROM tpl, LATERAL (SELECT unnest(range(1, n - k + 2)) AS p)),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT r, i - 1 AS place, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM doc, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
vote AS (SELECT r, t, label, n, k, place - p AS diagonal, count(*) AS votes, min(place) AS low, max(place) AS high FROM word JOIN pos ON w1 = x1 AND w2 = x2 AND (k = 2 OR w3 = x3) GROUP BY ALL),
cut AS (SELECT *, CASE WHEN k = 2 THEN 1 WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS new FROM vote),
band AS (SELECT *, sum(new) OVER (PARTITION BY r, t ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS b FROM cut),
merged AS (SELECT r, t, label, n, k, b, sum(votes)::BIGINT AS votes, min(low) AS low, max(high) AS high FROM band GROUP BY ALL),
span AS (SELECT r, label, k = 2 AS phrase, low AS first, least(votes::DOUBLE / (n - k + 1), 1.0) AS score FROM merged
  WHERE CASE WHEN k = 2 THEN votes = n - 1 ELSE votes::DOUBLE / (n - k + 1) >= {COVER} AND high + k - low <= {STRETCH} * n END),
per AS (SELECT r, count(*) FILTER (phrase) AS n_base, min(first) FILTER (phrase) AS first_word, max(first) FILTER (phrase) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM span GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM doc LEFT JOIN per USING (r)
"""
