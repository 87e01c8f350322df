"""License scans by diagonal voting.

All rolling k-word hashes of a text are joined to the positions of the same hashes in templates of
licence notices.  Matches of one template vote for their diagonal (position in the text minus
position in the template); each diagonal merges with its neighbours, so that inserted or lost words do
not split a notice; a span whose words cover enough of the template names its licence.  Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import ascii_lower

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # after lower-casing A-Z
K = 3
# Phrases that name a licence wherever they stand.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Words of licence notices, lower-cased.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("all-rights-reserved", "all rights reserved"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law has waived all copyright and related or neighboring rights to"),
)


def words_of(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def template_grams(spark: SparkSession, templates: tuple = TEMPLATES, k: int = K) -> DataFrame:
    """h, template, label, grams (of the template), p: one row for each k-gram of each template.

    Its size is that of the templates, whatever the documents.
    """
    rows = [(i, label, text.split(" ")) for i, (label, text) in enumerate(templates)]
    df = spark.createDataFrame(rows, "template int, label string, w array<string>")
    return df.select("template", "label", (F.size("w") - (k - 1)).alias("grams"), F.posexplode(grams(F.col("w"), k)).alias("p", "h"))


def grams(w: Column, k: int) -> Column:
    """Hashes of all runs of k words."""
    at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def spans(docs: DataFrame, templates: tuple = TEMPLATES, k: int = K, drift: int = 3, least: float = 0.75) -> DataFrame:
    """Verified spans: doc_id, sig, template, label, first_word, last_word, coverage.

    A diagonal merges with those at most `drift` away.  Of each k-gram of the template, the hit on the
    nearest diagonal counts, so a span is never longer than the template and twice the drift.  coverage
    is the share of the template's k-grams that are found; a span counts from `least` on, if none of the
    merged diagonals gives a better one.  A text may repeat a notice any number of times, also without
    a word between: each diagonal is judged on its own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("sig"), words_of(text).alias("w"))
    rows = rows.select("doc_id", "sig", F.posexplode(grams(F.col("w"), k)).alias("q", "h"))
    hits = rows.join(F.broadcast(template_grams(docs.sparkSession, templates, k)), "h")
    by = ["doc_id", "sig", "template", "label", "grams"]
    diagonal = hits.groupBy(*by, (F.col("q") - F.col("p")).alias("d")).agg(F.collect_set("p").alias("ps"))
    around = W.partitionBy("doc_id", "sig", "template").orderBy("d").rangeBetween(-drift, drift)
    # 2 * drift + 1 diagonals of at most `grams` places each
    diagonal = diagonal.withColumn("near", F.collect_list(F.struct("d", "ps")).over(around))
    nearest = F.array_sort(F.transform("near", lambda x: F.struct(F.abs(x["d"] - F.col("d")).alias("off"), x["d"].alias("d"), x["ps"].alias("ps"))))
    start = F.struct(F.array().cast("array<int>").alias("seen"), F.lit(1 << 30).alias("lo"), F.lit(-1).alias("hi"))

    def add(s: Column, x: Column) -> Column:
        new = F.array_except(x["ps"], s["seen"])
        lo, hi = F.least(s["lo"], x["d"] + F.array_min(new)), F.greatest(s["hi"], x["d"] + F.array_max(new))
        return F.struct(F.concat(s["seen"], new).alias("seen"), lo.alias("lo"), hi.alias("hi"))

    span = diagonal.withColumn("s", F.aggregate(nearest, start, add)).drop("near", "ps")
    span = span.withColumn("coverage", F.size("s.seen") / F.col("grams")).where(F.col("coverage") >= least)
    span = span.withColumn("best", F.max("coverage").over(around)).where("coverage = best")
    last = F.col("s.hi") + (k - 1)
    return span.select("doc_id", "sig", "template", "label", F.col("s.lo").alias("first_word"), last.alias("last_word"), "coverage").distinct()


def stands(part: list[str]):  # noqa: ANN201
    """Whether the words of a phrase stand from word i on, as a function of i."""

    def fits(i: Column) -> Column:
        out = F.get("w", i) == part[0]
        for j, word in enumerate(part[1:], 1):
            out &= F.get("w", i + j) == word
        return out

    return fits


def scan(docs: DataFrame, templates: tuple = TEMPLATES, k: int = K, drift: int = 3, least: float = 0.75) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    A null or empty text has no words and no labels.  score is 1 where a base phrase stands, else the
    best coverage of a verified span, else 0.  Equal rows have equal results; an empty table gives
    an empty result.  Extra columns are ignored.
    """
    found = spans(docs, templates, k, drift, least).groupBy(F.col("doc_id").alias("_d"), F.col("sig").alias("_s"))
    found = found.agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("sig"), words_of(text).alias("w"))
    flat = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    rows = rows.withColumn("flat", flat)
    places = []
    for phrase, _ in PHRASES:
        part = phrase.split(" ")
        at = F.sequence(F.lit(0), F.size("w") - len(part))
        here = F.filter(at, stands(part))
        places.append(F.when(F.contains("flat", F.lit(f" {phrase} ")), here).otherwise(F.array().cast("array<int>")))
    rows = rows.select("doc_id", "sig", F.size("w").cast("long").alias("n_words"), *[p.alias(f"b{i}") for i, p in enumerate(places)])
    cols = [f"b{i}" for i in range(len(PHRASES))]
    every = F.concat(*cols)
    base = F.concat(*[F.when(F.size(c) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for c, (_, label) in zip(cols, PHRASES, strict=True)])
    rows = rows.select("doc_id", "sig", "n_words", every.alias("every"), F.array_sort(F.array_distinct(base)).alias("base"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["_d"]) & (rows["sig"] == found["_s"]), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id",
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
