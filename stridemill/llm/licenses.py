"""License scans by diagonal voting over word k-grams."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stage

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3          # words of a gram; phrases of two words use both
SLACK = 3         # diagonals this near belong to one copy with words put in or left out
COVER = 0.5       # share of a template's grams that a verified span holds
VOTES = 3         # and the least number of them, unless all are there

# Phrases that count wherever they stand.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

# Sentences of common license notices.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def template_grams(phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]) -> list[tuple]:
    """(template, label, is a phrase, grams in all, place, gram) for every template's grams."""
    rows = []
    for number, (label, text) in enumerate([*phrases, *notices]):
        words = [w for w in re.split(GAP, text.lower()) if w]
        k = min(GRAM, len(words)) if number >= len(phrases) else len(words)
        grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
        rows += [(number, label, number < len(phrases), len(grams), i, g) for i, g in enumerate(grams)]
    return rows


def scan(frame: DataFrame, text: str, phrases: Sequence[tuple[str, str]] = PHRASES,
         notices: Sequence[tuple[str, str]] = NOTICES) -> tuple[DataFrame, DataFrame]:
    """Find templates in texts.

    Returns the scanned rows (``at``, ``row`` with the other columns, ``n_words``) and the
    verified spans (``at``, ``template``, ``label``, ``phrase``, ``first_word``, ``last_word``,
    ``cover``), joined by ``at``.

    All rolling grams of a text are hashed, joined to the template positions of equal hash
    and verified on their words.  A hit at word i and place p votes for the diagonal i - p of
    its template; votes are summed by diagonal, neighbouring diagonals merge, and a span is
    accepted if it holds enough of the template and no overlapping notice fits better.  A phrase needs all its words on one
    diagonal.  The template table is fixed, so it is sent to every task, and grams whose hash
    is in no template don't leave their row.

    Null counts as empty; empty texts have no words and no spans; texts are scanned whole.
    An empty table gives empty results.
    """
    spark = frame.sparkSession
    grams = template_grams(phrases, notices)
    templates = (spark.createDataFrame(
        grams, "template int, label string, phrase boolean, grams int, place int, gram string")
        .withColumn("hash", F.xxhash64("gram")))
    widths: dict[int, set[str]] = {}
    for row in grams:
        widths.setdefault(row[5].count(" ") + 1, set()).add(row[5])
    hashes = {k: [r[0] for r in spark.createDataFrame([(g,) for g in sorted(some)], "g string")
                  .select(F.xxhash64("g")).collect()] for k, some in widths.items()}

    def hits(words: Column) -> Column:
        def of(k: int) -> Column:
            def gram(i: Column) -> Column:
                return F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])
            places = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(
                F.array().cast("array<int>"))
            heads = sorted({g.split(" ")[0] for g in widths[k]})
            found = F.filter(places, lambda i: F.get(words, i).isin(*heads) & F.xxhash64(gram(i)).isin(*hashes[k]))
            return F.transform(found, lambda i: F.struct(i.alias("word"), gram(i).alias("found")))
        return F.concat(*[of(k) for k in sorted(widths)])

    others = [frame[f"`{c}`"] for c in frame.columns if c != text]
    words = F.filter(F.split(ascii_lower(frame[f"`{text}`"]), GAP), lambda w: w != "")
    both = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), hits(w).alias("hits")))[0]
    rows = stage(frame.select(F.struct(*others or [F.lit(None).alias("_")]).alias("row"), both.alias("_both"))
                 .select("row", F.col("_both.n").alias("n_words"), F.col("_both.hits").alias("hits"))
                 .withColumn("at", F.monotonically_increasing_id()), "license-grams")
    votes = (rows.select("at", F.explode("hits").alias("hit")).select("at", "hit.*")
             .withColumn("hash", F.xxhash64("found"))
             .join(F.broadcast(templates), "hash").filter("found = gram")
             .withColumn("diagonal", F.col("word") - F.col("place"))
             .groupBy("at", "template", "label", "phrase", "grams", "diagonal")
             .agg(F.collect_set("place").alias("places"), F.min("word").alias("low"), F.max("word").alias("high"),
                  F.max(F.size(F.split("gram", " "))).alias("k")))
    line = Window.partitionBy("at", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(line) > F.when(F.col("phrase"), 0).otherwise(SLACK))
    spans = (votes.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
             .withColumn("_span", F.sum("_new").over(line))
             .groupBy("at", "template", "label", "phrase", "grams", "_span")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"),
                  F.min("low").cast("long").alias("first_word"),
                  F.max(F.col("high") + F.col("k") - 1).cast("long").alias("last_word")))
    good = (F.col("held") == F.col("grams")) | (~F.col("phrase") & (F.col("held") >= VOTES)
                                               & (F.col("held") >= COVER * F.col("grams")))
    spans = spans.filter(good).withColumn("cover", F.col("held") / F.col("grams"))
    # Where notices overlap, the ones that fit best stand.
    text_order = Window.partitionBy("at", "phrase").orderBy("first_word", "last_word", "template")
    reached = F.max("last_word").over(text_order.rowsBetween(Window.unboundedPreceding, -1))
    spans = (spans.withColumn("_new", (F.col("phrase") | F.coalesce(F.col("first_word") > reached, F.lit(True))).cast("int"))
             .withColumn("_place", F.sum("_new").over(text_order))
             .withColumn("_best", F.max("cover").over(Window.partitionBy("at", "phrase", "_place")))
             .filter(F.col("cover") == F.col("_best")))
    return rows.drop("hits"), spans.select(
        "at", "template", "label", "phrase", "first_word", "last_word", "cover")


def summary(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """One line per scanned row: places of phrases, labels and the best cover."""
    phrase = F.col("phrase")
    found = spans.groupBy("at").agg(
        F.count(F.when(phrase, 1)).alias("n_base"),
        F.min(F.when(phrase, F.col("first_word"))).alias("first_word"),
        F.max(F.when(phrase, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"))
    return rows.join(found, "at", "left").select(
        "row", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
