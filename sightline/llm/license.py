"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word pair of a text is hashed; pairs whose hash is one of the templates' are kept
with their words and joined to the template positions that have the same hash and words. A hit at
word p for template position q votes for the diagonal p - q. Votes are counted by diagonal,
diagonals of a template that lie at most ``GAP`` words apart (words put in or left out) are merged,
and a span is verified by the share of the template's pairs that it holds.

A base phrase stands where one diagonal holds all of its pairs. Base phrases are templates too, so
their places come out of the same votes.

One scan of the texts keeps each document's word count and its few hits; these are dealt by row
once, and all later steps work where they lie. Nothing is written. The templates are a fixed table
of some hundred positions.

Defined results: a null text is empty; without hits both label columns are "", the score is 0 and
the first and last word are null; repeated rows keep their rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = 3
#: Share of a template's word pairs that makes a label.
LEAST = 0.85
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
# The usual words of license notices, and the method's labels for them.
NOTICES = (
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("apache-2", "apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"),
)


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(template, label, is a base phrase, words)."""
    return [(i, label, i < len(BASE), text.split(" ")) for i, (label, text) in enumerate(BASE + NOTICES)]


def template_positions(spark) -> DataFrame:
    """(template, label, base, pairs, q, a, b, h): the word pair (a, b) at position q, of ``pairs`` in all."""
    rows = ", ".join(f"({i}, '{label}', {base}, {len(words) - 1}, {q}, '{words[q]}', '{words[q + 1]}')" for i, label, base, words in templates() for q in range(len(words) - 1))
    return spark.sql(f"SELECT *, xxhash64(a, b) AS h FROM VALUES {rows} AS t(template, label, base, pairs, q, a, b)")


def words_of(text) -> F.Column:
    """Words of a text after lower-casing A-Z."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), SEPARATORS), "")


def hits(docs: DataFrame, positions: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, hits): one row per input row; hits are the word pairs with a template's hash."""
    hashes = sorted({r["h"] for r in positions.select("h").collect()})  # fixed templates only
    words = docs.select(docs[id_col].cast("long").alias("doc_id"), words_of(docs[text_col].cast("string")).alias("words"))
    after = lambda i: F.get(F.col("words"), i + 1)
    pairs = F.transform("words", lambda w, i: F.struct(i.alias("p"), w.alias("a"), after(i).alias("b"), F.xxhash64(w, after(i)).alias("h")))
    return words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.filter(pairs, lambda x: x["h"].isin(hashes)).alias("hits"))


def diagonals(found: DataFrame, positions: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, template, label, base, pairs, diagonal, votes, q: set of positions), dealt by row; a row without votes has one with nulls."""
    votes = found.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("x")).select("row", "doc_id", "n_words", "x.*")
    joined = votes.join(F.broadcast(positions), ["h", "a", "b"], "left").withColumn("diagonal", F.col("p") - F.col("q")).drop("h", "a", "b", "p").repartition("row")
    return joined.groupBy("row", "doc_id", "n_words", "template", "label", "base", "pairs", "diagonal").agg(F.count("q").alias("votes"), F.collect_set("q").alias("q"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per input row."""
    positions = template_positions(docs.sparkSession)
    voted = diagonals(hits(docs, positions, id_col=id_col, text_col=text_col), positions)
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("int"), F.lit(0))
    bands = voted.withColumn("apart", apart).withColumn("band", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.when(F.col("base") & (F.col("votes") == F.col("pairs")), F.col("diagonal"))
    spans = bands.groupBy("row", "doc_id", "n_words", "template", "label", "pairs", "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("q")))).alias("held"), F.count(place).alias("places"), F.min(place).alias("first_word"), F.max(place).alias("last_word")
    )
    share = F.col("held") / F.col("pairs")
    told = spans.groupBy("row", "doc_id", "n_words").agg(
        F.sum("places").alias("n_base"),
        F.min("first_word").alias("first_word"),
        F.max("last_word").alias("last_word"),
        F.collect_set(F.when(F.col("places") > 0, F.col("label"))).alias("base_set"),
        F.max(share).alias("score"),
        F.collect_set(F.when(share >= LEAST, F.col("label"))).alias("method_set"),
    )
    return told.select(
        "doc_id",
        "n_words",
        F.col("n_base").cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base_set"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_set", "method_set")), ",").alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for the rows of ``scan`` over documents."""
    rows = ", ".join(f"({i}, '{label}', {str(base).lower()}, {len(words) - 1}, {q}, '{words[q]}', '{words[q + 1]}')" for i, label, base, words in templates() for q in range(len(words) - 1))
    return f"""
    WITH t(template, label, base, pairs, q, a, b) AS (VALUES {rows}),
    d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    w AS (SELECT row, words, unnest(range(len(words) - 1)) AS p FROM d),
    hit AS (SELECT row, template, label, base, pairs, p - q AS diagonal, q FROM w JOIN t ON words[p + 1] = a AND words[p + 2] = b),
    voted AS (SELECT row, template, label, base, pairs, diagonal, count(*) AS votes FROM hit GROUP BY ALL),
    places AS (SELECT row, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word FROM voted WHERE base AND votes = pairs GROUP BY row),
    bands AS (SELECT *, sum(apart) OVER (PARTITION BY row, template ORDER BY diagonal) AS band FROM
      (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) > {GAP} THEN 1 ELSE 0 END AS apart FROM voted)),
    spans AS (SELECT row, template, label, pairs, band, count(DISTINCT q) AS held FROM bands JOIN hit USING (row, template, label, base, pairs, diagonal) GROUP BY ALL),
    best AS (SELECT row, max(held / pairs) AS score FROM spans GROUP BY row),
    named AS (SELECT DISTINCT row, label, true AS base FROM voted WHERE base AND votes = pairs
      UNION SELECT DISTINCT row, label, false FROM spans WHERE held / pairs >= {LEAST}),
    lists AS (SELECT row, array_to_string(list_sort(coalesce(list(DISTINCT label) FILTER (WHERE base), [])), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM named GROUP BY row)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0)::DOUBLE, 6) AS score
    FROM d LEFT JOIN places USING (row) LEFT JOIN best USING (row) LEFT JOIN lists USING (row)"""
