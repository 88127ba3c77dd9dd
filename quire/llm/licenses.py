"""License scans by diagonal voting, in DataFrame functions only.

Every run of three words of a text is joined to the runs of the templates. A match of text position p
with template position t votes for the diagonal p - t: a copy of a template is one diagonal with many
votes, and a word put in or left out moves the rest of the copy to a diagonal near by. Votes are gathered
by diagonal, neighbouring diagonals are merged, and a span is accepted if its runs cover enough of the
template and if it is not much longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.registry import query, table

RUN = 3  # words of a run
SHIFT = 2  # words by which two diagonals of one copy may differ
COVERED = 0.8  # share of a template's words that a span must hold
LONGER = 1.25  # length of a span over its template's
MANY_RUNS = 1_000_000  # runs of templates up to this number are broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the base labels.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# Usual short notices, and opening or closing passages of public license texts.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide"),
)


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case: runs of digits, letters and characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _runs(w: Column) -> Column:
    """Runs of three words by their start; the last two lack words."""
    n = F.size(w)
    return F.arrays_zip(w.alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c"))


def _worded(docs: DataFrame) -> DataFrame:
    """(doc_id, key, w): a row's words, and a hash that tells texts of one doc_id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), F.xxhash64(text).alias("key"), words(F.col("text")).alias("w"))


def _hashed_runs(df: DataFrame, *keep: str) -> DataFrame:
    """(*keep, at, h, a, b, c): every whole run of `w`, its place and its hash."""
    at = df.select(*keep, F.posexplode(_runs(F.col("w"))).alias("at", "run")).where(F.col("run.c").isNotNull())
    return at.select(*keep, "at", F.xxhash64("run.a", "run.b", "run.c").alias("h"), "run.a", "run.b", "run.c")


def template_runs(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(label, template, n, t, h, ta, tb, tc): the runs of the templates, which have at least three words.

    Equal runs of one template keep their places. The table is broadcast if it is not large.
    """
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(no).alias("template"), F.lit(text).alias("text")) for no, (label, text) in enumerate(templates)])
    given = spark.range(1).select(F.inline(rows)).select("label", "template", words(F.col("text")).alias("w"))
    runs = _hashed_runs(given.withColumn("n", F.size("w")), "label", "template", "n").select(
        "label", "template", "n", F.col("at").alias("t"), "h", F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("c").alias("tc")
    )
    # A text of n characters has fewer than n runs, so this bound is proven before anything runs.
    return F.broadcast(runs) if sum(len(text) for _, text in templates) <= MANY_RUNS else runs


def license_spans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, covered: float = COVERED) -> DataFrame:
    """(doc_id, key, label, template, first_word, end_word, votes, coverage): the accepted spans of each text.

    `key` is the hash of the text. Rows with equal doc_id and text give their spans once: a vote is a place
    of the template, so repeated rows cannot add votes. A null doc_id is a name like others. Null and empty
    texts, and texts of fewer than three words, have no span. What is gathered for a diagonal is at most
    the template's length, and the diagonals of one text and template are at most its words.
    """
    if not templates:
        templates = (("", ""),)  # no runs, and so no spans
    runs = template_runs(docs.sparkSession, templates)
    hits = _hashed_runs(_worded(docs), "doc_id", "key").join(runs, "h").where("a = ta AND b = tb AND c = tc")
    names = ("doc_id", "key", "label", "template", "n")
    voted = hits.groupBy(*names, (F.col("at") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"))
    along = Window.partitionBy(*names).orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > SHIFT).cast("int"), F.lit(0))
    merged = voted.withColumn("new", new).withColumn("copy", F.sum("new").over(along))
    spans = merged.groupBy(*names, "copy").agg(
        F.min(F.col("diagonal") + F.array_min("ts")).alias("first_word"),
        F.max(F.col("diagonal") + F.array_max("ts") + RUN).alias("end_word"),
        F.sum(F.size("ts")).alias("votes"),
        F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"),
    )
    held = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + (RUN - 1))))))
    measured = spans.withColumn("coverage", held / F.col("n"))
    fits = (F.col("coverage") >= covered) & (F.col("end_word") - F.col("first_word") <= F.col("n") * LONGER + SHIFT)
    return measured.where(fits).select("doc_id", "key", "label", "template", F.col("first_word").cast("bigint"), F.col("end_word").cast("bigint"), F.col("votes").cast("bigint"), "coverage")


def _places(w: Column, phrase: str) -> Column:
    """Starts of a phrase in the words; texts that lack one of its words are not searched."""
    parts = phrase.split(" ")
    there = F.lit(True)
    for part in parts:
        there = there & F.array_contains(w, part)

    def stands(i: Column) -> Column:
        held = F.lit(True)
        for j, part in enumerate(parts):
            held = held & F.coalesce(F.get(w, i + j) == part, F.lit(False))
        return held

    return F.when(there, F.filter(F.sequence(F.lit(0), F.size(w) - 1), stands)).otherwise(F.array().cast("array<int>"))


def license_labels(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per input row.

    The base is every place where a phrase's words stand one after another; `labels` adds those of the
    spans of `license_spans`, and `score` is 1 where the base has a place, else the largest coverage of a
    span, else 0. Null and empty texts have no words. Very long texts are read whole. Repeated rows come
    back as often as they are given. An empty table gives no rows; other columns are ignored.

    Rows and spans meet in one grouping by doc_id and text, which is added up before the shuffle, so
    neither a repeated row nor a null doc_id makes a large group.
    """
    found = F.col("found")
    starts = F.array(*[F.struct(F.lit(label).alias("label"), _places(F.col("w"), phrase).alias("at")) for label, phrase in sorted(phrases.items())])
    placed = _worded(docs).select("doc_id", "key", F.size("w").cast("bigint").alias("n_words"), starts.cast("array<struct<label:string,at:array<int>>>").alias("found"))
    at = F.flatten(F.transform(found, lambda x: x["at"]))
    row = F.struct(
        "n_words",
        F.size(at).cast("bigint").alias("n_base"),
        F.array_min(at).cast("bigint").alias("first_word"),
        F.array_max(at).cast("bigint").alias("last_word"),
        F.array_join(F.transform(F.filter(found, lambda x: F.size(x["at"]) > 0), lambda x: x["label"]), ",").alias("base_labels"),
    )
    base = placed.select("doc_id", "key", row.alias("row"), F.lit(1).cast("bigint").alias("times"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("coverage"))
    nothing = F.lit(None).cast(dict(base.dtypes)["row"])
    spans = license_spans(docs, templates).groupBy("doc_id", "key", "label").agg(F.max("coverage").alias("coverage"))
    added = spans.select("doc_id", "key", nothing.alias("row"), F.lit(0).cast("bigint").alias("times"), "label", "coverage")
    told = base.union(added).groupBy("doc_id", "key").agg(
        F.max("row").alias("row"), F.sum("times").alias("times"), F.collect_set("label").alias("more"), F.max("coverage").alias("coverage")
    )
    base_labels = F.col("row.base_labels")
    every = F.array_join(F.array_sort(F.array_remove(F.array_union(F.split(base_labels, ","), F.col("more")), "")), ",")
    score = F.when(F.col("row.n_base") > 0, F.lit(1.0)).otherwise(F.least(F.col("coverage"), F.lit(1.0)))
    one = told.select("doc_id", "row.*", every.alias("labels"), score.alias("score"), F.sequence(F.lit(1), F.col("times").cast("int")).alias("times"))
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return one.select(*names, F.explode("times").alias("time")).select(*names)


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    has = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    given = ", ".join(f"({no}, {quoted(label)}, {quoted(text)})" for no, (label, text) in enumerate(TEMPLATES))
    places = " UNION ALL ".join(
        f"SELECT row_no, i - 1 AS pos, {quoted(label)} AS label FROM (SELECT row_no, w, unnest(range(1, len(w) + 1)) AS i FROM t WHERE list_contains(w, {quoted(phrase.split(' ')[0])})) "
        f"WHERE array_to_string(w[i:i + {phrase.count(' ')}], ' ') = {quoted(phrase)}"
        for label, phrase in PHRASES.items()
    )
    return f"""
WITH t AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all({low("coalesce(text, '')")}, '{has}') AS w FROM documents),
p AS (SELECT template, label, regexp_extract_all({low("text")}, '{has}') AS w FROM (VALUES {given}) AS v(template, label, text)),
pr AS (SELECT template, label, len(w) AS n, i - 1 AS t, array_to_string(w[i:i + {RUN - 1}], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - {RUN - 2})) AS i FROM p)),
tr AS (SELECT row_no, i - 1 AS pos, array_to_string(w[i:i + {RUN - 1}], ' ') AS run FROM (SELECT row_no, w, unnest(range(1, len(w) - {RUN - 2})) AS i FROM t WHERE len(w) >= {RUN})),
hits AS (SELECT row_no, template, label, n, pos, t, pos - t AS d FROM tr JOIN pr USING (run)),
diagonals AS (SELECT row_no, template, d, CASE WHEN d - lag(d) OVER (PARTITION BY row_no, template ORDER BY d) > {SHIFT} THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT row_no, template, d FROM hits)),
copies AS (SELECT row_no, template, d, sum(new) OVER (PARTITION BY row_no, template ORDER BY d) AS copy FROM diagonals),
held AS (SELECT row_no, template, copy, label, n, min(pos) AS first_at, max(pos) + {RUN} AS end_at, len(list_distinct(list_concat(list(t), list(t + 1), list(t + 2)))) / n AS coverage
  FROM hits JOIN copies USING (row_no, template, d) GROUP BY row_no, template, copy, label, n),
spans AS (SELECT row_no, label, coverage FROM held WHERE coverage >= {COVERED} AND end_at - first_at <= n * {LONGER} + {SHIFT}),
base AS ({places}),
based AS (SELECT row_no, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM base GROUP BY row_no),
labelled AS (SELECT row_no, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT row_no, label FROM base UNION ALL SELECT row_no, label FROM spans) GROUP BY row_no),
scored AS (SELECT row_no, max(coverage) AS coverage FROM spans GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(coverage, 0.0) END::DOUBLE AS score
FROM t LEFT JOIN based USING (row_no) LEFT JOIN labelled USING (row_no) LEFT JOIN scored USING (row_no)
"""


@query("op11_license_scan", _sql())
def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_labels(table(spark, folder, "documents"))
