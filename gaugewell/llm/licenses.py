"""License scans: an exact set-similarity join of text blocks with license templates; Spark SQL functions only.

A block is a window of twice as many words as a template has, from every multiple of that number on, whatever the
line breaks; so any run of the template's length lies in a block. A block contains a template when it holds at least
``THRESHOLD`` of its distinct words, and the words that name the license among them.

Template words are ordered by how many documents hold them, rarest first. A text that contains a template of n words
holds one of its ``n - ceil(THRESHOLD * n) + 1`` rarest: the words of every document are joined with templates on
these (prefix), documents with too few template words are dropped (length), and so are candidates whose remaining
words, from the matching places on, cannot reach the threshold (position). What is left of documents is cut into
blocks, and blocks go through the same three filters before they are verified exactly. Every text is split into words
once; only those of the candidates are split again. The templates are a fixed table of a few rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.session import cut, keyed, named, written
from gaugewell.llm.spread import join_unique

#: Phrases of the base rule and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Public license notices, their labels, and the words that name them (fixed values).
TEMPLATES = (
    ("mit", "Released under the MIT License.", ("mit",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        (),
    ),
    ("apache", "Licensed under the Apache License, Version 2.0.", ("apache",)),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ("general", "public")),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        ("general", "public"),
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ()),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc", "nc")),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("noncommercial",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla",)),
)
THRESHOLD = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Candidate documents up to which their ids are broadcast; past that Spark joins by shuffle.
BROADCAST_IDS = 1_000_000
BLOCKS = "array<struct<first_word:long,label:string,containment:double>>"


def word_list(text: str) -> list[str]:
    """The words of a template in order."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWERED)))


def template_words(text: str) -> list[str]:
    """The distinct words of a template."""
    return sorted(set(word_list(text)))


def needed(words: int, threshold: float = THRESHOLD) -> int:
    """How many of so many distinct words a block must hold."""
    return math.ceil(round(threshold * words, 9))


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWERED)


def words_of(text: Column) -> Column:
    """The words of a lower-cased text."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def phrase_places(words: str, phrase: str) -> Column:
    """Starts of a phrase in the array column ``words``, counted from 0."""
    parts = phrase.split(" ")
    here = " AND ".join(f"get({words}, i + {k}) = '{part}'" for k, part in enumerate(parts))
    return F.expr(f"filter(sequence(0, size({words}) - 1), i -> {here})")


def word_sets(rows: DataFrame, templates: tuple[tuple[str, str, tuple[str, ...]], ...] = TEMPLATES) -> DataFrame:
    """``doc_id``, ``n_words``, the places ``at_<label>`` of every phrase and ``held``, the template words, of every row."""
    known = F.array(*[F.lit(w) for w in sorted({w for _, text, _ in templates for w in template_words(text)})]).cast("array<string>")
    low = rows.select("doc_id", words_of(lowered(F.col("text"))).alias("words"))
    low = low.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", known).alias("held"))
    none = F.array().cast("array<int>")
    places = [F.when(F.array_contains("words", p.split(" ")[-1]), phrase_places("words", p)).otherwise(none).alias(f"at_{label}") for p, label in PHRASES]
    return low.select("doc_id", "n_words", *places, "held")


def contained_templates(rows: DataFrame, sets: DataFrame, templates: tuple[tuple[str, str, tuple[str, ...]], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every (``doc_id``, ``first_word``, ``label``, ``template``, ``containment``) of a block that meets the threshold.

    ``rows`` has ``doc_id`` and ``text``, ``sets`` the result of :func:`word_sets` for them, written. ``first_word``
    counts words from 0. Templates without words match nothing.
    """
    spark = rows.sparkSession
    counts = dict(sets.select(F.explode("held").alias("word")).groupBy("word").count().collect())  # at most one row per word of the fixed templates
    by_rank = lambda w: (counts.get(w, 0), w)
    order = sorted({w for _, text, _ in templates for w in template_words(text)}, key=by_rank)
    entries = []
    for number, (label, text, names) in enumerate(templates):
        words = sorted(template_words(text), key=by_rank)
        for at, word in enumerate(words[: len(words) - needed(len(words), threshold) + 1]):
            entries.append((word, at, number, label, words, needed(len(words), threshold), len(word_list(text)), list(names)))
    schema = "word string, at int, template int, label string, words array<string>, need int, length int, names array<string>"
    index = F.broadcast(spark.createDataFrame(entries, schema))  # a few rows of the fixed templates
    hot = F.array(*[F.lit(w) for w in sorted({x[0] for x in entries})]).cast("array<string>")
    ordered = F.array(*[F.lit(w) for w in order]).cast("array<string>")

    def candidates(frame: DataFrame, *keys: str, own: bool = False) -> DataFrame:
        """Rows of ``frame`` (``keys`` and the words ``held`` in order) beside the templates that they contain."""
        words = frame.select(*keys, "held", F.posexplode("held").alias("place", "word")).where(F.array_contains(hot, F.col("word")))
        pairs = words.join(index, ["word", "template"] if own else ["word"]).where(F.size("held") >= F.col("need"))
        pairs = pairs.where(F.least(F.size("words") - F.col("at"), F.size("held") - F.col("place")) + F.col("at") >= F.col("need"))
        pairs = pairs.withColumn("shared", F.size(F.array_intersect("held", "words")))
        pairs = pairs.where((F.col("shared") >= F.col("need")) & (F.size(F.array_except("names", "held")) == 0))
        return pairs.select(*dict.fromkeys([*keys, "template", "label", "words", "length"]), (F.col("shared") / F.size("words")).alias("containment")).distinct()

    some = sets.where(F.arrays_overlap("held", hot)).select("doc_id", F.array_intersect(ordered, F.col("held")).alias("held"))
    pairs = cut(candidates(some, "doc_id").drop("containment"))
    ids = pairs.select("doc_id").distinct()
    near = F.broadcast if pairs.count() <= BROADCAST_IDS else lambda frame: frame
    texts = rows.join(near(ids), "doc_id", "left_semi").select("doc_id", words_of(lowered(F.col("text"))).alias("every"))
    places = texts.select("doc_id", F.posexplode("every").alias("at", "word")).where(F.array_contains(ordered, F.col("word")))
    placed = places.join(near(pairs), "doc_id").where(F.array_contains("words", F.col("word")))
    own = F.floor(F.col("at") / F.col("length")) * F.col("length")
    blocks = F.filter(F.array(own, own - F.col("length")), lambda first: first >= 0)
    held = placed.select("doc_id", "template", F.explode(blocks).alias("first_word"), "word")
    held = held.groupBy("doc_id", "template", "first_word").agg(F.collect_set("word").alias("held")).withColumn("held", F.array_intersect(ordered, F.col("held")))
    return candidates(held, "doc_id", "first_word", "template", own=True).select("doc_id", "first_word", "label", "template", "containment")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses named or quoted in every document.

    One row per row: ``doc_id``, ``n_words``, ``n_base`` (places of the base phrases), ``first_word`` and
    ``last_word`` (their smallest and largest start; null without any), ``base_labels``, ``labels`` (those of
    contained templates too), ``blocks`` (first word, label and containment of each block with a template) and
    ``score`` (1 with a base phrase, else the largest containment, else 0). A null text counts as empty. If an id is
    null or occurs twice, rows count as separate documents in the order of id (null first) and text.
    """
    rows, names = keyed(docs, F.col(text_col).alias("text"), id_col=id_col)
    sets = written(word_sets(rows), "words")
    starts = F.concat(*[F.col(f"at_{label}") for _, label in PHRASES])
    labels = F.filter(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for _, label in PHRASES]), lambda x: x.isNotNull())
    base = sets.select("doc_id", "n_words", starts.alias("starts"), labels.alias("base"))
    found = contained_templates(rows, sets).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_word", "label", "containment"))).alias("blocks"), F.max("containment").alias("best"))
    found = cut(found)
    both = join_unique(base, found, "doc_id", "left", found.count() <= BROADCAST_IDS).withColumn("blocks", F.coalesce("blocks", F.array().cast(BLOCKS)))
    every = F.array_sort(F.array_distinct(F.concat("base", F.col("blocks.label"))))
    result = both.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        "blocks",
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
    return named(result, names, "doc_id")


def oracle() -> str:
    """DuckDB twin of the op9 query."""
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWERED}')"
    word = WORD.replace("'", "''")
    places = ", ".join(
        f"list_filter(range(0, len(w)), lambda i: {' AND '.join(f'''w[i + {k + 1}] = '{part}' ''' for k, part in enumerate(p.split(' ')))}) AS at_{label}" for p, label in PHRASES
    )
    listed = lambda words: f"[{', '.join(repr(w) for w in words)}]::VARCHAR[]"
    values = ", ".join(f"({n}, '{label}', {listed(template_words(text))}, {listed(names)}, {len(word_list(text))})" for n, (label, text, names) in enumerate(TEMPLATES))
    starts = "list_concat(" + "list_concat(at_mit, at_apache), at_gpl)"
    base = "list_filter([" + ", ".join(f"CASE WHEN len(at_{label}) > 0 THEN '{label}' END" for _, label in PHRASES) + "], lambda x: x IS NOT NULL)"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {low} AS t, regexp_extract_all({low}, '{word}') AS w FROM documents),
p AS (SELECT doc_id, len(w)::BIGINT AS n_words, {places} FROM d),
b AS (SELECT doc_id, n_words, {starts} AS starts, {base} AS base FROM p),
templates(template, label, words, names, n) AS (VALUES {values}),
l AS (SELECT doc_id, label, words, names, unnest(list_transform(range(0, len(w), n), lambda i: list_distinct(w[i + 1:i + 2 * n]))) AS lw FROM d, templates WHERE len(list_intersect(w, words)) >= ceil(round({THRESHOLD} * len(words), 9))),
hits AS (SELECT doc_id, label, len(list_intersect(lw, words)) / len(words) AS c FROM l WHERE len(list_intersect(lw, words)) >= ceil(round({THRESHOLD} * len(words), 9)) AND len(list_intersect(lw, names)) = len(names)),
m AS (SELECT doc_id, list(label) AS found, max(c) AS best FROM hits GROUP BY doc_id)
SELECT b.doc_id, n_words, len(starts)::BIGINT AS n_base, list_min(starts)::BIGINT AS first_word, list_max(starts)::BIGINT AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ','), '') AS labels,
       CASE WHEN len(starts) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM b LEFT JOIN m USING (doc_id)"""
