"""Licence scan: an exact set-similarity join of text blocks with notices.

A block is a run of ``run`` consecutive lines of one text, so that a notice
wrapped over so many lines lies whole in one. A block gets a template's label
if it holds at least ``threshold`` of the template's distinct words.

The join is exact and looks at few pairs. Words are ordered by the number of
lines, of all texts, that hold them (rare ones first; only words of templates
can match, so all others are left out of the sets). A template of n words needs
``need`` = ceil(threshold * n) common words, so

* length: a block of fewer than ``need`` words is no candidate;
* prefix: the first common word stands among the first n - need + 1 words of
  the template and the first |block| - need + 1 of the block;
* position: after a first common word at i and j no more than
  1 + min(n - i - 1, |block| - j - 1) words can be common.

Pairs that meet in the index of template prefixes and pass the filters are
verified on the whole sets. Base rules are phrases whose words stand one after
the other anywhere in the text.

Everything is Spark expressions and joins. A text is read twice: once for the
counts, once for its candidate blocks, which are stored without the text. The
templates are an argument of the caller; their index is joined as any table.

Defined results: null texts are empty, without words, labels and places; rows
with equal or null ids are documents of their own; texts of any length are
whole; extra columns are not read; equal counts order by the word itself.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.session import materialize

# fixed values: phrases of the base rules
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: sentences of public licence notices, as (label, words)
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
            " the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
            " public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
            " documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
IN_LINE = r"\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F"


def _lower(text: Column) -> Column:
    """A-Z as a-z and nothing else (``lower`` also changes other alphabets)."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _occurs(text: Column, part: str) -> Column:
    """How often ``part`` occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def places(docs: DataFrame, into: str, phrases: dict[str, str] = PHRASES, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_base, first_word, last_word, base_labels (sorted array)."""
    # each word between blanks of its own, so that neighbouring places don't overlap
    words = F.trim(F.regexp_replace(_lower(F.coalesce(F.col(text), F.lit(""))), f"[{SEPARATORS}]+", "  "))
    out = docs.withColumn(into, F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" "))))
    padded = F.col(into)
    # no word means no blank: half the blanks are the words
    size = (_occurs(padded, " ") / 2).cast("long")
    found, first, last, labels = [], [], [], []
    for phrase, label in phrases.items():
        spaced = "".join(f" {w} " for w in phrase.split())
        n = _occurs(padded, spaced)
        before = F.left(padded, F.instr(padded, spaced) - 1)
        after = F.left(F.reverse(padded), F.instr(F.reverse(padded), spaced[::-1]) - 1)
        found.append(n)
        first.append(F.when(n > 0, _occurs(before, " ") / 2))
        last.append(F.when(n > 0, size - _occurs(after, " ") / 2 - len(phrase.split())))
        labels.append(F.when(n > 0, F.lit(label)))

    def extreme(pick, values):
        return (pick(*values) if len(values) > 1 else values[0]).cast("long")
    return out.withColumn(into, F.struct(
        size.alias("n_words"), reduce(Column.__add__, found).alias("n_base"),
        extreme(F.least, first).alias("first_word"), extreme(F.greatest, last).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base_labels")))


def _lines(text: str) -> Column:
    """The words of every line, as an array for each."""
    plain = F.regexp_replace(_lower(F.coalesce(F.col(text), F.lit(""))), f"[{IN_LINE}]+", " ")
    return F.transform(F.split(plain, "\n"), lambda line: F.split(line, " "))


def _word_counts(docs: DataFrame, vocabulary: list[str], text: str) -> DataFrame:
    """(word, n): the lines of all texts that hold a word of the templates."""
    known = _strings(vocabulary)
    held = docs.select(F.explode(F.flatten(F.transform(_lines(text), lambda w: F.array_intersect(known, w)))).alias("word"))
    return held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def template_index(templates: list[tuple[str, str]], order: dict[str, int], threshold: float) -> list[tuple]:
    """Rows (word, template, label, position, n, need, words) for each word of the templates' prefixes."""
    rows = []
    for number, (label, sentence) in enumerate(templates):
        words = sorted(set(sentence.split()), key=order.__getitem__)
        need = math.ceil(round(threshold * len(words), 9))
        rows += [(w, number, label, i, len(words), need, words) for i, w in enumerate(words[:len(words) - need + 1])]
    return rows


INDEX = "word string, template int, label string, i int, n int, need int, words array<string>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
         threshold: float = 0.9, run: int = 3, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (row, id, places) and matches (row, block, template, label, containment).

    ``row`` numbers the documents, whatever their ids. A match names the first
    line of its block, from 0.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    vocabulary = sorted({w for _, sentence in templates for w in sentence.split()})
    # one row for each word of the templates
    counts = {r["word"]: r["n"] for r in _word_counts(docs, vocabulary, "text").collect()}
    ordered = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    index = template_index(templates, {w: k for k, w in enumerate(ordered)}, threshold)
    prefixes = _strings(sorted({r[0] for r in index}))
    least = min((r[5] for r in index), default=1)

    known = _strings(ordered)
    narrow = places(docs, "places", phrases).withColumn(
        "lines", F.transform(_lines("text"), lambda w: F.array_intersect(known, w)))

    def block(_, at):
        # in the order of the first array, so by frequency
        words = F.array_intersect(known, F.flatten(F.slice(F.col("lines"), at + 1, run)))
        return F.struct(at.alias("block"), words.alias("words"))

    def possible(b):
        size = F.size(b["words"])
        return (size >= least) & F.arrays_overlap(F.slice(b["words"], 1, F.greatest(size - least + 1, F.lit(1))), prefixes)
    # a text whose lines hold no prefix word has no candidate block at all
    some = F.exists("lines", lambda w: F.arrays_overlap(w, prefixes))
    none = F.array().cast("array<struct<block:int,words:array<string>>>")
    narrow = materialize(narrow.select(
        F.monotonically_increasing_id().alias("row"), "id", "places",
        F.when(some, F.filter(F.transform("lines", block), possible)).otherwise(none).alias("blocks")))

    blocks = narrow.select("row", F.explode("blocks").alias("b")).select(
        "row", "b.block", F.col("b.words").alias("held"), F.size("b.words").alias("size"))
    prefix = F.slice(F.col("held"), 1, F.greatest(F.col("size") - least + 1, F.lit(1)))
    entries = blocks.select("*", F.posexplode(prefix).alias("j", "word"))
    met = (F.col("size") >= F.col("need")) & (
        1 + F.least(F.col("n") - F.col("i") - 1, F.col("size") - F.col("j") - 1) >= F.col("need"))
    pairs = entries.join(spark.createDataFrame(index, INDEX), "word").where(met)
    # a pair may meet at several words: its first common one is at the smallest place
    pairs = pairs.groupBy("row", "block", "template").agg(
        *(F.first(c).alias(c) for c in ("held", "words", "label", "n", "need")))
    common = F.size(F.array_intersect("held", "words"))
    matches = pairs.where(common >= F.col("need")).select(
        "row", "block", "template", "label", (common / F.col("n")).alias("containment"))
    return narrow.select("row", "id", "places.*"), matches


def label(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """One row for each document: its id, n_words, n_base, first_word, last_word, base_labels and labels (sorted
    arrays) and score, the largest containment found (1 with a base phrase, 0 with nothing)."""
    found, matches = scan(docs, doc_id=doc_id, **how)
    added = matches.groupBy("row").agg(F.collect_set("label").alias("added"), F.max("containment").alias("most"))
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("added", none)))
    return found.join(added, "row", "left").select(
        F.col("id").alias(doc_id), "n_words", "n_base", "first_word", "last_word", "base_labels", every.alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"))
