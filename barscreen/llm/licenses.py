"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or a run of words across line ends, a little longer than the template: notices are
wrapped. It matches a template if it holds ``threshold`` or more of the template's words.

What a block holds its text holds. So whole texts, as sets of words, are joined first. Words are ordered by how many
texts hold them, rarest first. A text can only match if one of its rarest words is one of the template's rarest (prefix
filter), if it holds enough template words at all (length filter), and if enough words remain behind the first common
one (positional filter); what remains is counted exactly, and its blocks are looked at.

Only template words matter, so a text is reduced to its template words before it is joined, on a word, against one row
for each word of the templates' prefixes.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, let

#: Characters that part words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word in a text that isn't lower-cased yet.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Words that all templates may have together: the vocabulary is a literal of the plan.
TEMPLATE_WORDS = 10_000

# Phrases with their labels, and notices as licenses word them.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mit", "Released under the MIT License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("proprietary", "All rights reserved."),
)


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAP), "")


def _distinct_words(text: str) -> list[str]:
    low = text.translate(str.maketrans(UPPER, LOWER))
    return sorted({"".join(g) for g in _runs(low)})


def _runs(text: str) -> list[str]:
    return "".join(c if c.isdigit() or c in LOWER or ord(c) > 127 else " " for c in text).split()


def ranked_words(blocks: DataFrame, words: list[str]) -> list[str]:
    """``words``, rarest first by how many texts (words: array) hold them; at most TEMPLATE_WORDS are counted."""
    held = blocks.select(F.explode(F.array_intersect(F.lit(words), "words")).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def template_prefixes(spark: SparkSession, templates, order: list[str], threshold: float) -> DataFrame:
    """(word, entries): for each word of a template's prefix the templates that have it there."""
    rank = {w: i for i, w in enumerate(order)}
    entries: dict[str, list] = {}
    for label, text in templates:
        own = sorted(_distinct_words(text), key=rank.__getitem__)
        needed = _needed(own, threshold)
        for place in range(len(own) - needed + 1):
            entries.setdefault(own[place], []).append((label, place, needed, own, ceil(len(_runs(text)) / threshold - 1e-9)))
    schema = "word string, entries array<struct<label: string, place: int, needed: int, vocabulary: array<string>, reach: int>>"
    return spark.createDataFrame(sorted(entries.items()), schema)


def _needed(words: list[str], threshold: float) -> int:
    return ceil(threshold * len(words) - 1e-9)


def phrase_places(words: Column, phrases) -> Column:
    """(at, phrase) for every place of a phrase in an array of words."""

    def of(phrase: str) -> Column:
        parts = phrase.split(" ")

        def here(i: Column) -> Column:
            return reduce(lambda a, b: a & b, [F.coalesce(F.get(words, i + k) == p, F.lit(False)) for k, p in enumerate(parts)])

        at = F.array_compact(F.transform(words, lambda w, i: F.when(here(i), i)))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(phrase).alias("phrase")))

    return F.concat(*[of(p) for p, _ in phrases])


def matches(entries: Column, held: Column, place: Column, text: Column) -> Column:
    """(label, share) of the templates, of those in ``entries``, that a block of a text matches.

    ``held`` are the text's template words; the one at ``place`` led here. A template counts at its first common word only.
    """

    def promising(e: Column) -> Column:
        left = F.least(F.size(held) - place, F.size(e["vocabulary"]) - e["place"])  # common words from here on, at most
        enough = (F.size(held) >= e["needed"]) & (place <= F.size(held) - e["needed"]) & (left >= e["needed"])
        first = ~F.arrays_overlap(F.slice(held, 1, place), e["vocabulary"])
        return enough & first & (F.size(F.array_intersect(e["vocabulary"], held)) >= e["needed"])

    def best(e: Column, lines: Column) -> Column:
        """The most template words that one block holds."""
        in_line = F.array_max(F.transform(lines, lambda line: F.size(F.array_intersect(e["vocabulary"], line))))
        placed = F.transform(F.flatten(lines), lambda w, i: F.struct(i.alias("at"), w.alias("w")))

        def in_runs(own: Column) -> Column:
            def run(x: Column, i: Column) -> Column:
                near = F.filter(F.slice(own, i + 1, e["reach"]), lambda y: y["at"] < x["at"] + e["reach"])
                return F.size(F.array_distinct(F.transform(near, lambda y: y["w"])))

            return F.coalesce(F.array_max(F.transform(own, run)), F.lit(0))

        runs = let(F.filter(placed, lambda x: F.array_contains(e["vocabulary"], x["w"])), in_runs)
        return F.greatest(in_line, runs)

    def counted(chosen: Column) -> Column:
        lines = F.transform(F.split(text, "\n"), word_list)
        return let(lines, lambda ls: F.transform(chosen, lambda e: F.struct(
            e["label"].alias("label"), e["needed"].alias("needed"), F.size(e["vocabulary"]).alias("of"), best(e, ls).alias("common"))))

    none = F.array().cast("array<struct<label: string, share: double>>")
    found = let(F.filter(entries, promising), lambda chosen: F.when(F.size(chosen) > 0, F.transform(
        F.filter(counted(chosen), lambda m: m["common"] >= m["needed"]),
        lambda m: F.struct(m["label"].alias("label"), (m["common"] / m["of"]).alias("share")))).otherwise(none))
    return F.when(entries.isNotNull(), found)


def scan_licenses(
    docs: DataFrame, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of ``docs``.

    ``docs`` has doc_id, text and any others. ``n_base`` counts the places of all ``phrases``; first_word and last_word
    are their smallest and largest place, null without any. ``labels`` adds those of templates that a line
    or a run of words matches.
    ``score`` is 1 with a phrase, else the largest share of a matched template's words, else 0. A null or empty text has
    no words and no labels. Rows that agree in doc_id and text are worked out once and returned as often as they occur.
    """
    vocabulary = sorted({w for _, t in templates for w in _distinct_words(t)})
    if len(vocabulary) > TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {TEMPLATE_WORDS} words")
    least = min(_needed(_distinct_words(t), threshold) for _, t in templates)
    text = F.coalesce(F.col("text"), F.lit(""))
    order = ranked_words(docs.select(word_list(text).alias("words")), vocabulary)
    prefixes = template_prefixes(docs.sparkSession, templates, order, threshold)

    hint = "|".join(sorted({p.split(" ")[-1] for p, _ in phrases}))  # without these letters a text has no phrase
    none = F.array().cast("array<struct<at: int, phrase: string>>")
    found = F.when(text.rlike(f"(?i)({hint})"), let(word_list(text), lambda w: phrase_places(w, phrases))).otherwise(none)
    rows = docs.select(
        "doc_id", F.xxhash64(text).alias("sign"), F.md5(text).alias("digest"),
        F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"),
        found.alias("found"),
        F.array_intersect(F.lit(order), word_list(text)).alias("held"),
        text.alias("text"),
    )
    prefix = F.slice("held", 1, F.greatest(F.size("held") - least + 1, F.lit(0)))
    rows = rows.select("*", F.posexplode_outer(prefix).alias("place", "word"))
    first = F.coalesce("place", F.lit(0)) == 0
    hits = matches(F.col("entries"), F.col("held"), F.col("place"), F.col("text"))
    prefixes = F.broadcast(prefixes)  # TEMPLATE_WORDS rows at most; texts must not move for it
    hit = rows.join(prefixes, "word", "left").select("doc_id", "sign", "digest", "n_words", "found", first.alias("first"), hits.alias("hits"))
    hit = hit.where(F.col("first") | (F.size("hits") > 0))  # one row a text, and those with matches
    per_text = hit.groupBy("doc_id", "sign", "digest").agg(
        F.sum(F.col("first").cast("long")).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.max("found").alias("found"),
        F.collect_set(F.when(F.size("hits") > 0, F.transform("hits", lambda h: h["label"]))).alias("matched"),
        F.max(F.array_max(F.transform("hits", lambda h: h["share"]))).alias("share"),
    )
    label_of = F.create_map(*[F.lit(x) for pair in phrases for x in pair])
    base = F.array_sort(F.array_distinct(F.transform("found", lambda x: label_of[x["phrase"]])))
    at = F.transform("found", lambda x: x["at"])
    out = per_text.withColumn("base", base).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        "doc_id", "n_words",
        F.size("found").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.flatten("matched"))), ",").alias("labels"),
        F.when(F.size("found") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
