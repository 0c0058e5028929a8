"""License scan with DataFrame functions only: phrases, and an exact containment join with templates.

Templates are few and stated by the caller; text blocks are the lines of all texts. Tokens of the
templates are ordered by how many documents have them, rarest first. A block that contains the share
``threshold`` of a template's words has one of its first ``size - need + 1`` words (prefix filter), at
least ``need`` template words at all (length filter), and enough left of both after the first common
word (positional filter). Only what passes all three is compared. The templates ride along as a
literal, so nothing is shuffled but one count for each template word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import A_TO_Z

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
THRESHOLD = 0.8

# Notices as their authors publish them.
TEMPLATES = {
    "apache-2": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "gpl-3": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ),
}


def plain_words(text: str) -> list[str]:
    """The words of an ASCII text, as ``text_words`` finds them."""
    return re.findall("[0-9a-z]+", text.lower())


def lowered(text: Column) -> Column:
    """A-Z lower-cased; of other letters only those whose lower case is no ASCII change too.

    The built-in ``lower`` is much faster than ``translate``. It differs in letters outside ASCII,
    which no phrase or template has, and moves no border between words, but for the two letters
    whose lower case holds an ASCII letter; texts with these go the slow way.
    """
    text = F.coalesce(text, F.lit(""))
    odd = text.contains("\u212a") | text.contains("\u0130")
    return F.when(odd, F.translate(text, A_TO_Z, A_TO_Z.lower())).otherwise(F.lower(text))


def text_words(low: Column) -> Column:
    return F.array_remove(F.split(low, BETWEEN_WORDS), "")


def _literal(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _places(words: Column, phrase: Sequence[str], rarest: Sequence[str]) -> Column:
    """Indexes at which the phrase stands; looked for only where all its words occur."""
    there = F.lit(True)
    for word in rarest:
        there = there & F.array_contains(words, word)

    def here(i: Column) -> Column:
        same = F.lit(True)
        for k, word in enumerate(phrase):
            same = same & (F.get(words, i + k) == word)
        return F.coalesce(same, F.lit(False))

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    return F.when(there, starts).otherwise(F.array().cast("array<int>"))


def word_frequencies(texts: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many rows of ``texts`` (words) each word of the vocabulary occurs; one number each."""
    met = texts.select(F.explode(F.array_intersect("words", _literal(vocabulary))).alias("word"))
    found = {r["word"]: r["n"] for r in met.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: found.get(w, 0) for w in vocabulary}


def _matches(low: Column, templates: list[tuple[str, list[str], int]], order: list[str]) -> Column:
    """(label, share) of each template that each block contains well enough."""
    known = F.array(*[
        F.struct(F.lit(label).alias("label"), _literal(words).alias("words"), F.lit(need).alias("need"),
                 _literal(words[: len(words) - need + 1]).alias("prefix")) for label, words, need in templates])

    def of_block(line: Column) -> Column:
        # The template words of the block, rarest first.
        block = F.array_intersect(_literal(order), text_words(line))

        def contained(t: Column) -> Column:
            common = F.array_intersect(t["prefix"], block)
            first = F.get(common, F.lit(0))
            rest = F.least(F.size(t["words"]) - F.array_position(t["words"], first),
                           F.size(block) - F.array_position(block, first))
            return ((F.size(block) >= t["need"]) & (F.size(common) > 0) & (rest + 1 >= t["need"])
                    & (F.size(F.array_intersect(t["words"], block)) >= t["need"]))

        return F.transform(F.filter(known, contained), lambda t: F.struct(
            t["label"].alias("label"),
            (F.size(F.array_intersect(t["words"], block)) / F.size(t["words"])).alias("share")))

    return F.flatten(F.transform(F.split(low, "\n"), of_block))


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, Sequence[str]] = TEMPLATES,
                  threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels,
    labels (arrays of strings, sorted), score.

    ``phrases`` maps words in ASCII to labels; places are counted in words from 0. ``labels`` adds the
    label of every template of which some line has the share ``threshold`` of the different words.
    ``score`` is the largest such share, 1 where a phrase was found, 0 where nothing was. Null text is
    empty: no words, no labels. Repeated rows come out repeated; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), lowered(F.col(text_col)).alias("low"))
    texts = texts.withColumn("words", text_words(F.col("low")))
    sets = [(label, sorted(set(plain_words(t)))) for label, ts in templates.items() for t in ts]
    asked = [(plain_words(p), label) for p, label in phrases.items()]
    vocabulary = sorted({w for _, ws in sets for w in ws} | {w for ws, _ in asked for w in ws})
    times = word_frequencies(texts, vocabulary)
    rank = {w: (times[w], w) for w in vocabulary}
    order = sorted({w for _, ws in sets for w in ws}, key=rank.get)
    ranked = [(label, sorted(ws, key=rank.get), math.ceil(threshold * len(ws) - 1e-9)) for label, ws in sets]
    prefixes = sorted({w for _, ws, need in ranked for w in ws[: len(ws) - need + 1]}, key=rank.get)

    none = F.array().cast("array<struct<label:string,share:double>>")
    columns = [f"_p{k}" for k in range(len(asked))]
    found = texts.select("id", F.size("words").cast("long").alias("n_words"), *[
        _places(F.col("words"), words, sorted(set(words), key=rank.get)).alias(c) for c, (words, _) in zip(columns, asked)],
        F.when(F.arrays_overlap("words", _literal(prefixes)), _matches(F.col("low"), ranked, order)).otherwise(none).alias("_met")
        if ranked else none.alias("_met"))
    places = F.concat(F.array().cast("array<int>"), *columns)
    base = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array().cast("array<string>"), *[
        F.array(F.when(F.size(c) > 0, label)) for c, (_, label) in zip(columns, asked)]))))
    found = found.select("id", "n_words", "_met", places.alias("_places"), base.alias("base_labels"))
    share = F.coalesce(F.array_max(F.transform("_met", lambda m: m["share"])), F.lit(0.0))
    return found.select(
        "id", "n_words", F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"), F.array_max("_places").cast("long").alias("last_word"),
        "base_labels", F.array_sort(F.array_union("base_labels", F.transform("_met", lambda m: m["label"]))).alias("labels"),
        F.when(F.size("_places") > 0, 1.0).otherwise(share).alias("score"))
