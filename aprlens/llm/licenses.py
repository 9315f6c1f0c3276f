"""License scans: an exact set-similarity join of text blocks with license templates, in Spark's own functions.

A block is any run of so many words as the template allows, over line ends too. Every template's tokens are ordered by
how many documents hold them, rarest first. A block that contains the wanted share of a template must hold a token of
its prefix in that order, so blocks are looked for around such tokens only; what lies around one bounds what a block
there can share, and what passes is counted out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .shared import kept

# The base phrases and their labels, and the templates of the join with theirs.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
SHARE = 0.8  # of a template's distinct tokens that a block must hold
WHOLE = 14  # templates of fewer distinct tokens must be held whole: each of their few words tells licenses apart
SPREAD = 1.5  # words of a block for each word of a longer template; those held whole have no word between
_LETTER = r"0-9A-Za-z\x{80}-\x{10FFFF}"  # what a word is made of; A-Z are lower-cased
WORD = f"[{_LETTER}]+"
_START, _STOP, _GAP = f"(?<![{_LETTER}])", f"(?![{_LETTER}])", f"[^{_LETTER}]+"


def any_of(words: list[str]) -> str:
    """A pattern for any of the words, whole and in any ASCII case; tried by first letter."""
    by: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    return f"(?i){_START}(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in sorted(by.items()))}){_STOP}"


def phrase_pattern(phrases: list[str]) -> str:
    joined = "|".join(_GAP.join(p.split()) for p in phrases)
    return f"{_START}(?:{joined}){_STOP}"


def _lowered(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")


def _base(text: Column) -> dict[str, Column]:
    """Counts, positions and labels of the base phrases."""
    every = phrase_pattern(list(PHRASES))
    n_base = F.regexp_count(text, F.lit(f"(?i){every}"))
    words_in = lambda pattern: F.regexp_count(F.regexp_extract(text, pattern, 1), F.lit(WORD)).cast("long")
    label = lambda phrase: F.when(text.rlike(f"(?i){phrase_pattern([phrase])}"), F.lit(PHRASES[phrase]))
    some = F.col("n_base") > 0
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*map(label, PHRASES)))))
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "n_base": n_base.cast("long"),
        "first_word": F.when(some, words_in(f"(?is)^(.*?){every}")),
        "last_word": F.when(some, words_in(f"(?is)^(.*){every}")),
        "base": F.when(some, labels).otherwise(_strings([])),
    }


def licensed(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, share: float = SHARE) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``: one
    row per row of ``docs``.

    A text's words are runs of letters A-Z (lower-cased), digits and characters above U+007F; its blocks are runs of
    words, whatever lines they are on. A template's label is added where a block of at most :data:`SPREAD` times the
    template's words holds ``share`` of its distinct words or more; a template of fewer than :data:`WHOLE` distinct
    words must be there whole, in any order but with nothing between. ``score`` is 1 with a base phrase, else the
    largest share of a template found, else 0. Null and empty texts have no words, null
    positions, empty labels and score 0; repeated rows and null ids keep their rows; other columns are ignored; an
    empty table gives an empty result. Templates belong to the call, so tables of their words are small.
    """
    spark = docs.sparkSession
    sets = [(label, sorted(set(text.split())), len(text.split())) for label, text in templates]
    vocabulary = sorted({w for _, words, _ in sets for w in words})
    text = F.coalesce(F.col("text"), F.lit(""))
    # Global order: how many documents hold each template word, over all documents. One row per word at most.
    held = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(any_of(vocabulary)), F.lit(0)), _lowered))
    held = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    frequency = {r["word"]: r["n"] for r in held.collect()}
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, contents = [], []
    for t, (label, words, length) in enumerate(sets):
        words = sorted(words, key=rank.__getitem__)
        whole = len(words) < WHOLE
        need = len(words) if whole else math.ceil(share * len(words) - 1e-9)
        contents.append((t, label, words, need, length if whole else math.ceil(SPREAD * length)))
        index += [(w, t) for w in words[: len(words) - need + 1]]

    starts = sorted({w for w, _ in index})
    rows = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row"))
    for name, value in _base(F.col("text")).items():
        rows = rows.withColumn(name, value)
    rows = rows.withColumn("text", F.when(F.col("text").rlike(any_of(starts)), F.col("text")))
    rows = kept(rows, "scanned")

    by_word = spark.createDataFrame(index, "start string, template int")
    templates_df = spark.createDataFrame(contents, "template int, label string, known array<string>, need int, span int")
    by_word = by_word.join(templates_df, "template")
    # Around each word of a prefix lies every block that may hold it: the words of the longest block to both sides.
    longest = max((span for *_, span in contents), default=1)
    words = rows.where("text is not null").select("row", F.regexp_extract_all(_lowered(F.col("text")), F.lit(WORD), F.lit(0)).alias("words"))
    known = F.transform("words", lambda w, i: F.when(w.isin(starts), i))
    around = words.select("row", "words", F.explode(F.array_compact(known)).alias("at"))
    around = around.select(
        "row",
        F.get("words", F.col("at")).alias("start"),
        F.least("at", F.lit(longest - 1)).alias("before"),
        F.slice("words", F.greatest(F.col("at") - longest + 2, F.lit(1)), F.least("at", F.lit(longest - 1)) + longest).alias("near"),
    )
    met = around.join(F.broadcast(by_word), "start")
    first = F.greatest(F.col("before") - F.col("span") + 1, F.lit(0))
    near = F.slice("near", first + 1, F.col("before") - first + F.col("span"))
    met = met.select("row", "label", "known", "need", "span", near.alias("near"))
    met = met.where(F.size(F.array_intersect("near", "known")) >= F.col("need"))
    # Every block there, counted out.
    blocks = F.sequence(F.lit(1), F.greatest(F.size("near") - F.col("span") + 1, F.lit(1)))
    shared = F.array_max(F.transform(blocks, lambda i: F.size(F.array_intersect(F.slice("near", i, F.col("span")), "known"))))
    hits = met.select("row", "label", "need", F.size("known").alias("of"), shared.alias("shared"))
    hits = hits.where("shared >= need").select("row", "label", (F.col("shared") / F.col("of")).alias("share"))
    hits = hits.groupBy("row").agg(F.collect_set("label").alias("added"), F.max("share").alias("share"))
    out = rows.drop("text").join(hits.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("added", _strings([]))))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
