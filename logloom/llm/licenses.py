"""License scans: an exact containment join of text blocks with license templates."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import ascii_lower, words

# Phrases that must stand word by word, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Opening sentences of public licenses and notices, as words.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
THRESHOLD = 0.8
STRIDE = 32


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _candidates(words_: Column, tokens: list[str], stride: int) -> Column:
    """Numbers of the blocks of ``2 * stride`` words, one every ``stride``, that hold one of the tokens."""
    sought = _strings(tokens)
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words_) - 1, F.lit(0))), lambda i: F.array_contains(sought, F.get(words_, i)))
    blocks = F.flatten(F.transform(places, lambda i: F.array(
        F.floor(i / stride).cast("int"), F.greatest(F.floor(i / stride).cast("int") - 1, F.lit(0)))))
    return F.array_distinct(blocks)


def scan(
    docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD, stride: int = STRIDE,
) -> DataFrame:
    """Find phrases and license templates in every text.

    Texts are cut into overlapping blocks of ``2 * stride`` words, so that any
    ``stride + 1`` words in a row lie whole in one. A block matches a template
    when it contains at least ``threshold`` of the template's distinct words; a
    phrase is a template of which it must contain all, and is then looked up
    word by word.

    The join is exact. Template words are counted in all documents and ordered
    from rare to common. A template's prefix is as many of its rarest words as
    may be absent, plus one: only blocks with one of them are candidates. The
    length filter drops blocks with too few template words; the positional
    filter drops those whose first common word leaves too few behind it in
    either order; the rest are counted. Templates are few and go with the plan,
    so no text is shuffled.

    Returns one row per row of ``docs``: ``doc_id``, ``n_words``, ``n_base``
    (places of phrases), ``first_word``, ``last_word`` (their smallest and
    largest start, else null), ``base_labels``, ``labels``, ``score`` (largest
    share of a matching template, 1 with a phrase, else 0). Null and empty texts have no words
    and no label. Repeated rows are scanned like others; other columns are not
    read.
    """
    phrases = [(text.split(), label) for text, label in phrases]
    kinds = [(list(dict.fromkeys(text.split())), label, threshold) for text, label in templates]
    kinds += [(list(dict.fromkeys(text)), label, 1.0) for text, label in phrases]
    vocabulary = sorted({w for tokens, _, _ in kinds for w in tokens})
    split = docs.select("doc_id", words(ascii_lower(F.col("text"))).alias("_words"))
    counts = dict(
        split.select(F.explode(F.array_intersect(_strings(vocabulary), "_words")).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n")).collect()  # one row per template word at most
    )
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    joins = []
    for tokens, label, share in kinds:
        tokens = sorted(tokens, key=rank.get)
        need = ceil(share * len(tokens) - 1e-9)
        joins.append((tokens, tokens[: len(tokens) - need + 1], need, label))
    seeds = sorted({w for _, prefix, _, _ in joins for w in prefix}, key=rank.get)

    def share_of(block: Column, join: tuple) -> Column:
        """Share of the template in a block (its template words in the global order), 0 below the threshold."""
        tokens, prefix, need, _ = join
        whole = _strings(tokens)
        first = F.get(F.array_intersect(_strings(prefix), block), 0)
        ahead = F.least(len(tokens) - F.array_position(whole, first), F.size(block) - F.array_position(block, first)) + 1
        common = F.size(F.array_intersect(whole, block))
        return F.when((F.size(block) >= need) & first.isNotNull() & (ahead >= need) & (common >= need), common / len(tokens)).otherwise(0.0)

    # One array per template: its share in every candidate block.
    ordered = F.transform(
        _candidates(F.col("_words"), seeds, stride),
        lambda k: F.array_intersect(_strings(order), F.slice("_words", k * stride + 1, F.lit(2 * stride))),
    )
    hit = split.withColumn("_hit", F.arrays_overlap("_words", _strings(seeds)))
    blocks = hit.withColumn("_blocks", F.when(F.col("_hit"), ordered).otherwise(F.array().cast("array<array<string>>")))
    best_share = lambda join: F.coalesce(F.array_max(F.transform("_blocks", lambda b: share_of(b, join))), F.lit(0.0))
    shares = F.array(*[best_share(join) for join in joins])
    shared = blocks.withColumn("_shares", F.when(F.size("_blocks") > 0, shares).otherwise(F.array(*[F.lit(0.0)] * len(joins))))
    known, nowhere = len(kinds) - len(phrases), F.array().cast("array<struct<at:int,label:string>>")

    def places_of(k: int, text: list[str], label: str) -> Column:
        """Where a phrase stands, looked up only where a block contains its words."""
        sought = _strings(text)
        starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - len(text), F.lit(0)))
        at = F.filter(starts, lambda i: F.slice("_words", i + 1, F.lit(len(text))) == sought)
        found = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
        return F.when(F.get("_shares", F.lit(known + k)) >= 1, found).otherwise(nowhere)

    starts = [places_of(k, text, label) for k, (text, label) in enumerate(phrases)]
    based = shared.withColumn("_base", F.concat(*starts))
    base = F.array_distinct(F.col("_base.label"))
    more = F.array_compact(F.array(*[
        F.when(F.get("_shares", F.lit(k)) > 0, F.lit(join[3])) for k, join in enumerate(joins[:known])
    ]))
    best = F.array_max(F.slice("_shares", 1, F.lit(known))) if known else F.lit(0.0)
    return based.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base.at").cast("long").alias("first_word"), F.array_max("_base.at").cast("long").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(best).alias("score"),
    )
