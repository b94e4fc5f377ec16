"""License scan by an exact set-similarity join, in DataFrame expressions only.

Base phrases are counted wherever their words stand consecutively.  Beyond
those, every text block is compared with license notices as sets of tokens.  A
token is a pair of adjacent words, so the order of words counts; a block is a
window of ``2 * STEP`` words at every ``STEP``-th, whatever stands between them, so
notices may be wrapped, commented out or cut by punctuation, and every notice lies
whole in a block.  A template is found where a block holds at least ``threshold``
of its tokens and the four-word phrases that tell it from its like.  The join is exact and never compares all
pairs:

* tokens are ordered by their uses in the whole corpus, rarest first;
* prefix filter: a block that holds enough of a template holds one of the
  template's first ``size - need + 1`` tokens, so only those are indexed;
* length filter: a block with fewer template tokens than needed is dropped;
* positional filter: after a match the tokens left on either side bound what the
  overlap can become;
* a pair is kept at its first shared token only, then verified.

Texts are read once: what is kept of each are its counts and the places of
template tokens.  Those are looked for only where one of a few long words stands
that no match can miss.  The index has one row per template prefix token, so its
broadcast has a size fixed by the templates, and texts are never shuffled.

Defined results: a null text is the empty text; rows with the same id and text
get the same result each, null ids too; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import runtime

#: Phrases whose every place counts, and their labels (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


@dataclass(frozen=True)
class Template:
    """A notice's label and words, and phrases of four words that tell it from its like."""

    label: str
    text: str
    required: tuple[str, ...] = ()

    def tokens(self) -> list[str]:
        words = self.text.split()
        return list(dict.fromkeys([f"{a} {b}" for a, b in zip(words, words[1:])]))


_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
#: License notices (fixed values).
TEMPLATES = [
    Template("mit", "released under the mit license", ("under the mit license",)),
    Template("mit", "licensed under the mit license", ("under the mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("apache-2", "licensed under the apache license version 2 0", ("the apache license version",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("the apache license version",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "public license version 3")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "public license version 2")),
    Template("gpl-3", _GNU.format("general public license", 3), ("gnu general public license", "foundation either version 3")),
    Template("gpl-2", _GNU.format("general public license", 2), ("gnu general public license", "foundation either version 2")),
    Template("lgpl-3", "gnu lesser general public license version 3", ("gnu lesser general public", "public license version 3")),
    Template("lgpl-3", _GNU.format("lesser general public license", 3), ("gnu lesser general public", "foundation either version 3")),
    Template("agpl-3", "gnu affero general public license version 3", ("gnu affero general public", "public license version 3")),
    Template("agpl-3", _GNU.format("affero general public license", 3), ("gnu affero general public", "foundation either version 3")),
    Template("mpl-2", "mozilla public license v 2 0", ("mozilla public license v",)),
    Template("mpl-2", "mozilla public license version 2 0", ("mozilla public license version",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4",)),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0", ("creative commons attribution sharealike",)),
    Template("cc-by", "creative commons attribution 4 0 international", ("commons attribution 4 0",)),
    Template("cc0", "has waived all copyright and related or neighboring rights to", ("has waived all copyright",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
]
THRESHOLD = 0.75
#: Words from one block's begin to the next one's; no template is longer, even with words put in.
STEP = 128
#: A word after lower-casing, and what lies between words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, as far as words of the alphabet can tell.

    ``lower`` maps one other letter, the Kelvin sign, to a letter of a-z; it is
    replaced first, so no other text can turn into a word of a phrase.
    """
    return F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ")))


def needed(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


def anchors(templates: list[Template], threshold: float) -> list[str]:
    """Words of which every match has one.

    A match misses at most ``size - need`` tokens, and a word goes missing only
    with the tokens at it, one a word at least: of one word more, the longest of
    each template, one is there.
    """
    found: set[str] = set()
    for t in templates:
        size = len(t.tokens())
        words = sorted(set(t.text.split()), key=lambda w: (-len(w), w))
        sure = next((w for r in t.required for w in sorted(r.split(), key=len, reverse=True)), None)
        found |= {sure} if sure else set(words[: size - needed(size, threshold) + 1])
    return sorted(found)


def _places(phrases: dict[str, str]) -> list[Column]:
    """First words of each phrase's places, from the columns ``words`` and ``has<k>``."""
    out = []
    for k, phrase in enumerate(phrases):
        parts = phrase.split()
        same = " and ".join(f"words[int(i) + {j}] = '{w}'" for j, w in enumerate(parts))
        out.append(F.expr(f"CASE WHEN has{k} THEN filter(sequence(0L, n_words - {len(parts)}), i -> {same}) ELSE array() END").cast("array<bigint>").alias(f"starts{k}"))
    return out


def read(docs: DataFrame, templates: list[Template], phrases: dict[str, str], threshold: float) -> DataFrame:
    """One pass over the texts: doc_id, text_key, n_words, the phrases' places and the tokens' (``hits``)."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low = text.select("doc_id", F.xxhash64("text").alias("text_key"), lowered(F.col("text")).alias("lowered"))
    phrased, anchored = F.lit(False), F.lit(False)
    for phrase in phrases:
        every = F.lit(True)
        for word in phrase.split():
            every = every & F.col("lowered").contains(word)
        phrased = phrased | every
    for word in anchors(templates, threshold):
        anchored = anchored | F.col("lowered").contains(word)
    gated = low.select("doc_id", "text_key", F.regexp_count("lowered", F.lit(WORD)).cast("bigint").alias("n_words"), phrased.alias("phrased"), anchored.alias("anchored"), "lowered")
    split = gated.select("doc_id", "text_key", "n_words", "phrased", "anchored", F.when(F.col("phrased") | F.col("anchored"), F.regexp_extract_all("lowered", F.lit(WORD), F.lit(0))).alias("words"))
    spaced = F.when(F.col("phrased"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    named = split.select("doc_id", "text_key", "n_words", "anchored", "words", spaced.alias("spaced"))
    told = named.select("doc_id", "text_key", "n_words", "anchored", "words", *[F.coalesce(F.col("spaced").contains(f" {p} "), F.lit(False)).alias(f"has{k}") for k, p in enumerate(phrases)])
    pairs = F.when(F.col("anchored"), F.zip_with("words", F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)))
    paired = told.select("doc_id", "text_key", "n_words", *_places(phrases), pairs.alias("pairs"))
    tokens = sorted({token for t in templates for token in t.tokens()})
    required = sorted({r for t in templates for r in t.required})
    at = F.filter(F.transform("pairs", lambda p, i: F.when(p.isin(tokens), i)), lambda i: i.isNotNull())
    placed = paired.withColumn("at", at)
    four = lambda i: F.concat(F.col("pairs")[i], F.lit(" "), F.get("pairs", i + 2))
    found = F.transform("at", lambda i: F.struct(i.alias("at"), F.col("pairs")[i].alias("token")))
    phrased = F.filter(F.transform("at", lambda i: F.struct(i.alias("at"), four(i).alias("token"))), lambda h: F.coalesce(h["token"].isin(required), F.lit(False)))
    paired, hits = placed, F.concat(found, phrased)
    return paired.select("doc_id", "text_key", "n_words", *[f"starts{k}" for k in range(len(phrases))], F.coalesce(hits, F.array().cast("array<struct<at:int,token:string>>")).alias("hits"))


def token_order(told: DataFrame, templates: list[Template]) -> list[str]:
    """Template tokens and required phrases by their number of uses in all texts, rarest first."""
    uses = told.select(F.explode("hits.token").alias("token")).groupBy("token").count()
    counted = {r["token"]: r["count"] for r in uses.collect()}  # one row per template token at most
    return sorted({token for t in templates for token in (*t.tokens(), *t.required)}, key=lambda w: (counted.get(w, 0), w))


def prefix_index(templates: list[Template], order: list[str], threshold: float) -> list[tuple]:
    """(token, position, size, need, tokens, required, label) of each template's prefix tokens, as ranks."""
    rank, rows = {w: k for k, w in enumerate(order)}, []
    for t in templates:
        tokens = sorted({rank[w] for w in t.tokens()})
        need, required = needed(len(tokens), threshold), sorted({rank[w] for w in t.required})
        rows += [(tokens[p], p, len(tokens), need, tokens, required, t.label) for p in range(len(tokens) - need + 1)]
    return rows


def joined(told: DataFrame, templates: list[Template], threshold: float) -> DataFrame:
    """doc_id, text_key, block, label and score of every block and template that meet the threshold."""
    order = token_order(told, templates)
    named = ("token", "position", "size", "need", "tokens", "required", "label")
    literal = [F.struct(*[(F.array(*map(F.lit, v)).cast("array<int>") if isinstance(v, list) else F.lit(v)).alias(n) for n, v in zip(named, row)]) for row in prefix_index(templates, order, threshold)]
    index = told.sparkSession.range(1).select(F.inline(F.array(*literal)))
    ranks = F.create_map(*[F.lit(x) for k, w in enumerate(order) for x in (w, k)])
    window = lambda h: F.floor(h["at"] / STEP).cast("int")
    begins = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.array(window(h), window(h) - 1))))
    blocks = told.filter(F.size("hits") > 0).select("doc_id", "text_key", "hits", F.explode(begins).alias("block")).filter("block >= 0")
    inside = F.filter("hits", lambda h: (window(h) == F.col("block")) | (window(h) == F.col("block") + 1))
    held = blocks.select("doc_id", "text_key", "block", F.array_sort(F.array_distinct(F.transform(inside, lambda h: F.try_element_at(ranks, h["token"])))).alias("held"))
    shared = held.select("*", F.posexplode("held").alias("place", "token")).join(F.broadcast(index), "token")
    left = F.lit(1) + F.least(F.col("size") - F.col("position") - 1, F.size("held") - F.col("place") - 1)
    first = ~F.arrays_overlap(F.slice("held", F.lit(1), F.col("place")), F.col("tokens"))
    overlap = F.size(F.array_intersect("held", "tokens"))
    pairs = shared.filter(F.size("held") >= F.col("need")).filter(left >= F.col("need")).filter(first).withColumn("overlap", overlap).filter(F.col("overlap") >= F.col("need"))
    sure = pairs.filter(F.size(F.array_except("required", "held")) == 0)
    return sure.select("doc_id", "text_key", "block", "label", (F.col("overlap") / F.col("size")).alias("score"))


def matches(docs: DataFrame, *, templates: list[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, block, label and score of every block and template that meet the threshold."""
    return joined(runtime.materialize(read(docs, templates, {}, threshold), "hits"), templates, threshold)


def scan(docs: DataFrame, *, templates: list[Template] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: word and phrase counts, places, base labels, all labels and score."""
    told = runtime.materialize(read(docs, templates, phrases, threshold), "hits")
    found = joined(told, templates, threshold).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    every = F.concat(*[F.col(f"starts{k}") for k in range(len(phrases))])
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"starts{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]), lambda x: x.isNotNull())))
    base = told.select("doc_id", "text_key", "n_words", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"), labels.alias("base"))
    other = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "found", "best")
    joined_rows = base.join(other, base["doc_id"].eqNullSafe(other["found_id"]) & (base["text_key"] == other["found_key"]), "left")
    everything = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0)))
    return joined_rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(everything, ",").alias("labels"), score.alias("score"))
