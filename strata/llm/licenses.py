"""License scans: an exact set-similarity join of text blocks with license templates; DataFrame functions only.

A block is a run of as many consecutive words of the whole text as the template has, from one of the template's words
on; line breaks and marks between words don't matter, so a notice that is wrapped over lines is a block like any other.
Its token set is joined with the template's. A pair is in the result if the block has at least ``threshold`` of the
template's tokens (containment). Tokens are ordered by their frequency over all documents, rarest first; tokens of no
template can't be in any overlap and are left out of a block.

A template of n tokens needs k = ceil(threshold * n) of them, so any block in the result has one of the template's
first n - k + 1 tokens (its prefix). Texts without a prefix token are left at once. A block with fewer than k tokens
goes (length filter), one without a token of the prefix goes (prefix filter), and so does one in which too little
follows the first token that both have, in the block or in the template, to reach k (positional filter; as k is the
template's own it does what a prefix of the block would). The overlap of what remains is counted exactly.

Templates of one family differ in a word or two, which a containment below 1 would let go. So a template names tokens
that its block must have and tokens of its relatives that it must not, and, as sets have no order, the tokens found
must stand in the template's order for the most part: at least ``threshold`` of the neighbouring ones. These exact
checks follow the join.

Templates are few and short, which is checked, so their index is broadcast; documents are joined where they lie and
only findings move. Beside the join, base phrases are found word by word.

Defined results: a null text has no words; repeated rows (of one id and one text) get equal results; a null id is an
id; an empty table gives an empty result; texts of any length are read whole; other columns of the input don't
matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import column, let

#: Phrases and their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
GNU, CC = ("lesser", "affero", "library"), ("noncommercial", "nc", "sharealike", "sa", "noderivatives", "nd")
#: Sentences of license notices, the labels that they prove, and the tokens that they must and must not have.
TEMPLATES = (
    ("released under the MIT License", "mit", ("mit",), ()),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit", ("permission", "charge"), ()),
    ("licensed under the Apache License, Version 2.0", "apache-2", ("apache", "2"), ()),
    ("you may not use this file except in compliance with the License", "apache-2", ("compliance", "license"), ()),
    ("licensed under the GNU General Public License, version 3", "gpl-3", ("gnu", "general", "3"), GNU),
    ("licensed under the GNU General Public License, version 2", "gpl-2", ("gnu", "general", "2"), GNU),
    ("licensed under the GNU Lesser General Public License", "lgpl", ("gnu", "lesser"), ("affero",)),
    ("licensed under the GNU Affero General Public License", "agpl", ("gnu", "affero"), ("lesser",)),
    ("licensed under CC BY-NC 4.0", "cc-by-nc", ("cc", "by", "nc"), ("sa", "nd")),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc", ("creative", "attribution", "noncommercial"), ("sharealike", "noderivatives")),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by", ("creative", "attribution"), CC),
    ("licensed under CC BY 4.0", "cc-by", ("cc", "by"), CC),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa", ("creative", "attribution", "sharealike"), ("noncommercial",)),
    ("subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2", ("mozilla", "2"), ()),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd", ("redistribution", "forms"), ()),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc", ("permission", "fee"), ()),
    ("This is free and unencumbered software released into the public domain", "unlicense", ("unencumbered", "domain"), ()),
)
THRESHOLD, MAX_TEMPLATE_TOKENS = 0.85, 100_000
#: Everything but ASCII letters and digits and non-ASCII characters, of lower-cased text.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, lower-cased. Beyond A-Z this changes letters that are no part of a base phrase."""
    return F.array_remove(F.split(F.lower(text), BREAK), "")


def tokens_of(template: str) -> list[str]:
    """The token set of a template, in order of first occurrence."""
    import re

    return list(dict.fromkeys(w for w in re.split(BREAK, template.lower()) if w))


def length_of(template: str) -> int:
    """The number of words of a template, repeated ones too."""
    import re

    return sum(1 for w in re.split(BREAK, template.lower()) if w)


def phrase_places(tokens: Column, phrase: str) -> Column:
    """The word numbers, from 0, at which the phrase's words stand; texts without its last but one word are not walked."""
    parts = phrase.split()

    def places(held: Column) -> Column:
        here = lambda i: F.array(*(F.get(held, i + k) for k in range(len(parts)))) == F.array(*map(F.lit, parts))
        return F.filter(F.sequence(F.lit(0), F.size(held) - 1), here)

    has = F.array_contains(tokens, max(parts, key=lambda w: (w not in ("under", "the", "by", "version", "license"), len(w))))
    return F.when(has, places(tokens)).otherwise(F.array().cast("array<int>"))


def token_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """How often each token of the templates occurs in all documents."""
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "w string"))
    rows = docs.select(F.explode(words(F.coalesce(column(docs, text), F.lit("")))).alias("w")).join(known, "w").groupBy("w").count().collect()
    return {r[0]: r[1] for r in rows}


def judged(block: Column, t: dict[str, Column]) -> Column:
    """The overlap of a block, its tokens' ranks in text order, with a template; null if a filter or a check fails."""

    def filtered(b: Column) -> Column:
        """``b``: the block's distinct ranks, rarest first."""
        m, n = F.size(b), F.size(t["ordered"])
        common = F.array_intersect(t["prefix"], b)
        # the first of them is the first token that both have
        after = lambda first: 1 + F.least(n - F.array_position(t["ordered"], first), m - F.array_position(b, first))
        overlap = F.size(F.array_intersect(t["ordered"], b))
        enough = (m >= t["need"]) & (F.size(common) > 0) & (after(F.element_at(common, 1)) >= t["need"])
        return F.when(enough, F.when(overlap >= t["need"], overlap))

    def in_order(found: Column) -> Column:
        """Whether most neighbours among the template's tokens that are found stand one after the other in the block."""
        at = lambda i: F.array_position(block, F.element_at(found, i))
        follow = F.size(F.filter(F.sequence(F.lit(1), F.size(found) - 1), lambda i: at(i) < at(i + 1)))
        return (F.size(found) < 2) | (follow >= t["threshold"] * (F.size(found) - 1) - 1e-9)

    named = (F.size(F.array_except(t["must"], block)) == 0) & ~F.arrays_overlap(t["never"], block)
    overlap = let(F.array_sort(F.array_distinct(block)), filtered)
    # the cheapest test is first
    return F.when(named, let(overlap, lambda x: F.when(x.isNotNull(), F.when(let(F.array_intersect(t["worded"], block), in_order), x))))


def set_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, text_hash, word, label, template, containment): the best block of each text and template over the threshold.

    ``word`` is where the block begins, words counted from 0; the first of several best ones.
    """
    spark = docs.sparkSession
    sets = [(i, label, tokens_of(t), length_of(t), must, never) for i, (t, label, must, never) in enumerate(templates)]
    vocabulary = sorted({w for _, _, s, _, _, never in sets for w in (*s, *never)})
    if len(vocabulary) > MAX_TEMPLATE_TOKENS:
        raise ValueError(f"the templates have more than {MAX_TEMPLATE_TOKENS} tokens; give them in several calls")
    counts = token_counts(docs, vocabulary, text)
    vocabulary.sort(key=lambda w: (counts.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(vocabulary)}
    index = []
    for i, label, s, length, must, never in sets:
        ordered = sorted(rank[w] for w in s)
        need = math.ceil(threshold * len(ordered) - 1e-9)
        prefix, ranks = ordered[: len(ordered) - need + 1], lambda words: [rank[w] for w in words]
        index += [(r, i, label, ordered, prefix, at, need, length, ranks(must), ranks(never), ranks(s), threshold) for at, r in enumerate(prefix)]
    starts = F.array(*(F.lit(vocabulary[r - 1]) for r in sorted({x[0] for x in index})))
    schema = "r int, template int, label string, ordered array<int>, prefix array<int>, at int, need int, length int, must array<int>, never array<int>, worded array<int>, threshold double"
    index = F.broadcast(spark.createDataFrame(index, schema))
    body = F.coalesce(column(docs, text), F.lit(""))
    # words are split once, by a generator of one row, and so are the places and ranks of those of the templates
    texts = docs.select(column(docs, doc_id).alias("id"), F.xxhash64(body).alias("text_hash"), F.explode(F.array(words(body))).alias("held"))
    texts = texts.filter(F.arrays_overlap("held", starts))
    ranks = F.array(*map(F.lit, vocabulary))
    hits = F.filter(F.transform("held", lambda w, i: F.struct(i.alias("word"), F.array_position(ranks, w).cast("int").alias("r"))), lambda x: x["r"] > 0)
    texts = texts.select("id", "text_hash", F.explode(F.array(hits)).alias("hits"))
    texts = texts.select("*", F.explode(F.array(F.array_distinct(F.transform("hits", lambda x: x["r"])))).alias("own"))
    # candidates: the prefix filter over whole texts; a template is taken at the first of its prefix tokens that is there
    found = texts.select("*", F.explode("own").alias("r")).join(index, "r")
    earlier = F.slice(F.col("prefix"), F.lit(1), F.col("at"))
    found = found.filter((F.col("at") == 0) | ~F.arrays_overlap(earlier, F.col("own")))
    found = found.filter((F.size(F.array_except("must", "own")) == 0) & (F.size(F.array_intersect("ordered", "own")) >= F.col("need")))
    t = {k: F.col(k) for k in ("ordered", "prefix", "need", "must", "never", "worded", "threshold")}

    def block(i: Column) -> Column:
        first = F.element_at("hits", i)
        run = F.filter(F.slice("hits", i, F.col("length")), lambda x: x["word"] < first["word"] + F.col("length"))
        overlap = let(F.transform(run, lambda x: x["r"]), lambda ranks: judged(ranks, t))
        return let(overlap, lambda o: F.when(o.isNotNull(), F.struct(o.alias("overlap"), (-first["word"]).alias("back"))))

    places = F.filter(F.sequence(F.lit(1), F.size("hits")), lambda i: F.array_contains(F.col("ordered"), F.element_at("hits", i)["r"]))
    found = found.select("*", F.explode(F.array(F.array_max(F.transform(places, block)))).alias("best")).filter("best is not null")
    return found.select("id", "text_hash", (-F.col("best.back")).alias("word"), "label", "template", (F.col("best.overlap") / F.size("ordered")).alias("containment"))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, places by base label, matches) for each row; matches are the labels of the join with their containment."""
    body = F.coalesce(column(docs, text), F.lit(""))
    split = docs.select(column(docs, doc_id).alias("id"), F.xxhash64(body).alias("text_hash"), words(body).alias("tokens"))
    # each phrase reads the words many times: they are split once, by a generator of one row, and not for each use
    split = split.select("id", "text_hash", F.explode(F.array("tokens")).alias("tokens"))
    places = [phrase_places(F.col("tokens"), p).alias(f"at_{i}") for i, (p, _) in enumerate(BASE_PHRASES)]
    base = split.select("id", "text_hash", F.size("tokens").cast("long").alias("n_words"), *places)
    pairs = set_join(docs, doc_id, text, templates, threshold)
    best = pairs.groupBy("id", "text_hash", "label").agg(F.max("containment").alias("containment"))
    found = best.groupBy("id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("label", "containment"))).alias("matches"))
    found = found.select(F.col("id").alias("found_id"), F.col("text_hash").alias("found_hash"), "matches")
    none = F.array().cast("array<struct<label: string, containment: double>>")
    joined = base.join(found, base.id.eqNullSafe(found.found_id) & (base.text_hash == found.found_hash), "left")
    return joined.select("id", "n_words", *(f"at_{i}" for i in range(len(BASE_PHRASES))), F.coalesce("matches", none).alias("matches"))
