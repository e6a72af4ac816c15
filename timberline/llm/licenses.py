"""License scans by diagonal voting (DataFrame functions only).

Texts and templates are cut into words and every run of ``GRAM`` words is hashed.
The rolling hashes of all texts are joined with the hashes of the templates; a
hit at word ``p`` of a text and word ``q`` of a template votes for the diagonal
``p - q``. A template that stands in a text unchanged has all its votes on one
diagonal; a word put in or left out moves the votes behind it to a neighbouring
one. So votes are gathered by diagonal, neighbouring diagonals are merged into
spans, and a span is verified by the words themselves: what counts are template
words that lie in runs of ``GRAM`` equal words, against the longer of template and
span.

Templates are of two kinds. A *phrase* counts wherever all its words stand in a
row (one full diagonal); a *notice* counts where a span scores ``MIN_SCORE``. Of
notices whose spans overlap those with the best score stay, so that a notice of one
version does not also count as that of another.

The templates are a parameter with some hundred words, so their hashes are
broadcast; texts are never shuffled. Hits are gathered by the text's digest, so
copies of a text combine before the shuffle and count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.llm.common import cut

#: Words hashed together: as many as the shortest phrase has.
GRAM = 3
#: Diagonals that are no further apart belong to one span: so many words put in or left out at one place.
SHIFT = 8
#: Votes that a diagonal of a notice needs to be merged with others.
MIN_VOTES = 2
#: Share of the longer of notice and span that must be verified words.
MIN_SCORE = 0.75
#: What separates words: ASCII but digits and letters. Letters A-Z are lower-cased before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (phrase, label): fixed values.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: (notice, label): the wording that the licenses themselves ask for; fixed values.
NOTICES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License", "apache-2"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", "gpl-3"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version", "gpl-2"),
    ("licensed under the GNU General Public License, version 3", "gpl-3"),
    ("licensed under the GNU General Public License, version 2", "gpl-2"),
    ("licensed under the GNU Lesser General Public License, version 3", "lgpl-3"),
    ("licensed under the GNU Affero General Public License, version 3", "agpl-3"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shares of one text's row in the last join.
_SALTS = 16


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none where it is null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def grams(frame: DataFrame, width: int = GRAM) -> DataFrame:
    """A row for each run of ``width`` words of the column ``words``, in its place: the other columns, pos, hash and gram."""
    runs = F.greatest(F.size("words") - width + 1, F.lit(0))
    zipped = F.arrays_zip(*[F.slice("words", k + 1, runs).alias(f"w{k}") for k in range(width)])
    rest = [c for c in frame.columns if c != "words"]
    rows = frame.select(*rest, F.posexplode_outer(zipped).alias("pos", "gram"))
    return rows.withColumn("hash", F.xxhash64(*[F.col(f"gram.w{k}") for k in range(width)]))


def templates(spark: SparkSession, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """(template, label, whole, words) of each phrase (whole) and notice; ones with fewer than ``GRAM`` words are refused."""
    given = [(text, label, whole) for whole, some in ((True, phrases), (False, notices)) for text, label in some]
    rows = [F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(whole).alias("whole"), words_of(F.lit(text)).alias("words")) for k, (text, label, whole) in enumerate(given)]
    found = spark.range(1).select(F.inline(F.array(*rows)))
    long_enough = F.when(F.size("words") >= GRAM, F.col("words")).otherwise(F.raise_error(F.lit("a template has too few words")))
    return found.withColumn("words", long_enough)


def diagonals(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(key, template, label, whole, size, diagonal, at): the places in the template whose words the text (key, words) has on this diagonal.

    ``at`` has at most as many places as the template has words.
    """
    hits = grams(known.withColumn("size", F.size("words"))).select("template", "label", "whole", "size", F.col("pos").alias("tpos"), F.col("hash").alias("thash"), F.col("gram").alias("tgram"))
    met = grams(texts).join(F.broadcast(hits), F.col("hash") == F.col("thash"))  # the templates, a parameter
    # compared here and not in the join, whose key stays the hash
    equal = F.when(F.to_json("gram") == F.to_json("tgram"), F.col("tpos"))
    return met.groupBy("key", "template", "label", "whole", "size", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.sort_array(F.collect_set(equal)).alias("at"))


def places(voted: DataFrame) -> DataFrame:
    """(key, label, base, start, end, score) of each place of a phrase: the diagonals on which all its words stand."""
    full = F.col("whole") & (F.size("at") == F.col("size") - GRAM + 1)
    start = F.col("diagonal").cast("long")
    return voted.where(full).select("key", "label", F.lit(True).alias("base"), start.alias("start"), (start + F.col("size")).alias("end"), F.lit(1.0).alias("score"))


def spans(voted: DataFrame, shift: int = SHIFT, min_votes: int = MIN_VOTES, min_score: float = MIN_SCORE) -> DataFrame:
    """(key, label, base, start, end, score) of each verified span of a notice.

    Windows run inside one text, which a row holds whole anyway.
    """
    some = voted.where(~F.col("whole") & (F.size("at") >= min_votes))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > shift).cast("int"), F.lit(0))
    some = some.withColumn("apart", apart).withColumn("span", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = some.groupBy("key", "template", "label", "size", "span").agg(
        F.min(F.col("diagonal") + F.get("at", F.lit(0))).cast("long").alias("start"),
        F.max(F.col("diagonal") + F.array_max("at") + GRAM).cast("long").alias("end"),
        F.flatten(F.collect_list("at")).alias("at"),
    )
    verified = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + GRAM - 1)))))
    scored = merged.withColumn("score", verified / F.greatest(F.col("size").cast("long"), F.col("end") - F.col("start"))).where(F.col("score") >= min_score)
    # spans that overlap form an island, of which the best stay
    inside = Window.partitionBy("key").orderBy("start", "end", "template")
    before = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    scored = scored.withColumn("opens", F.coalesce((F.col("start") >= before).cast("int"), F.lit(0)))
    scored = scored.withColumn("island", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max("score").over(Window.partitionBy("key", "island"))
    return scored.withColumn("best", best).where(F.col("score") == F.col("best")).select("key", "label", F.lit(False).alias("base"), "start", "end", "score")


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """Licenses of each row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices.

    n_base counts all places of phrases, first_word and last_word are the first
    and last of them (null if there is none); labels has the notices' labels as
    well, distinct, sorted and comma-joined; score is the best of any place or span,
    0 without one; ``notices`` lists spans of notices as label:start:end.

    Null texts count as empty; texts of any length are read whole; repeated rows
    stay; null doc_ids stay; an empty table gives an empty frame; other columns are
    ignored, whatever their names.
    """
    text = F.col("text").cast("string")
    texts = docs.select("doc_id", F.md5(F.coalesce(text, F.lit(""))).alias("key"), words_of(text).alias("words"))
    voted = cut(diagonals(texts.select("key", "words"), templates(docs.sparkSession, phrases, notices)))  # read for places and for spans
    named = F.concat_ws(":", "label", "start", "end")
    found = places(voted).unionByName(spans(voted)).groupBy("key").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.round(F.max("score"), 9).alias("score"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col("base"), F.struct("start", "end", named.alias("named")))))["named"], ",").alias("notices"),
    )
    # a third of the rows may be copies of one text: its findings are dealt into shares
    found = found.select(F.col("key").alias("_key"), *[c for c in found.columns if c != "key"], F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_share"))
    rows = texts.select("doc_id", F.size("words").cast("long").alias("n_words"), "key", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int").alias("share"))
    joined = rows.join(found, (F.col("key") == F.col("_key")) & (F.col("share") == F.col("_share")), "left")
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0), "notices": F.lit("")}
    whole = [F.coalesce(c, empty[c]).alias(c) if c in empty else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")]
    return joined.select("doc_id", "n_words", *whole)
