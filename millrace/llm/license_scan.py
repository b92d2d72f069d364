"""License scans by diagonal voting, with DataFrame functions only.

All rolling word k-gram hashes of a text are joined with the k-gram hashes of template positions. A hit votes for the diagonal (word position in
the text less position in the template). Votes are counted by diagonal, neighbouring diagonals of one template are merged to a passage (words put in or
left out move what follows to a diagonal nearby), and each passage is verified: of all windows over it that are as long as the template and a
quarter more, the one in which the passage's k-grams cover the most words of the template is its span, and that share is its score. So stray
hits that join a passage, however many, take nothing from it. A template of few words must stand as it is, on one diagonal.

The templates are the operator's own fixed table, of bounded size, so that side of the join is broadcast; the k-grams of the corpus are never
shuffled, only hits are. Hits are keyed by the digest of the text, so copies of a text, and rows without doc_id, need no row number: a group
of copies of any size adds one set of hits per task before the shuffle; when results are joined back, its rows are dealt over salts.

Cases: a null text counts as empty (no words, no labels, score 0). Repeated rows each get the result of their text; a null doc_id is
returned as null. An empty table gives an empty result. Extra columns are ignored. A text is read whole, however long.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import shared

#: Words: digits, a-z after lower-casing A-Z, and all that is not ASCII. The pattern takes A-Z too, so that cutting comes before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 2
#: Phrases with their labels, each of which counts where its words stand consecutively. Fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Longer wordings, of which a share is enough.
WORDINGS = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Share of a wording's words that must be verified; a wording of few words must stand as it is, as one word makes another license of it.
LEAST, FEW = 0.8, 8
#: Diagonals this close together are neighbours; a window is longer than its template by one part in SPARE.
NEAR, SPARE = 3, 4


def templates() -> list[tuple[int, list[str], str, bool]]:
    """(number, words, label, exact) of each template."""
    own = [(t, label, True) for t, label in PHRASES] + [(t, label, False) for t, label in WORDINGS]
    return [(i, t.split(), label, exact) for i, (t, label, exact) in enumerate(own)]


def words_of(text: Column) -> Column:
    """The words of a text, still in their own case."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _digest(text: Column) -> list[Column]:
    """Two 64-bit digests and the length: what tells texts apart."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("d1"), F.xxhash64(F.lit("millrace"), t).alias("d2"), F.octet_length(t).alias("d3")]


def hits(docs: DataFrame) -> DataFrame:
    """(d1, d2, d3, template, pos, at): word position pos of a text starts the k-gram at position `at` of a template. Distinct, so that
    copies of a text give one set."""
    spark = docs.sparkSession
    grams = [(i, at, w[at], w[at + 1]) for i, w, _, _ in templates() for at in range(len(w) - K + 1)]
    table = spark.createDataFrame(grams, "template int, at int, w0 string, w1 string").withColumn("h", F.xxhash64("w0", "w1"))
    # lower() is meant for A-Z alone: of all else, only the Kelvin sign would become a letter that templates have, so it is taken out of the way.
    cut = docs.select(*_digest(F.col("text")), words_of(F.lower(F.replace("text", F.lit("\u212a"), F.lit("\u00ff")))).alias("words"))
    shifted = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    rolled = cut.select("d1", "d2", "d3", F.posexplode(F.arrays_zip(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))).alias("a"), shifted.alias("b"))).alias("pos", "g"))
    joined = rolled.withColumn("h", F.xxhash64("g.a", "g.b")).join(F.broadcast(table), "h")
    # Equal hashes are not yet equal words.
    true = joined.where((F.col("g.a") == F.col("w0")) & (F.col("g.b") == F.col("w1")))
    return true.select("d1", "d2", "d3", "template", "pos", "at").distinct()


def _window(words: int) -> int:
    return words + words // SPARE


def spans(found: DataFrame) -> DataFrame:
    """(d1, d2, d3, template, first, last, share): places of templates, from hits. Votes are counted by diagonal; then the diagonals of one
    template that are neighbours are merged, and the best window of each passage is verified."""
    spark = found.sparkSession
    key = ["d1", "d2", "d3", "template"]
    # hits: the most that a window can hold, as a word position starts as many k-grams of a template as are equal.
    facts = [(i, len(w), exact, exact or len(w) <= FEW, _window(len(w)), _window(len(w)) * max(Counter(zip(w, w[1:], strict=False)).values())) for i, w, _, exact in templates()]
    size = spark.createDataFrame(facts, "template int, size int, exact boolean, strict boolean, window int, hits int")
    votes = found.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.array_sort(F.collect_list("at")).alias("ats"))
    votes = votes.join(F.broadcast(size), "template")  # a diagonal has one place per template position at most
    w = Window.partitionBy(*key).orderBy("diagonal")
    # A new passage begins where the next diagonal is further off than neighbours are; what must stand as it is stays by itself.
    fresh = F.when(F.col("strict") | (F.col("diagonal") - F.lag("diagonal").over(w) > NEAR), 1).otherwise(0)
    merged = votes.withColumn("passage", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.transform("ats", lambda a: F.struct((F.col("diagonal") + a).alias("pos"), a.alias("at")))
    passages = merged.groupBy(*key, "size", "exact", "strict", "window", "hits", "passage").agg(F.array_sort(F.flatten(F.collect_list(rows))).alias("p"))
    covered = lambda p: F.size(F.array_distinct(F.flatten(F.transform(p, lambda x: F.sequence(x["at"], x["at"] + K - 1)))))
    # No window covers more than its passage does.
    enough = lambda n: F.when(F.col("strict"), n == F.col("size")).otherwise(n >= LEAST * F.col("size"))
    passages = passages.where(enough(covered(F.col("p"))))

    def verified(x: Column, i: Column) -> Column:
        inside = F.filter(F.slice("p", i + 1, F.col("hits")), lambda y: y["pos"] <= x["pos"] + F.col("window") - K)
        return F.struct(covered(inside).alias("n"), (-x["pos"]).alias("less"), (F.array_max(F.transform(inside, lambda y: y["pos"])) + K - 1).alias("last"))

    best = passages.withColumn("best", F.array_max(F.transform("p", verified))).where(enough(F.col("best.n")))
    return best.select(*key, (-F.col("best.less")).cast("long").alias("first"), F.col("best.last").cast("long").alias("last"), (F.col("best.n") / F.col("size")).alias("share"), "exact")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row. score: the best share of a template's words."""
    spark = docs.sparkSession
    label = spark.createDataFrame([(i, name) for i, _, name, _ in templates()], "template int, label string")
    d = ["d1", "d2", "d3"]
    placed = spans(hits(docs)).join(F.broadcast(label), "template")
    base = F.col("exact")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_text = placed.groupBy(*d).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("share").alias("score"),
    )
    rows = shared.written(docs.select("doc_id", *_digest(F.col("text")), F.size(words_of(F.col("text"))).cast("long").alias("n_words")), "words")
    out = shared.Dealt(rows, d).join(by_text, "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
