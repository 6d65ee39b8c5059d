"""Licence scan by a positional index of rare template words.

Native: every step is a built-in function on the row, without a shuffle or a
Python worker. Templates are short and fixed, so their index is a literal:
word -> (template, position), for the words of each template with the highest
inverse document frequency over the templates. A file's words that are in the
index vote for (template, position in file - position in template); the best
aligned vote of a template must reach ``LEAST`` of its indexed words, and its
mandatory phrase must occur as well.

Defined results: null or empty text has no words and no labels. Rows are
judged one by one, so repeated rows agree.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.llm.arrays import let, running

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
GAP = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]++"

#: Phrases that are always looked for, and their labels. Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: str


#: Public licence wording. Fixed values.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
             "files the software to deal in the software without restriction", "permission is hereby granted"),
    Template("mit", "released under the mit license", "mit license"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
             "apache license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
             "published by the free software foundation", "general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
             "conditions are met", "redistribution and use in source"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             "permission to use copy modify"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc0", "to the extent possible under law the author has dedicated all copyright to the public domain cc0 1 0 universal", "cc0"),
    Template("proprietary", "all rights reserved no part of this work may be reproduced", "all rights reserved"),
)
RARE_WORDS = 6
LEAST = 0.5


def rare_words(templates: tuple[Template, ...] = TEMPLATES, count: int = RARE_WORDS) -> list[list[tuple[str, int]]]:
    """The ``count`` words of highest IDF of each template with their positions; a repeated word keeps its first."""
    split = [t.text.split() for t in templates]
    df = Counter(w for words in split for w in set(words))
    chosen = []
    for words in split:
        first = {w: i for i, w in reversed(list(enumerate(words)))}
        ranked = sorted(first, key=lambda w: (-math.log(len(split) / df[w]), -len(w), w))
        chosen.append(sorted(((w, first[w]) for w in ranked[:count]), key=lambda x: x[1]))
    return chosen


def phrase_pattern(phrase: str) -> str:
    """A phrase as consecutive words, in any ASCII case."""
    return rf"(?<!{WORD})(?i:" + GAP.join(phrase.split(" ")) + rf")(?!{WORD})"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}++"))


def base_places(text: Column) -> Column:
    """Array of (word, label) of every base phrase, by place."""
    pattern = rf"(?<!{WORD})(?i:" + "|".join(GAP.join(p.split(" ")) for p in PHRASES) + rf")(?!{WORD})"
    heads = {p.split(" ")[0]: (len(p.split(" ")), label) for p, label in PHRASES.items()}
    by_head = F.create_map(*[x for h, (n, label) in heads.items() for x in (F.lit(h), F.struct(F.lit(n).alias("n"), F.lit(label).alias("label")))])
    kinds = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: by_head[F.lower(F.regexp_extract(m, f"^{WORD}+", 0))])

    def placed(found: Column) -> Column:
        before = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), word_count)
        ends = running(F.zip_with(before, found, lambda b, k: b + k["n"]))
        return F.zip_with(ends, found, lambda e, k: F.struct((e - k["n"]).cast("long").alias("word"), k["label"].alias("label")))

    return let(kinds, lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast("array<struct<word:bigint,label:string>>")))


def longest_run(sorted_values: Column) -> Column:
    """Length of the longest run of equal values of a sorted array."""
    start = F.struct(F.lit(None).cast("int").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, v: Column) -> Column:
        run = F.when(a["prev"] == v, a["run"] + 1).otherwise(1)
        return F.struct(v.alias("prev"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(sorted_values, start, step, lambda a: a["best"])


def scan_licences(docs: DataFrame, text: str = "text", out: str = "licences") -> DataFrame:
    """Add ``out``: struct of ``n_words``, ``places`` (base phrases), ``found`` (template label and score). A column of that name is replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    index = rare_words()
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, words in enumerate(index):
        for word, at in words:
            postings.setdefault(word, []).append((t, at))
    table = F.create_map(*[x for w, ps in sorted(postings.items()) for x in (F.lit(w), F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(at).alias("at")) for t, at in ps]))])
    words = F.filter(F.split(F.lower(body), GAP), lambda w: w != "")
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.map_contains_key(table, x["w"]))
    votes = F.flatten(F.transform(hits, lambda x: F.transform(table[x["w"]], lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["at"]).alias("d")))))

    def score_of(t: int, template: Template) -> Column:
        own = F.array_sort(F.transform(F.filter(F.col("_votes"), lambda v: v["t"] == t), lambda v: v["d"]))
        score = F.when(body.rlike(phrase_pattern(template.phrase)), longest_run(own) / len(index[t])).otherwise(0.0)
        return F.struct(F.lit(template.label).alias("label"), F.least(F.lit(1.0), score).alias("score"))

    scores = [score_of(t, template) for t, template in enumerate(TEMPLATES)]
    # A label needs its mandatory phrase, so texts without any of them have no votes to count.
    phrases = "|".join(sorted({phrase_pattern(t.phrase) for t in TEMPLATES}))
    none = F.array().cast("array<struct<t:int,d:int>>")
    voted = docs.withColumn("_votes", F.when(body.rlike(phrases), votes).otherwise(none))
    found = F.when(F.size("_votes") > 0, F.filter(F.array(*scores), lambda s: s["score"] >= LEAST)).otherwise(
        F.array().cast("array<struct<label:string,score:double>>"))
    places = F.when(body.rlike(phrases), base_places(body)).otherwise(F.array().cast("array<struct<word:bigint,label:string>>"))
    return voted.withColumn(out, F.struct(word_count(body).cast("long").alias("n_words"), places.alias("places"), found.alias("found"))).drop("_votes")


def licence_report(docs: DataFrame) -> DataFrame:
    """Counts, places and labels per document."""
    lic = scan_licences(docs.select("doc_id", "text"), out="_lic")
    places, found = F.col("_lic.places"), F.col("_lic.found")
    at = F.transform(places, lambda p: p["word"])
    base = F.transform(places, lambda p: p["label"])
    both = F.concat(base, F.transform(found, lambda f: f["label"]))
    text_of = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.coalesce(F.array_max(F.transform(found, lambda f: f["score"])), F.when(F.size(places) > 0, LEAST).otherwise(0.0))
    return lic.select("doc_id", F.col("_lic.n_words").alias("n_words"), F.size(places).cast("long").alias("n_base"),
                      F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
                      text_of(base).alias("base_labels"), text_of(both).alias("labels"), score.cast("double").alias("score"))
