"""License scans: a positional index of templates by rare words, all in DataFrame functions.

Texts are read by regular expressions made from the templates' words; only files that hold a rare word of some
template are split into words, and there the postings of several rare words must agree on where a template starts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactrix.llm.quality_rules import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What the same words are made of before A-Z are lowered; as ranges that belong, for Java tries those ten times as fast.
RAW_WORD_CHAR = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
RAW_WORD = RAW_WORD_CHAR + "+"

#: Phrases whose places count, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: label, wording, and the phrase in it that must stand there word for word.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "may not use this file except in compliance"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("proprietary", "copyright all rights reserved", "all rights reserved"),
    ("spdx", "spdx license identifier", "spdx license identifier"),
)
#: Least weighted share of a template's words that must stand in place for its label.
MIN_SCORE = 0.6
#: Rare words of its phrase that a template is posted under (all of them, if the phrase has fewer).
POSTED = 3


def templates() -> list[dict]:
    """All templates: base phrases first, then wordings with the place of their phrase."""
    out = [{"label": label, "base": True, "words": p.split(), "phrase": p.split(), "at": 0} for p, label in BASE]
    for label, wording, phrase in TEMPLATES:
        w, p = wording.split(), phrase.split()
        out.append({"label": label, "base": False, "words": w, "phrase": p, "at": next(i for i in range(len(w)) if w[i : i + len(p)] == p)})
    return out


VOCABULARY = sorted({w for t in templates() for w in t["words"]})


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RAW_WORD), F.lit(0)), lambda w: F.translate(w, UPPER, LOWER))


def any_of(words_: list[str]) -> str:
    """A pattern of whole words, A-Z as a-z, as a tree of their letters, so that each letter of a text is looked at once."""

    def tree(rest: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for w in rest:
            if w:
                by.setdefault(w[0], []).append(w[1:])
        inner = "|".join(c + tree(r) for c, r in sorted(by.items()))
        return "" if not inner else f"(?:{inner})?" if "" in rest else f"(?:{inner})"

    return rf"(?i)(?<!{RAW_WORD_CHAR}){tree(sorted(set(words_)))}(?!{RAW_WORD_CHAR})"


def word_weights(docs: DataFrame) -> dict[str, int]:
    """IDF of each template word over all documents, in thousandths, at least 1. One row a template word is collected."""
    held = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(any_of(VOCABULARY)), F.lit(0)), F.lower))
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w"))
    df = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = df.get("", 0)
    return {w: max(1, math.floor(1000 * math.log((n + 1.0) / (df.get(w, 0) + 1.0)))) for w in VOCABULARY}


def _strings(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def scan(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """docs with ``license_words``, the number of words, and ``license_hits`` of (label, base, start, score), verified.

    Each template is posted under the rarest words of its phrase (``POSTED``; the phrase must stand in any file that
    gets the label). A file's posted words give (template, start); where all of a template's posted words agree on a
    start it is a candidate, which stays if the whole phrase stands at its place, and scores the weighted share of
    the template's words that stand at their relative positions. Null text: no words.
    """
    weights = weights or word_weights(docs)
    ts = templates()
    posted: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(ts):
        rare = sorted(range(len(t["phrase"])), key=lambda j: (-weights[t["phrase"][j]], j))[:POSTED]
        t["n_posted"], t["rarest"] = len(rare), t["phrase"][rare[0]]
        for j in rare:
            posted.setdefault(t["phrase"][j], []).append((k, j))
    postings = F.create_map(*[x for w, ps in posted.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("t"), F.lit(j).alias("j")) for k, j in ps]))])
    table = F.array(*[F.struct(
        F.lit(t["label"]).alias("label"), F.lit(t["base"]).alias("base"), F.lit(t["at"]).alias("at"), F.lit(t["n_posted"]).alias("n_posted"), _strings(t["phrase"]).alias("phrase"), _strings(t["words"]).alias("words"),
        F.array(*[F.lit(weights[w]).cast("long") for w in t["words"]]).alias("weights"), F.lit(sum(weights[w] for w in t["words"])).cast("long").alias("total"),
    ) for t in ts])

    def hits(w: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(sorted(posted)))
        said = F.array_sort(F.flatten(F.transform(places, lambda i: F.transform(postings[F.get(w, i)], lambda p: F.struct(p["t"].alias("t"), (i - p["j"]).alias("start"))))))
        # equal pairs stand together: a candidate begins a run as long as its template has posted words
        agreed = lambda s: F.filter(s, lambda c, k: ((k == 0) | (F.get(s, k - 1) != c)) & F.coalesce(F.get(s, k + F.get(table, c["t"])["n_posted"] - 1) == c, F.lit(False)))
        in_place = lambda c: let(F.get(table, c["t"]), lambda t: (c["start"] >= 0) & (F.slice(w, F.greatest(c["start"], F.lit(0)) + 1, F.size(t["phrase"])) == t["phrase"]))
        weight = lambda t, at: F.aggregate(F.transform(t["words"], lambda x, j: F.when(F.get(w, at + j) == x, F.get(t["weights"], j)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
        judged = lambda c: let(F.get(table, c["t"]), lambda t: F.struct(t["label"].alias("label"), t["base"].alias("base"), c["start"].cast("long").alias("start"), (weight(t, c["start"] - t["at"]) / t["total"]).alias("score")))
        return F.filter(F.transform(F.filter(let(said, agreed), in_place), judged), lambda h: h["base"] | (h["score"] >= MIN_SCORE))

    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,score:double>>")
    some = F.when(text.rlike(any_of(sorted({t["rarest"] for t in ts}))), let(words(text), hits)).otherwise(none)
    # two columns, no struct: a field of a struct would be worked out anew wherever it is read
    return docs.withColumns({"license_words": F.regexp_count(text, F.lit(RAW_WORD)).cast("long"), "license_hits": some})


def report(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (0 where nothing is found).

    Null and empty texts: no words and no labels (empty strings). Repeated rows repeat. Only doc_id and text are read.
    """
    out = scan(docs.select("doc_id", "text"), weights)
    hits = F.col("license_hits")
    base = F.transform(F.filter(hits, lambda h: h["base"]), lambda h: h["start"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda h: h["label"]))), ",")
    return out.select(
        "doc_id", F.col("license_words").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        names(F.filter(hits, lambda h: h["base"])).alias("base_labels"), names(hits).alias("labels"), F.coalesce(F.array_max(F.transform(hits, lambda h: h["score"])), F.lit(0.0)).alias("score"),
    )
