"""Licence scan by a positional index of rare words.

Each licence template is indexed by its words of highest inverse document frequency, as measured over all documents, with their
places. The occurrences of these words in a file vote for (template, place of the template in the file); a place with enough votes is
a match if the template's mandatory key phrases stand in the file where it puts them. Built-in functions only.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from changelake.llm.common import narrowed, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels that every scan looks for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    """A licence notice. keys: phrases of it that have to be there; other words may differ."""

    label: str
    text: str
    keys: tuple[str, ...]


# Wording of public licence notices, or of the part of them that names the licence.
TEMPLATES = (
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
             ("permission is hereby granted free of charge", "software and associated documentation files")),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-notice", "this work is licensed under the gnu general public license version", ("gnu general public license version",)),
    Template("gpl-grant", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
             "the free software foundation", ("gnu general public license", "free software foundation")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
             ("waived all copyright and related or neighboring rights",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("permission to use copy modify and or distribute this software",)),
    Template("proprietary", "all rights reserved no part of this publication may be reproduced", ("all rights reserved", "no part of this publication may be reproduced")),
)


def words_of(text: Column) -> Column:
    """Words of a text, with A-Z in lower case and other letters as they are."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(1))


def _literal(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def document_frequency(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """Number of documents that hold each word of a short vocabulary, and of all documents."""
    held = narrowed(docs, text=text_col).select(F.array_intersect(words_of(text_or_empty()), _literal(vocabulary)).alias("held"))
    counted = held.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("word")).groupBy("word").count()
    got = {r["word"]: r["count"] for r in counted.collect()}  # one row per word of the vocabulary; '' counts documents
    return {w: got.get(w, 0) for w in vocabulary}, got.get("", 0)


def rare_index(df: dict[str, int], n: int, templates: tuple[Template, ...], rare: int) -> list[list[tuple[int, str]]]:
    """For each template its `rare` words of highest idf (later places first among equals), with their places."""
    idf = {w: math.log((1 + n) / (1 + k)) for w, k in df.items()}
    out = []
    for t in templates:
        placed = list(enumerate(t.text.split()))
        out.append(sorted(sorted(placed, key=lambda x: (-idf[x[1]], -x[0]))[:rare]))
    return out


def _stand(words: Column, start: Column, parts: list[str]) -> Column:
    """Whether the words of `parts` stand consecutively from `start`; false beyond the ends."""
    whole = F.lit(True)
    for k, w in enumerate(parts):
        whole = whole & F.coalesce(F.get(words, start + k) == w, F.lit(False))
    return whole


def _starts(words: Column, places: Column, phrase: str) -> Column:
    """Those of `places` where the words of a phrase stand consecutively."""
    return F.filter(places, lambda i: _stand(words, i, phrase.split()))


def _share(template: Template, rare: list[tuple[int, str]], share: float, words: Column, places: Column) -> Column:
    """Largest share of the rare words that stand at their places around one start, if that is enough and the keys stand too."""

    def votes(at: int, w: str) -> Column:
        return F.transform(F.filter(places, lambda i: F.get(words, i) == w), lambda i: i - at)

    starts = F.array_distinct(F.concat(*[votes(at, w) for at, w in rare]))
    hit = lambda c, at, w: F.coalesce(F.get(words, c + at) == w, F.lit(False)).cast("int")
    of = lambda c: sum((hit(c, at, w) for at, w in rare), F.lit(0)) / F.lit(float(len(rare)))
    text = template.text.split()

    def verified(c: Column) -> Column:
        ok = of(c) >= share
        for key in template.keys:
            parts = key.split()
            at = next(i for i in range(len(text)) if text[i : i + len(parts)] == parts)
            ok = ok & _stand(words, c + at, parts)
        return ok

    return F.coalesce(F.array_max(F.transform(F.filter(starts, verified), of)), F.lit(0.0))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rare: int = 5, share: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences named in every whole text.

    Returns one row per input row: doc_id; n_words; n_base (places of all base phrases), first_word and last_word (their smallest and
    largest start, or null); base_labels; labels (also the templates'), both distinct, sorted and joined by commas; score (0 to
    1: the largest share of a template's rare words found at one place, at least 0.5 if there is a base phrase, else 0).

    rare: words of highest idf a template is looked up by. share: part of them that must stand at their places. Null and empty
    texts have no words, empty labels and null places. Ties in idf go to later words. Repeated rows and null ids come back as they
    are; extra columns are ignored. One scan counts the words of the templates, a second one does the rest, without a shuffle.
    """
    vocabulary = sorted({w for t in templates for w in t.text.split()} | {w for p in PHRASES for w in p.split()})
    df, n = document_frequency(docs, vocabulary, text_col)
    index = rare_index(df, n, templates, rare)
    looked_up = _literal(sorted({w for places in index for _, w in places} | {p.split()[0] for p in PHRASES}))
    rows = narrowed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), words_of(text_or_empty()).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(looked_up, w), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "words", places.alias("places"))
    words, places = F.col("words"), F.col("places")
    base = [_starts(words, places, p).alias(f"base_{k}") for k, p in enumerate(PHRASES)]
    found = [_share(t, rare_words, share, words, places).alias(f"share_{k}") for k, (t, rare_words) in enumerate(zip(templates, index, strict=True))]
    rows = rows.select("doc_id", F.size("words").cast("bigint").alias("n_words"), *base, *found)
    starts = F.flatten(F.array(*[F.col(f"base_{i}") for i in range(len(base))]))
    named = [F.when(F.size(f"base_{i}") > 0, label) for i, label in enumerate(PHRASES.values())]
    more = [F.when(F.col(f"share_{i}") > 0, t.label) for i, t in enumerate(templates)]
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*labels), lambda x: x.isNotNull()))), ",")
    return rows.select(
        "doc_id", "n_words", F.size(starts).cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"), joined(named).alias("base_labels"), joined(named + more).alias("labels"),
        F.greatest(F.when(F.size(starts) > 0, 0.5).otherwise(0.0), *[F.col(f"share_{i}") for i in range(len(templates))]).alias("score"),
    )
