"""Licence scans with a positional rare-token index, in DataFrame expressions only.

The index holds, for each licence word, its postings: the templates it occurs in and
its place there. A first pass counts over all texts in how many each licence word
occurs (at most one row per vocabulary word reaches the driver). Of every template the
two key-phrase words of highest IDF are the ones that are looked up in a file; each
found word proposes starts (its position minus its place in the template), the two
lists of starts are intersected, and what survives is verified word by word against
all mandatory key phrases at their places. A file that holds all key phrases holds
both looked-up words, so the lookup loses no match.

All work on a file happens in its own row: nothing shuffles but the word counts.

Words: A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. The weight of a
word is its IDF in whole bits, the number of binary digits of ``N div (df + 1)``. The
score of a file is the largest share of a template's weight that stands at the aligned
places around a verified match; 0 without one.

Defined cases: a null or empty text has no words, no labels and score 0; rows are kept
as they are (null ids, repeated rows); overlapping places all count; texts of any
length are read whole; an empty table gives an empty result. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands between words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """Words of a licence notice; ``keys`` are phrases of it that must stand at their places."""
    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    def __post_init__(self) -> None:
        if not re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", self.text) or "'" in self.label:
            raise ValueError(f"template {self.label!r} is not made of lower-case ASCII words")

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def key_places(self) -> list[tuple[int, list[str]]]:
        words, out = self.words, []
        for key in self.keys:
            k = key.split()
            at = [i for i in range(len(words) - len(k) + 1) if words[i:i + len(k)] == k]
            if not at:
                raise ValueError(f"key phrase {key!r} is not in template {self.label!r}")
            out.append((at[0], k))
        return out


# The contract's phrases and labels.
BASE = (
    Template("cc-by", "cc by", ("cc by",), base=True),
    Template("gpl", "general public license", ("general public license",), base=True),
    Template("reserved", "all rights reserved", ("all rights reserved",), base=True),
)
# Notices of common licences as their texts word them.
NOTICES = (
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3",
             ("affero general public license", "version 3")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are"
             " permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms", "with or without modification")),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2",
             ("gnu general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3",
             ("gnu general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license version",
             ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this"
             " software and associated documentation files",
             ("permission is hereby granted free of charge", "associated documentation files")),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license", "2 0")),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
)
TEMPLATES = BASE + NOTICES


def file_words(text: Column) -> Column:
    """Words of a text; null has none.

    ``lower`` is several times as fast as ``translate`` and gives the same ASCII words
    unless the text has one of the two other characters whose lower case is ASCII.
    Words with other characters may differ in case; no licence word has any.
    """
    text = F.coalesce(text, F.lit(""))
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    lower = F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(lower, GAP), "")


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def word_weights(files: DataFrame, templates: Sequence[Template]) -> dict[str, int]:
    """IDF in whole bits of every licence word, over all files (column ``words``)."""
    vocab = vocabulary(templates)
    # The empty word, which no text has, stands for every file.
    present = F.concat(F.array(F.lit("")), F.array_intersect("words", F.array(*map(F.lit, vocab))))
    counts = dict(files.select(F.explode(present).alias("w")).groupBy("w").count().collect())
    total = counts.get("", 0)
    return {w: len(f"{total // (counts.get(w, 0) + 1):b}") for w in vocab}


def rare_words(template: Template, weights: dict[str, int]) -> list[tuple[str, int]]:
    """The two key-phrase words of highest IDF and their places in the template."""
    places: dict[str, int] = {}
    for at, key in template.key_places():
        for k, w in enumerate(key):
            places.setdefault(w, at + k)
    best = sorted(places, key=lambda w: (-weights[w], w))
    return [(w, places[w]) for w in (best[0], best[min(1, len(best) - 1)])]


def _index(templates: Sequence[Template], weights: dict[str, int]) -> Column:
    """The templates with their postings as one literal array."""
    def words(ws: Sequence[str]) -> str:
        return "array(" + ", ".join(f"'{w}'" for w in ws) + ")"

    def entry(t: Template) -> str:
        (w1, o1), (w2, o2) = rare_words(t, weights)
        keys = ", ".join(f"struct({at} AS at, {words(k)} AS words)" for at, k in t.key_places())
        whole = ", ".join(f"struct({i} AS at, '{w}' AS w, {weights[w]} AS weight)" for i, w in enumerate(t.words))
        return (f"struct('{t.label}' AS label, {t.base} AS base, '{w1}' AS w1, {o1} AS o1, '{w2}' AS w2,"
                f" {o2} AS o2, array({keys}) AS keys, array({whole}) AS words,"
                f" {sum(weights[w] for w in t.words)} AS total)")

    return F.expr("array(" + ", ".join(map(entry, templates)) + ")")


def _places(t: Column) -> Column:
    """Verified places of one template in the row's file: start and share of its weight."""
    words, hits = F.col("words"), F.col("hits")

    def starts(word: Column, offset: Column) -> Column:
        return F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["i"] - offset)

    def verified(s: Column) -> Column:
        return F.forall(t["keys"], lambda k: F.when(
            s + k["at"] >= 0,
            F.slice(words, s + k["at"] + 1, F.size(k["words"])) == k["words"]).otherwise(False))

    def share(s: Column) -> Column:
        found = F.aggregate(t["words"], F.lit(0), lambda a, x: a + F.when(
            F.get(words, s + x["at"]) == x["w"], x["weight"]).otherwise(0))
        return found / t["total"]

    common = F.array_intersect(starts(t["w1"], t["o1"]), starts(t["w2"], t["o2"]))
    return F.transform(F.filter(common, verified), lambda s: F.struct(
        t["label"].alias("label"), t["base"].alias("base"), s.cast("long").alias("start"),
        share(s).alias("share")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """``id_col``, ``n_words`` and ``places`` (label, base, start, share) of every file."""
    files = docs.select(F.col(id_col).alias("id"), file_words(F.col(text_col)).alias("words"))
    weights = word_weights(files, templates)
    rare = sorted({w for t in templates for w, _ in rare_words(t, weights)})
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))),
                    lambda h: h["w"].isin(rare))
    looked = files.select("id", "words", F.when(
        F.arrays_overlap("words", F.array(*map(F.lit, rare))), hits).alias("hits"))
    places = F.flatten(F.transform(_index(templates, weights), _places))
    found = looked.select("id", F.size("words").cast("long").alias("n_words"),
                          F.when(F.size("hits") > 0, places).alias("places"))
    empty = F.array().cast("array<struct<label:string,base:boolean,start:long,share:double>>")
    return found.select(F.col("id").alias(id_col), "n_words", F.coalesce("places", empty).alias("places"))


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per file: counts and span of base places, distinct sorted labels, and the score."""
    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    return found.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))
