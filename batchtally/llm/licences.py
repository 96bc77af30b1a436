r"""Licence scan with a positional rare-token index.

Short licence notices are the templates. A first pass over all documents counts
in how many each template word occurs; per template the words of highest IDF
form its postings (word, position). For a document the template words that it
contains are looked up; where enough words of one template are present, their
postings are intersected by relative position: an occurrence of one word fixes
the offset, and the other words must stand where the template has them. Last, the
template's mandatory phrases must stand in the text word by word.

Everything is column expressions on one row; only the document frequencies, one
row per template word, reach the driver.

Defined results
* null text has no words: zero counts, null positions, empty labels, score 0;
* rows are judged by themselves, so repeated rows get equal results;
* words of equal IDF are taken in alphabetical order;
* an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtally.llm.common import documents, let, required, text_of

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 6  # postings per template
ALIGNED = 0.8  # share of a template's postings that must stand in place

#: Base phrases and their labels; fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label: (notice, mandatory phrases). Wording of the public notices; fixed values.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license"]),
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that",
        ["redistribution and use in source and binary forms"],
    ),
    "cc-by-4.0": ("licensed under cc by 4 0", ["cc by 4 0"]),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "cc0-1.0": ("dedicated to the public domain under cc0 1 0 universal", ["cc0"]),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ["permission to use copy modify and or distribute this software"],
    ),
    "lgpl": ("licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    "mit": ("released under the mit license", ["mit license"]),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ["permission is hereby granted free of charge"],
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ["mozilla public license"],
    ),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["unencumbered software"]),
}


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def licence_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPLIT), "")


def document_frequencies(docs: DataFrame, templates: Mapping = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of documents, and for each template word the documents that hold it."""
    vocabulary = sorted({w for notice, _ in templates.values() for w in notice.split()})
    present = F.array_intersect(licence_words(text_of()), _strings(vocabulary))
    # the empty word stands in every row, so that it counts the documents
    seen = docs.select(F.explode(F.array_append(present, "")).alias("w"))
    counts = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.pop("", 0), counts


def postings(n_docs: int, counts: Mapping[str, int], templates: Mapping = TEMPLATES, rare: int = RARE) -> dict[str, list[tuple[str, int]]]:
    """Per template its rarest words with their first positions, rarest first."""
    in_templates: dict[str, int] = {}
    for notice, _ in templates.values():
        for w in set(notice.split()):
            in_templates[w] = in_templates.get(w, 0) + 1
    idf = {w: math.log((n_docs + 1) / (counts.get(w, 0) + 1)) + math.log(len(templates) / k) for w, k in in_templates.items()}
    chosen = {}
    for label, (notice, _) in templates.items():
        words = notice.split()
        best = sorted(set(words), key=lambda w: (-idf[w], w))[:rare]
        chosen[label] = [(w, words.index(w)) for w in best]
    return chosen


def _alignment(words: Column, posts: list[tuple[str, int]]) -> Column:
    """Largest share of the postings in place, over all offsets that an occurrence of a posting fixes."""
    places = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(p).alias("p")) for w, p in posts])
    in_place = lambda start: F.size(F.filter(places, lambda x: F.coalesce(F.get(words, start + x["p"]) == x["w"], F.lit(False))))
    own = _strings([w for w, _ in posts])
    starts = F.transform(
        F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(own, x["w"])),
        lambda x: x["i"] - F.element_at(F.filter(places, lambda y: y["w"] == x["w"]), 1)["p"],
    )
    best = F.array_max(F.transform(F.array_distinct(starts), in_place))
    return F.coalesce(best, F.lit(0)) / F.lit(float(len(posts)))


def _base_places(words: Column) -> Column:
    """Array of (start, label) of the base phrases."""

    def at(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in BASE.items():
            hit = F.lit(True)
            for k, w in enumerate(phrase.split()):
                hit = hit & F.coalesce(F.get(words, i + k) == w, F.lit(False))
            out = F.when(hit, F.lit(label)).otherwise(out)
        return F.struct(i.alias("start"), out.alias("label"))

    heads = _strings([p.split()[0] for p in BASE])
    firsts = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(heads, x["w"]))
    return F.filter(F.transform(firsts, lambda x: at(x["i"])), lambda x: x["label"].isNotNull())


def scan(words: Column, posts: Mapping[str, list[tuple[str, int]]], templates: Mapping = TEMPLATES) -> Column:
    """Struct of everything a document's words say."""
    vocabulary = sorted({w for p in posts.values() for w, _ in p})

    def found(w: Column) -> Column:
        padded = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))

        def of(seen: Column, joined: Column) -> Column:
            checks = []
            for label, post in posts.items():
                need = math.ceil(ALIGNED * len(post))
                present = F.size(F.array_intersect(seen, _strings([x for x, _ in post]))) >= need
                key = F.lit(True)
                for phrase in templates[label][1]:
                    key = key & F.contains(joined, F.lit(f" {phrase} "))
                share = F.when(present & key, _alignment(w, post)).otherwise(F.lit(0.0))
                checks.append(F.struct(F.lit(label).alias("label"), share.alias("share")))
            base_hit = F.lit(False)
            for phrase in BASE:
                base_hit = base_hit | F.contains(joined, F.lit(f" {phrase} "))
            none = F.array().cast("array<struct<start:int,label:string>>")
            return F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.when(base_hit, _base_places(w)).otherwise(none).alias("base"),
                F.when(F.size(seen) > 0, F.filter(F.array(*checks), lambda x: x["share"] >= ALIGNED))
                .otherwise(F.array().cast("array<struct<label:string,share:double>>"))
                .alias("hits"),
            )

        return let(padded, lambda joined: let(F.array_intersect(w, _strings(vocabulary)), lambda seen: of(seen, joined)))

    return let(words, found)


def licence_scan(docs: DataFrame, templates: Mapping = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: counts, places, labels and a score in 0 to 1."""
    required(docs, ["doc_id", "text"])
    posts = postings(*document_frequencies(docs, templates), templates)
    s = docs.select("doc_id", scan(licence_words(text_of()), posts, templates).alias("s"))
    base_labels = F.transform("s.base", lambda x: x["label"])
    own_labels = F.transform("s.hits", lambda x: x["label"])
    starts = F.transform("s.base", lambda x: x["start"].cast("bigint"))
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return s.select(
        "doc_id",
        "s.n_words",
        F.size("s.base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, own_labels)).alias("labels"),
        F.when(F.size("s.base") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(F.transform("s.hits", lambda x: x["share"])), F.lit(0.0)))
        .alias("score"),
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return licence_scan(documents(spark, sf_dir))
