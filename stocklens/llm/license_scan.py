"""License scan: a positional index of rare licence words.

Each template is a short notice with a key phrase that must stand in it word by word. The words of all
templates are weighed by their inverse document frequency over the documents. The rarest word of a key
phrase is its template's anchor: a place of the anchor in a file proposes a place of the whole template,
and the other words are looked up at their positions relative to it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.text import lower_az, whole

# A word: digits, a-z and everything beyond ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice, the label it stands for and its key phrase; ``base``: one of the four plain phrases."""

    label: str
    notice: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def key_places(self) -> range:
        words, key = self.words, self.key.split()
        start = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        return range(start, start + len(key))


# Labels and wording of licence notices.
TEMPLATES = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
    Template("agpl", "gnu affero general public license", "gnu affero general public license"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("gpl", "gnu gpl", "gnu gpl"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("epl", "under the terms of the eclipse public license", "eclipse public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("bsd", "bsd license", "bsd license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("isc", "isc license", "isc license"),
    Template("cc-by-sa", "cc by sa", "cc by sa"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
    Template("cc-by", "creative commons attribution", "creative commons attribution"),
    Template("cc0", "creative commons zero", "creative commons zero"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
    Template("proprietary", "all rights reserved", "all rights reserved"),
)
# Share of a notice's words that must stand in their places beside the key phrase.
COVERAGE = 0.5


def license_words(text: str) -> Column:
    return F.regexp_extract_all(lower_az(whole(text)), F.lit(LICENSE_WORD), F.lit(0))


def document_frequency(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[str, int]:
    """Number of documents that hold each word of the templates (a few hundred words at most)."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = docs.select(F.explode(F.array_intersect(
        license_words(text_col), F.array(*map(F.lit, vocabulary)))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in found.collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def anchors(frequency: dict[str, int], templates=TEMPLATES) -> list[int]:
    """Place of the rarest word of each template's key phrase (of equally rare ones the first)."""
    return [min(t.key_places, key=lambda i: (frequency[t.words[i]], i)) for t in templates]


def _alignments(words: Column, present: Column, k: int, template: Template, anchor: int) -> Column:
    """Places of a template that its anchor proposes, with the words that stand there."""
    size = len(template.words)
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == template.words[anchor], i - anchor)),
                      lambda x: x.isNotNull())

    def look(start: Column) -> Column:
        fits = [F.coalesce(F.get(words, start + j) == w, F.lit(False)) for j, w in enumerate(template.words)]
        key = reduce(Column.__and__, [fits[j] for j in template.key_places])
        hits = reduce(Column.__add__, [f.cast("int") for f in fits])
        return F.struct(F.lit(k).alias("template"), (start + template.key_places[0]).cast("bigint").alias("place"),
                        (hits / F.lit(float(size))).alias("coverage"), key.alias("key"))

    none = F.array().cast("array<struct<template:int,place:bigint,coverage:double,key:boolean>>")
    return F.when(F.array_contains(present, template.words[anchor]), F.transform(starts, look)).otherwise(none)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
                  coverage: float = COVERAGE) -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, alignments`` per row.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are the smallest and
    largest of their starts, in words from 0, or null. ``labels`` also has those of other templates whose
    key phrase is complete and whose notice is covered to ``coverage``. ``score`` is the best coverage of
    any proposed place. ``alignments`` lists all proposed places.

    Null text counts as empty: no words, no labels, score 0. Rows are independent, so repeated ids, null
    ids and repeated rows come out as they went in; an empty table gives an empty result; other columns
    are not read. Two scans without a shuffle of texts: word frequencies, then the places.
    """
    at = anchors(document_frequency(docs, text_col, templates), templates)
    names = sorted({t.words[a] for t, a in zip(templates, at)})
    rows = docs.select(F.col(id_col), license_words(text_col).alias("_words")).withColumn(
        "_present", F.array_intersect("_words", F.array(*map(F.lit, names))))
    found = F.when(F.size("_present") == 0, F.array().cast(
        "array<struct<template:int,place:bigint,coverage:double,key:boolean>>")).otherwise(F.concat(*[
            _alignments(F.col("_words"), F.col("_present"), k, t, a) for k, (t, a) in enumerate(zip(templates, at))]))
    rows = rows.select(id_col, F.size("_words").cast("bigint").alias("n_words"), found.alias("alignments"))
    base = [k for k, t in enumerate(templates) if t.base]
    label = F.array(*[F.lit(t.label) for t in templates])
    rows = rows.withColumn("_base", F.filter("alignments", lambda x: x["key"] & x["template"].isin(base)))
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(
        hits, lambda x: F.get(label, x["template"])))), ",")
    return rows.select(
        id_col, "n_words", F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["place"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["place"])).alias("last_word"),
        joined(F.col("_base")).alias("base_labels"),
        joined(F.filter("alignments", lambda x: x["key"] & (x["coverage"] >= coverage))).alias("labels"),
        F.coalesce(F.array_max(F.transform("alignments", lambda x: x["coverage"])), F.lit(0.0)).alias("score"),
        "alignments")
