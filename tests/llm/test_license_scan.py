"""License scan against a search word by word."""

import re

from stocklens.llm.license_scan import COVERAGE, TEMPLATES, anchors, document_frequency, scan_licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(texts):
    vocabulary = {w for t in TEMPLATES for w in t.words}
    frequency = {v: sum(v in set(words_of(t)) for t in texts) for v in vocabulary}
    at, out = anchors(frequency), []
    for text in texts:
        w, base, base_labels, labels, best = words_of(text), [], set(), set(), 0.0
        for t, a in zip(TEMPLATES, at):
            for i in [p - a for p, x in enumerate(w) if x == t.words[a]]:
                fits = [0 <= i + j < len(w) and w[i + j] == x for j, x in enumerate(t.words)]
                best = max(best, sum(fits) / len(fits))
                if all(fits[j] for j in t.key_places):
                    if sum(fits) / len(fits) >= COVERAGE:
                        labels.add(t.label)
                    if t.base:
                        base.append(i)
                        base_labels.add(t.label)
        out.append((len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)),
                    ",".join(sorted(labels)), best))
    return out


def got(df):
    return [tuple(r)[1:8] for r in scan_licenses(df).collect()]


def test_planted_notices(spark):
    texts = ["Released under the MIT License.", "mit mit license MIT-License", "GNU General Public License v3, gnu general public",
             "Apache License 2.0; CC BY 4.0 and CC-BY-SA", "cc\nby\tsa", "this is free and unencumbered software", "mit der lizenz",
             "Redistribution and use in source and binary forms, with or without modification", "license apache", "by cc by",
             "subject to terms of the mozilla public license", "ccby", "mit ÀLICENSE", "All rights reserved.", "", None, "MIT", "license",
             "Permission is hereby granted, free of charge, to any person", "gnu general gnu general public license"] + ["apache license "] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert got(df) == brute(texts)


def test_fixture(docs, rows):
    assert sorted(map(str, got(docs))) == sorted(map(str, brute([r["text"] for r in rows])))


def test_odd_rows_and_empty_table(odd, empty):
    assert sorted(map(str, got(odd))) == sorted(map(str, brute([r["text"] for r in odd.collect()])))
    assert scan_licenses(empty).collect() == []


def test_rarest_word_is_the_anchor(spark):
    df = spark.createDataFrame([(1, "mit mit"), (2, "mit"), (3, "license")], "doc_id long, text string")
    frequency = document_frequency(df)
    mit = next(k for k, t in enumerate(TEMPLATES) if t.key == "mit license")
    assert frequency["mit"] == 2 and frequency["license"] == 1 and anchors(frequency)[mit] == 1


def test_no_python_and_no_shuffle_of_texts(docs):
    plan = scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
