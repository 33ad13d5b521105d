"""Licence scan: held-out phrasings, ordinary text, planted lines, odd rows."""

import random

import pytest

from lodewright.llm import license_scan as L
from lodewright.llm.license_templates import NEGATIVES, TEMPLATES

PLANTED = {"Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache"}


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_templates_and_negatives(model):
    for family, texts in TEMPLATES.items():
        for t in texts:
            assert model.of(L.words_of(t))[0] == family, t
    for t in NEGATIVES:
        assert model.of(L.words_of(t))[0] == L.UNKNOWN, t


@pytest.mark.parametrize(
    "text,family",
    [
        ("Copyright 2021 Jane Doe. Released under the MIT License, see LICENSE.", "MIT"),
        ("The data are licensed under a Creative Commons Attribution 4.0 International License", "CC-BY"),
        ("redistribution and use in source and binary forms, with or without modification, are allowed provided that the following conditions are met", "BSD"),
        ("License to kill is a film of 1989.", L.UNKNOWN),
        ("A new law on the licensing of public works was discussed.", L.UNKNOWN),
        ("", L.UNKNOWN),
    ],
)
def test_other_phrasings(model, text, family):
    assert model.of(L.words_of(text))[0] == family


def test_held_out_accuracy(model):
    rng, right, total = random.Random(5), 0, 0
    for family, texts in TEMPLATES.items():
        for t in texts:
            words = L.words_of(t)
            if len(words) >= 12:
                own = [w for w in words if rng.random() > 0.05]
                right += model.of(["intro", "words", *own, "and", "more"])[0] == family
                total += 1
    assert right >= 0.9 * total


def test_planted_lines(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows), model).collect()}
    for r in rows:
        want = sorted({f for t, f in PLANTED.items() if t in r.text})
        assert got[r.doc_id].families == ",".join(want)
        for span in got[r.doc_id].spans.split(",") if want else ():
            f, a, b = span.split(":")
            assert any(t in r.text[int(a) : int(b)] and x == f for t, x in PLANTED.items())


def test_passages_cover_every_word():
    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice(["w ", "word ", "\n", "\n\n", " "]) for _ in range(rng.randrange(900)))
        parts = L.passages(text)
        assert all(any(a <= i < b for a, b in parts) for i in range(len(text)) if text[i].isalpha())
        assert all(len(L.words_of(text[a:b])) <= L.WINDOW for a, b in parts)


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (2, ""), (None, "Released under the MIT License."), (4, "x " * 50000 + "\nReleased under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as families", "2 as _t")
    assert sorted((r.doc_id or 0, r.families) for r in L.scan(df, model).collect()) == [(0, "MIT"), (1, ""), (2, ""), (2, ""), (4, "MIT")]
    assert L.scan(df.limit(0), model).count() == 0 and L.fit(df.limit(0)) is not None
