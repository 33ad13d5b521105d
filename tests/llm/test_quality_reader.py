"""Votes and scores of many texts at once against those of each text by itself."""

import random

import numpy as np
import pytest

from lodewright.llm import quality as Q


def texts(seed):
    rng = random.Random(seed)
    words = ["word", "Word", "WORD", "a", "|", "·", "!!", "what??", "end.", "#$%", "x@y", "naïve", "été", "漢字。", "1234", "A1-b", ">", "…", "ßß", " "]
    out = ["", " ", "\n\t", "one", "a a", "a a a", "!!" * 50]
    for _ in range(300):
        own = rng.sample(words, rng.randrange(1, len(words)))
        out.append(rng.choice((" ", "\n", "  ")).join(rng.choice(own) for _ in range(rng.choice((1, 2, 3, 19, 20, 60, 399, 400, 900)))))
    return out


@pytest.mark.parametrize("most,chunk", [(100_000, 1 << 20), (5, 300)])
def test_reader(most, chunk):
    rng = np.random.default_rng(3)
    found = Q.estimate({"+++++++++": 50, "---0-0-00": 9, "+0+0+0+0+": 20})
    model = Q.Scorer(found, rng.standard_normal(Q.BUCKETS + 1))
    reader = Q.Reader(model)
    reader.MOST, reader.CHUNK = most, chunk
    own = texts(1)
    got = reader.read(own)
    assert got["votes"] == [Q.votes(t) for t in own]
    assert got["weak"] == [found.posterior(Q.votes(t)) for t in own]
    assert np.allclose(got["score"], [model.score(t) for t in own], atol=2e-6)
    assert Q.Reader().read(own) == {"votes": got["votes"], "weak": [], "score": []}


def test_whole_operator(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = Q.fit(docs)
    got = {r.doc_id: r for r in Q.scored(docs, model).collect()}
    for r in docs.collect():
        row = got[r.doc_id]
        assert (row.votes, row.text, row.source) == (Q.votes(r.text or ""), r.text, r.source)
        assert row.weak == model.labelling.posterior(row.votes) and row.score == pytest.approx(model.score(r.text or ""), abs=2e-6) and row.keep == (row.score >= 0.5)


def test_models_of_other_tables_are_forgotten(spark):
    """Workers that have scored one table score the next one by its own model."""
    one = spark.createDataFrame([(i, f"word{i} the quick brown fox" if i % 3 else "!!! ### !!! @@@ !!! %%%") for i in range(64)], "doc_id long, text string").repartition(16)
    assert Q.classify(one).count() == 64 and len(Q.classify(one).collect()) == 64
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(16)
    model = Q.fit(docs)
    for r in Q.scored(docs, model).collect():
        if (r.text or "").strip():
            assert r.score == pytest.approx(model.score(r.text), abs=2e-6)
