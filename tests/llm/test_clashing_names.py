"""Columns of the caller's that are called like the operators' own pass through every operator unchanged."""

import pytest
from pyspark.sql import functions as F

from lodewright.llm import decontaminate, html_extraction, license_scan, line_dedup, quality, secret_scan, similar_sets, simhash_near_dedup, source_mixing, suffix_dedup

NAMES = ["_d", "_n", "_th", "_t", "_k", "_s", "removed", "spans", "_html", "_draws", "c0", "c1", "key", "block", "at", "line", "size", "part", "blob", "first", "root", "fp", "set", "bands", "mark", "unit", "s", "sid", "weak_", "unused"]
ROWS = [(1, "the quick brown fox jumps over the lazy dog today\nand once more", "a"), (2, "another text of some words that nobody has seen", "b"), (2, None, None), (None, "", "b"), (4, "x", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.select(*[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES[:15]], *df.columns, *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES[15:-1]])


def unchanged(out, docs, added=()):
    own = [c for c in docs.columns]
    assert [c for c in out.columns if c not in added] == own
    for r in out.collect():
        for n in NAMES[:-1]:
            assert r[n] == f"{n}:{'-' if r['doc_id'] is None else r['doc_id']}"
    return out.count()


OPERATORS = {
    "quality": (lambda d: quality.classify(d), quality.ADDED, 5),
    "lines": (lambda d: line_dedup.dedup_lines(d, grams=True), ("n_removed",), 5),
    "lines by SimHash": (lambda d: line_dedup.dedup_lines(d), ("n_removed",), 5),
    "suffix": (lambda d: suffix_dedup.without_repeats(d), (), 5),
    "sets": (lambda d: similar_sets.keep_one(d), (), 4),
    "mix": (lambda d: source_mixing.mix(d), ("_draw", "_shard", "_place"), None),
    "simhash": (lambda d: simhash_near_dedup.keep_one(d), (), None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_pass(docs, name):
    run, added, n = OPERATORS[name]
    got = unchanged(run(docs), docs, added)
    assert n is None or got == n


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog today")], "item_id long, text string")
    out = decontaminate.contamination(docs, bench)
    assert unchanged(out, docs, decontaminate.ADDED) == 5 and [r.doc_id for r in out.where("contaminated").collect()] == [1]


def test_others_read_by_name(spark, docs):
    assert secret_scan.scan(docs).count() == license_scan.scan(docs).count() == suffix_dedup.removal_report(docs).count() == source_mixing.taken_words(docs).count() == 5
    pages = docs.withColumnRenamed("text", "html").where("doc_id = 1")
    row = html_extraction.visible_text(pages).first()
    assert row.text.startswith("the quick") and row._html == "_html:1" and row.spans == "spans:1"


def test_spelling_and_repeated_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (2, "a b", "x", "y")], "doc_id long, TEXT string, source string, other string").toDF("doc_id", "TEXT", "source", "source")
    kept = similar_sets.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 1
