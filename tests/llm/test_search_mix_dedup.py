"""Brute-force versions of exact search, mixing, suffix deduplication and SimHash components."""

import hashlib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from lodewright.llm import simhash_near_dedup, source_mixing, suffix_array, suffix_dedup, topk_search
from lodewright.llm.common import connected

SF = "/root/testdata/sf0.01"


def docs_frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if extra:
        from pyspark.sql import functions as F

        for c in ("_x", "fp", "mark", "size", "node", "key", "n"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_fp(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            up[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, *_) in enumerate(rows)), key=str)


def test_simhash_components_sf(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = simhash_near_dedup.near_duplicates(df).select("doc_id", simhash_near_dedup.hex_digits(), "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)


def test_simhash_edges(spark):
    rows = [(3, None, "a"), (1, "", "a"), (2, " \t\n", None), (7, "one", "b"), (7, "one", "b"), (5, "One", "b"), (None, "two words", None), (9, "two words", "x"), (11, "word " * 30000, "x")]
    got = simhash_near_dedup.near_duplicates(docs_frame(spark, rows, True)).select("doc_id", simhash_near_dedup.hex_digits(), "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)
    assert simhash_near_dedup.near_duplicates(docs_frame(spark, [])).count() == 0
    kept = simhash_near_dedup.keep_one(docs_frame(spark, rows, True))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 9, 11]


def test_links_equal_all_pairs(spark):
    from lodewright.llm.hamming import links, ring, within

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(30)} | {rng.getrandbits(64) for _ in range(300)}
    vals = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame(pd.DataFrame({"fp": vals.view(np.int64)}))
    up = {int(v): int(v) for v in vals}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(up, 2):
        if (a ^ b).bit_count() <= 3:
            up[find(a)] = find(b)
    want = {}
    for v in up:
        want.setdefault(find(v), set()).add(v)
    for tile, test in ((8192, ring), (7, ring), (8192, within)):
        got = {}
        for r in connected(links(df, 3, test, tile)).collect():
            got.setdefault(r.root, set()).add(int(np.array(r.node).astype(np.int64).view(np.uint64)))
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_connected(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (5, 5)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc\x00\xff"])
def test_suffix_array(alphabet):
    rng = random.Random(len(alphabet))
    for n in (0, 1, 2, 7, 60, 400):
        t = bytes(rng.choice(alphabet) for _ in range(n))
        got = suffix_array.suffix_array(t, 500).tolist()
        assert got == sorted(range(n), key=lambda i: t[i:])


def brute_removed(texts, length=200):
    texts = [(t or "").encode() for t in texts]
    seen = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - length + 1):
            seen.setdefault(t[j : j + length], []).append((i, j))
    hit = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                hit[i][j : j + length] = b"\1" * length
    out = []
    for t, h in zip(texts, hit):
        runs = sum(1 for i in range(len(h)) if h[i] and (i == 0 or not h[i - 1]))
        out.append((len(t), sum(h), runs, hashlib.sha256(bytes(b for b, x in zip(t, h) if not x)).hexdigest()))
    return out


def repeats_fixture():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, short = prose(60), prose(25)
    doc = prose(200)
    words = doc.split()
    rows = [doc, doc, " ".join(words[:90] + ["changed"] + words[91:]), prose(30) + passage + prose(20), passage, prose(9) + passage[:230] + prose(9), prose(50) + short + prose(40), short + prose(90)]
    rows += ["thed " * 150, "x" * 2000 + prose(10), prose(40) + "x" * 300, None, "", "tiny", prose(700) + passage[60:] + prose(5)]
    rows += [f"{i}" + prose(2) + passage[40:] + prose(3) for i in range(30)] + [prose(100) for _ in range(10)]
    return rows


@pytest.mark.parametrize("most", [2000, 5])
def test_suffix_dedup_brute(spark, most):
    texts = repeats_fixture()
    want = brute_removed(texts)
    df = docs_frame(spark, [(i, t, "s") for i, t in enumerate(texts)], True)
    real, suffix_dedup.MOST_UNITS = suffix_dedup.MOST_UNITS, most
    try:
        spans = suffix_dedup.repeated_spans(df, most_units=most)
        assert spans.count() == sum(1 for w in want if w[1])
        if most == 2000:
            got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removal_report(df).collect()}
            assert [got[i] for i in range(len(texts))] == want
        else:
            total = {r._d: sorted((s.low, s.high) for s in r.spans) for r in spans.collect()}
            for i, w in enumerate(want):
                covered = {p for lo, hi in total.get(i, []) for p in range(max(0, lo), min(w[0], hi))}
                assert len(covered) == w[1]
    finally:
        suffix_dedup.MOST_UNITS = real


def test_suffix_dedup_sf(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in suffix_dedup.removal_report(df).collect())
    assert [g[1:] for g in got] == brute_removed([t for _, t in rows])
    whole = suffix_dedup.without_repeats(df)
    assert whole.columns == df.columns and whole.count() == len(rows)


def test_suffix_dedup_edges(spark):
    long = "ab cd " * 60
    rows = [(None, long, None), (4, "q" * 30000, "s"), (4, "q" * 30000, "s"), (5, None, "s"), (6, "é" * 100, "t"), (7, "é" * 100, "t")]
    got = sorted((tuple(r) for r in suffix_dedup.removal_report(docs_frame(spark, rows)).collect()), key=str)
    want = sorted(((r[0], *w) for r, w in zip(rows, brute_removed([r[1] for r in rows]))), key=str)
    assert got == want
    assert suffix_dedup.removal_report(docs_frame(spark, [])).count() == 0


def brute_topk(rows, every=20, k=20):
    import math

    v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q in v:
        if i % every == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), j) for j, c in v if j != i and len(c) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_topk(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, topk_search.search(df).collect())) == brute_topk(rows)


def test_topk_edges(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-3, 3) / 64 for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (220, [None, 1.0, 1.0, 1.0]), (240, [float("nan")] * 4), (260, [float("inf"), 0.0, 0.0, 0.0]), (280, [1.0, 2.0]), (300, [3.0, -2.0]), (320, []), (340, [1e9] * 4), (-40, [2.5e11] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("vec_id", "vec_id")
    assert sorted(map(tuple, topk_search.search(df).collect())) == brute_topk(rows)
    v = topk_search.quantised(df)
    many = topk_search.top_k(v, v.where("vec_id % 20 = 0"), tile_bytes=200)
    assert sorted(map(tuple, many.collect())) == brute_topk(rows)
    assert topk_search.search(df.limit(0)).count() == 0


def test_topk_rows_of_one_id(spark):
    """Every row with a query's id is a query, and only that row is left out of its own results."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(i % 30, [rng.randrange(-3, 3) / 64 for _ in range(3)]) for i in range(90)]
    v = [(i, [round(64 * x) for x in e]) for i, e in rows]
    want = []
    for n, (i, q) in enumerate(v):
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for m, (j, c) in enumerate(v) if m != n)[:20]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk_search.search(df).collect())) == sorted(want)
    v = topk_search.quantised(df).repartition(1).withColumn("row", F.monotonically_increasing_id())
    assert topk_search.top_k(v, v.where("vec_id % 20 = 0"), tile_bytes=100).count() == len(want)


def test_targets():
    assert source_mixing.targets([]) == []
    got = source_mixing.targets([100, 100, 100])
    assert got == pytest.approx([200, 200 * 250 / 300 + 0, 250 / 3], rel=0.5) and sum(got) == pytest.approx(450)
    got = source_mixing.targets([0, 10, 1000])
    assert got[0] == 0 and got[1] == 20 and got[2] == pytest.approx(1495)


def test_split_tree():
    tree = source_mixing.split_tree(np.array([100, 7, 0, 350]), 13, 1)
    assert tree.sum(0).tolist() == [100, 7, 0, 350] and tree.min() >= 0
    assert tree.sum(1).max() - tree.sum(1).min() <= 2


def check_mix(spark, df, rows):
    got = source_mixing.taken_words(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, source_mixing.targets([sizes[s] for s in order])))
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    longest = max((r.size for r in got), default=0)
    for s, t in taken.items():
        assert abs(t - want[s]) <= longest / 2 + 1
    return got


def test_mixing(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    one = check_mix(spark, df, rows)
    again = source_mixing.taken_words(df.repartition(5)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, again))
    mixed = source_mixing.mix(df)
    took = {r.doc_id: r.taken for r in one}
    count = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    size = {r.doc_id: r["size"] for r in one}
    assert {d: n * size[d] for d, n in count.items()} == {d: t for d, t in took.items() if t}
    shards = mixed.groupBy("_shard").count().collect()
    assert 30 < len(shards) <= source_mixing.SHARDS  # 1000 documents make few blocks


def test_mixing_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (2, None, "y"), (3, "", "y"), (4, "one word two", "é"), (5, "w " * 40000, "z")]
    check_mix(spark, docs_frame(spark, rows, True), rows)
    assert source_mixing.taken_words(docs_frame(spark, [])).count() == 0
    assert source_mixing.mix(docs_frame(spark, [])).count() == 0
