"""Column functions and analyses on small inputs."""

import gzip
import itertools
import json
import random

import pytest
import regex
from pyspark.sql import functions as F

from lodewright import cli
from lodewright.functions import tokens as T
from lodewright.functions import urls as U
from lodewright.functions import values as V
from lodewright.operators import counts, index, ngrams, overlap, pii, profanity, prompts, sample, search, sentiment, stats
from lodewright.sources import corpus, records, sinks


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def column(spark, expression, *values):
    return [r[0] for r in texts(spark, *values).orderBy("doc_id").select(expression).collect()]


def test_unicode_tokens(spark):
    sentence = "You can follow any responses to this entry through the RSS 2.0 feed"
    mixed = "You can't pay $3,000.50 for RSS 2.0 feed, e.g. foo_bar 日本語 テスト"
    got = column(spark, T.unicode_tokens("text"), sentence, mixed, None, "", " \n")
    assert got[0] == sentence.split() and "2.0" in got[0]
    assert got[1] == "You|can't|pay|$|3,000.50|for|RSS|2.0|feed|,|e.g|.|foo_bar|日|本|語|テスト".split("|")
    assert got[2:] == [None, [], []]
    assert column(spark, F.size(T.ngrams(T.unicode_tokens("text"), 10)), sentence) == [4]


@pytest.mark.parametrize("n,want", [(1, 4), (2, 3), (4, 1), (5, 0), (20, 0)])
def test_ngrams(spark, n, want):
    df = texts(spark, "one two three four", None, "")
    assert T.exploded_ngrams(df, T.unicode_tokens("text"), n).count() == want
    assert [len(x or ()) for x in column(spark, T.ngrams(T.unicode_tokens("text"), n), "one two three four")] == [want]


def test_long_alternating_token(spark):
    assert column(spark, T.unicode_count("text"), "a1" * 200000) == [1]


def test_character_ngrams_and_registry(spark):
    T.register_tokenizer("characters", lambda t: F.split(T.col(t), ""))
    assert len(column(spark, T.ngrams(T.tokenizer("characters")("text"), 4), "test string")[0]) == 8
    with pytest.raises(ValueError):
        T.tokenizer("nosuch")
    with pytest.raises(ValueError):
        T.ngrams("text", 0)


def test_pretrained(spark):
    import public_tokenizers

    got = column(spark, T.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))("text"), "hello hello world", None)
    assert "".join(got[0]) == "hello hello world" and got[1] is None


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://User:pw@Host.com:80/a/b.JPG;x=1?q#f", ("https", "User:pw@Host.com:80", "JPG")),
        ("http://a.org", ("http", "a.org", "other")),
        ("//a.org/x.png", ("", "a.org", "png")),
        ("mailto:me@x.org", ("mailto", "", "other")),
        ("/only/.jpg", ("", "", "other")),
        ("HTTP://a.de/x.tar.jpeg", ("http", "a.de", "jpeg")),
        ("not a url", ("", "", "other")),
        ("", ("", "", "other")),
    ],
)
def test_urls(spark, url, want):
    from urllib.parse import urlparse

    got = tuple(spark.createDataFrame([(url,)], "u string").select(U.scheme("u"), U.netloc("u"), U.image_extension("u")).first())
    assert got == want and got[:2] == (urlparse(url).scheme, urlparse(url).netloc)


def test_public_suffixes(spark):
    hosts = ["a.co.uk", "uk", "x.y.com", "www.ck", "a.b.ck", "localhost", "1.2.3.4", "b.ck", "ck"]
    got = {r.host: r.suffix for r in U.public_suffixes(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()}
    assert got == {"a.co.uk": "co.uk", "uk": "uk", "x.y.com": "com", "www.ck": "ck", "a.b.ck": "b.ck", "b.ck": "b.ck"}


def test_values(spark):
    import hashlib

    assert column(spark, V.text_key("text"), "a", None) == [hashlib.md5(b"a").hexdigest(), "None"]
    assert column(spark, V.blake2b_hex("text"), " a ", None) == [hashlib.blake2b(b"a").hexdigest(), None]
    assert column(spark, V.year("text"), "2020-03-05T10:00:00", "1999", "March 5, 2020", None) == [2020, 1999, None, None]
    assert column(spark, V.free_form_year("text"), "March 5, 2020", "nonsense", None) == [2020, None, None]
    assert column(spark, V.blank("text"), None, "", " 　\n", "x") == [True, True, True, False]
    df = spark.createDataFrame([({"url": "u"}, "s")], "metadata struct<url:string>, a string")
    assert list(df.select(V.lookup(df, "url"), V.lookup(df, "a"), V.lookup(df, "b")).first()) == ["u", "s", ""]


def brute_grams(rows, n):
    from collections import Counter

    return Counter(tuple(w[i : i + n]) for t in rows if t for w in [t.split()] for i in range(len(w) - n + 1))


def test_topk_and_botk(spark):
    rng = random.Random(1)
    rows = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(30))) for _ in range(50)] + [None]
    df = texts(spark, *rows)
    for n in (1, 2, 3):
        found = brute_grams(rows, n)
        best = sorted(found.items(), key=lambda x: (x[1], x[0]), reverse=True)
        assert [(tuple(r.tokens), r["count"]) for r in ngrams.topk(df, n, 10, 0).orderBy("rank").collect()] == best[:10]
        least = sorted(sorted(found.items(), reverse=True), key=lambda x: x[1])
        assert [(tuple(r.tokens), r["count"]) for r in ngrams.botk(df, n, 10).orderBy("rank").collect()] == least[:10]
        assert ngrams.unique(df, n).first()[0] == len(found)
        assert sum(r["count"] for r in ngrams.counts(df, n).collect()) == sum(max(0, len((t or "").split()) - n + 1) for t in rows)
        assert abs(ngrams.approximate_unique(df, n).first()[0] - len(found)) <= 0.1 * len(found)
        assert {r["string"]: r["count"] for r in ngrams.approximate_topk(df, n, 5).collect()}.items() <= {" ".join(k): v for k, v in found.items()}.items()
    assert ngrams.topk(df, 3, 5, 10**6).count() == 0
    for bad in (lambda: ngrams.topk(df, 0), lambda: ngrams.topk(df, 1, 0), lambda: ngrams.botk(df, 1, 1, keep=0)):
        with pytest.raises(ValueError):
            bad()


def test_count_sequences_overlap(spark):
    df = texts(spark, "a a a", "b. a", None, "a.a")
    got = {r["string"]: r["count"] for r in search.count_sequences(df, ["a a", "a", "nosuch", "b.", "a  a"]).collect()}
    assert got == {"a a": 2, "a": 4, "nosuch": 0, "b.": 1}
    for bad in ([], [" "]):
        with pytest.raises(ValueError):
            search.count_sequences(df, bad)


def test_patterns_and_locations(spark):
    df = texts(spark, "aé12 34", None, "56")
    assert {r.pattern: r["count"] for r in search.count_patterns(df, ["[0-9]+", "z"]).collect()} == {"[0-9]+": 3, "z": 0}
    assert sorted((r.doc_id, r.match, r.start, r.end) for r in search.locations(df, ["[0-9]+"], ["doc_id"]).collect()) == [(0, "12", 3, 5), (0, "34", 6, 8), (2, "56", 0, 2)]
    assert search.locations(df, ["[0-9]+"], ["doc_id"], limit=2).count() == 2
    for bad in ("(?=a)", r"(a)\1", "(?<!x)y"):
        with pytest.raises(ValueError):
            search.count_patterns(df, [bad])
    assert search.checked(r"\\(?:a)")
    with pytest.raises(ValueError):
        search.checked("(a")


def test_locations_are_those_of_a_plain_matcher(spark):
    own = ["aé12 34", None, "56", "", "abéab", "\x00a\x1f1", "bb", "1"]
    patterns = ["[0-9]+", "a*", "b|", r"\p{L}", "x*$"]
    want = [(p, i, m[0], len(t[: m.start()].encode()), len(t[: m.end()].encode())) for i, t in enumerate(own) if t is not None for p in patterns for m in regex.finditer(p, t)]
    assert sorted(map(tuple, search.locations(texts(spark, *own), patterns, ["doc_id"]).collect())) == sorted(want)


def test_stats(spark):
    df = texts(spark, "a b", None, "c", "d e", "")
    r = stats.summary(df).first().asDict()
    assert r == {"total_tokens": 5, "total_documents": 5, "total_bytes": 7, "document_max_tokens": 2, "document_min_tokens": 0}
    assert sorted((x.kind, x.doc_id) for x in stats.extremes(df, ["doc_id"]).collect()) == [("max", 0), ("max", 3), ("min", 4)]
    assert stats.summary(df.limit(0)).first()["document_min_tokens"] is None


def test_lengths_and_spikes(spark):
    df = texts(spark, "ab, c", None, "xy\nz")
    assert {r.key: r["count"] for r in counts.lengths(df).collect()} == {"chars 5": 1, "tokens 3": 1, "text is None": 1, "chars 4": 1, "tokens 2": 1}
    assert sum(r.share for r in counts.length_shares(counts.lengths(df)).collect()) == pytest.approx(2)
    assert {r.key for r in counts.length_spikes(df, [4], [3]).collect()} == {"3 tok / ab, c", "4 char / xy(newline)z"}
    assert counts.spikes_of(df, "pile").count() == 0
    with pytest.raises(ValueError):
        counts.spikes_of(df, "nosuch")


def test_links_alive(spark):
    def fetch(url):
        if "down" in url:
            raise ConnectionError
        return 404 if "gone" in url else 200

    df = spark.createDataFrame([("u1",), ("u1",), ("down",), ("gone",), (None,)], "url string")
    assert {r.alive: r["count"] for r in counts.links_alive(df, fetch).collect()} == {True: 2, False: 3}


def test_modes(spark):
    df = spark.createDataFrame([(x,) for x in "aabbc"] + [(None,)] * 9, "v string")
    assert sorted(map(tuple, counts.modes(df, "v").collect())) == [("a", 2), ("b", 2)]


def test_pii(spark):
    df = texts(spark, "write to me@x.org, now. x@nodot now", "end me@x.org", " call (206) 555-1234 or", "isbn 1 " + "x" * 60 + " 206-555-1234", "ip 1.2.3.4 and 5.6.7.8 ", "#" * 3 + " 1.2.3.4", "!" * 99 + " a@b.co ", None, " ")
    assert {r.pii: r["count"] for r in pii.counts(df).collect()} == {"email": 1, "phone_numbers": 1, "IP_addresses": 2}


def test_profanity(spark):
    lexicon = {"offensive-minority-reference": ["foo"], "offensive-not-minority": ["ba[rz]", "qux"], "harmless-minority": ["kind"]}
    df = texts(spark, "Foo bar kind", "kind foot", "é qux éqax", "x" * 100000, None, " ")
    assert {r.profanity: r["count"] for r in profanity.taxonomy(df, lexicon).collect()} == {"profane": 2, "not profane": 1, "long": 1, "offensive-minority-reference": 1, "offensive-not-minority": 2, "harmless-minority": 2}
    assert {r.profanity: r["count"] for r in profanity.taxonomy(df, lexicon, compat=True).collect()}["offensive-not-minority"] == 1
    assert {r.profanity: r["count"] for r in profanity.by_model(df, F.contains("text", F.lit("qux"))).collect()} == {"profane": 1, "not profane": 2, "long": 1}


def test_sentiment(spark):
    df = texts(spark, "Here he is great. The muslims are nice! A caucasian man is bad. Nothing here.", "white person is good.", None)
    got = {r.term: (r.sentiment, r["count"]) for r in sentiment.co_occurrence(df).collect()}
    assert got["male"] == (pytest.approx(0.8), 1) and got["muslim"][1] == 1 and got["asian"] == (pytest.approx(-0.7), 1)
    assert got["white"] == (pytest.approx(0.7), 2)  # person is listed twice


def test_overlaps(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), str(rng.randrange(12))) for _ in range(60)]
    sets = {d: {k for x, k in rows if x == d} for d in "abc"}
    keyed = spark.createDataFrame(rows, "dataset string, key string")
    got = {r.datasets: r["size"] for r in overlap.subset_sizes(keyed, list("abc")).collect()}
    for names in ("a", "b", "c", "a,b", "a,c", "b,c", "a,b,c"):
        assert got.get(names, 0) == len(set.intersection(*(sets[d] for d in names.split(","))))
    assert overlap.subset_sizes(keyed, list("abc"), least=2).count() <= 4
    assert overlap.overlap_pair(keyed.where("dataset = 'a'"), keyed.where("dataset = 'b'")).count() == len(sets["a"] & sets["b"])


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x", "s"), (2, "x", None), (3, "y", "s"), (4, None, "s"), (5, "x", "t")], "id long, text string, source string")
    flagged = overlap.keep_first(df, ["id"])
    assert sorted((r.id, r.contaminated) for r in flagged.collect()) == [(1, False), (2, True), (3, False), (5, True)]
    assert {r.source: r.removed for r in overlap.removed_by_source(flagged).collect()} == {"no_source": 1, "t": 1}
    assert sinks.survivors(flagged).count() == 2 and sinks.attributes(flagged).columns == ["id", "source", "contaminated"]
    counted = counts.text_keys(df)
    assert overlap.duplicate_summary(counted).first().asDict() == {"duplicates": 3, "total": 5, "uniq_duplicates": 1, "uniq_total": 3}
    top = overlap.top_duplicates(counted)
    assert [(r["count"], r.id) for r in overlap.examples(df, top, ["id"], ["id"]).collect()] == [(3, 1)]
    block = df.where("id = 3").select(F.md5("text").alias("key"))
    assert [r.id for r in overlap.flag_contaminated(df, block).where("contaminated").collect()] == [3]


def test_index(spark):
    df = spark.createDataFrame([("a", "I really like Cats, a lot", "en"), ("b", "I like cats", "fr"), ("c", None, "en"), ("d", "cats like me. And I like dogs and winter", "en")], "id string, text string, lang string")
    i = index.CorpusIndex(df)
    assert i.count_documents_containing_phrases("i LIKE") == 2
    assert i.count_documents_containing_phrases("I like", slop=1) == 3
    assert i.count_documents_containing_phrases(["cats", "winter"], all_phrases=True) == 1
    assert i.count_documents_containing_phrases(["cats", "winter"]) == 3
    assert i.count_documents_containing_phrases("c.ts|dog", is_regexp=True) == 3
    assert i.count_documents_containing_phrases("like.*", is_regexp=True, subset_filter={"lang": "fr"}) == 1
    assert i.count_documents_containing_phrases("...") == 0
    assert [r.id for r in i.get_documents_containing_phrases("cats", num_documents=2)] == ["a", "b"]
    assert [r.id for r in i.get_documents_containing_phrases("cats", return_all_hits=True, sort_field="lang")] == ["a", "d", "b"]
    assert i.count_documents_for_each_phrase(["cats", "nosuch", "I like dogs and winter", "like me and I like dogs and winter", "like me and I like cats"]) == [3, 0, 1, 1, 0]
    assert i.count_documents_for_each_phrase([["I", "like me"], ["cats", "nosuch"]], all_phrases=True) == [1, 0]
    with pytest.raises(TypeError):
        i.count_documents_for_each_phrase([["a"]])
    assert i.count_total_occurrences_of_unigrams(["like", "Cats", "zzz"]) == {"like": 4, "cats": 3, "zzz": 0}
    assert i.get("a", "b").count() == 2 and i.random(2, 1).count() == 2
    kept = index.CorpusIndex(i.analysed())
    assert kept.count_documents_containing_phrases("i like") == 2


def test_slop():
    assert index.near("a b c".split(), ["a", "c"], 1) and not index.near("a b c".split(), ["a", "c"], 0)
    assert index.near("c a".split(), ["a", "c"], 2) and not index.near("c a".split(), ["a", "c"], 1)
    assert not index.near(["a"], ["a", "a"], 5) and not index.near(["a"], [], 5)


def test_slop_against_all_placings():
    rng = random.Random(1)
    for _ in range(3000):
        tokens, phrase, slop = [rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abc") for _ in range(rng.randrange(1, 5))], rng.randrange(5)
        placings = itertools.product(*[[i for i, t in enumerate(tokens) if t == p] for p in phrase])
        want = any(len(set(c)) == len(c) and max(shifts := [i - k for k, i in enumerate(c)]) - min(shifts) <= slop for c in placings)
        assert index.near(tokens, phrase, slop) == want
    assert not index.near(["a"] * 39 + ["b"] * 60, ["a"] * 40, 60) and index.near(["a", "b"] * 40, ["a"] * 40, 40)


def test_hits_with_few_and_many_anchors(spark, monkeypatch):
    rng = random.Random(2)
    own = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(30))) for _ in range(60)] + [None, ""]
    asked = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(30)] + ["", "."]
    probes = spark.createDataFrame(list(enumerate(asked)), "i long, text string")
    found = index.CorpusIndex(texts(spark, *own), ids="doc_id")
    want = sorted((i, d) for i, p in enumerate(asked) if p.strip(".") for d, t in enumerate(own) if t and f" {p} " in f" {t} ")
    for most in (1000, 3):
        monkeypatch.setattr(index, "ANCHORS", most)
        assert sorted((r.probe, r.id) for r in found.hits(probes, "i").collect()) == want


def test_copies_are_numbered_over_partitions(spark):
    rng, seen, want = random.Random(3), {}, []
    own = [rng.choice(["x", "x", "x", "y", None]) for _ in range(2000)]
    for i, t in enumerate(own):
        seen[t] = seen.get(t, 0) + 1
        want.append((i, t, seen[t]))
    assert sorted(map(tuple, overlap.numbered_copies(texts(spark, *own).select("doc_id", "text").repartition(4), ["doc_id"]).collect())) == want


def test_tfrecords(spark, tmp_path):
    def part(n: int, data: bytes) -> bytes:
        size = len(data)
        return bytes([n << 3 | 2]) + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + data

    def example(**own: bytes) -> bytes:
        return part(1, b"".join(part(1, part(1, k.encode()) + part(2, part(1, part(1, v)))) for k, v in own.items()))

    def record(data: bytes) -> bytes:
        return len(data).to_bytes(8, "little") + b"1234" + data + b"5678"

    (tmp_path / "a.tfrecord").write_bytes(record(example(text="é".encode() * 90, url=b"u")) + record(example(url=b"v")))
    (tmp_path / "b.tfrecord.gz").write_bytes(gzip.compress(record(example(text=b"t", other=b"o"))))
    (tmp_path / "c.tfrecord").write_bytes(b"")
    rows = sorted((r.url or "", r.text) for r in records.tfrecords(spark, str(tmp_path), ["text", "url"]).collect())
    assert rows == [("", "t"), ("u", "é" * 90), ("v", None)]
    with pytest.raises(ValueError):
        list(records.framed(b"123"))
    assert records.shard_names("s3a://b/d/", 2) == ["s3a://b/d/train-00000-of-00002.parquet", "s3a://b/d/train-00001-of-00002.parquet"]


def test_batches_resume_and_draws_with_replacement(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "cast(id as string) as text")
    out = str(tmp_path / "b")
    assert sinks.resumed_batches(df.where("id < 4"), out, 3) == 4 and sinks.resumed_batches(df, out, 3) == 6 and sinks.resumed_batches(df, out, 3) == 0
    assert sorted(r.id for r in spark.read.json(out).collect()) == list(range(10))
    found = index.CorpusIndex(df)
    assert found.random(50, 1, replacement=True).count() == 50 and index.CorpusIndex(df.limit(0)).random(5, 1, replacement=True).count() == 0


def test_catalog(spark):
    spark.range(3).selectExpr("cast(id as string) as id", "'t' as text").createOrReplaceTempView("corpus_one")
    spark.range(2).selectExpr("cast(id as string) as id", "'u' as text").createOrReplaceTempView("corpus_two")
    assert {r["index"]: r.documents for r in index.tables(spark, "corpus_*", properties=True).collect()} == {"corpus_one": 3, "corpus_two": 2}
    assert index.union_of(spark, "corpus_*").count() == 5


def test_prompts(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("dataset: d\ntemplates:\n  x: !Template\n    id: x\n    name: n\n    answer_choices: null\n    jinja: '{{ premise }} and {{hypothesis}} ||| {{label}}'\n")
    t = prompts.read_templates(spark, str(tmp_path / "t.yaml"))
    assert prompts.fields(t).first()["fields"] == ["premise", "hypothesis", "label"]
    assert [tuple(r) for r in counts.template_counts(t).collect()] == [("d", 1)]
    rows = spark.createDataFrame([(1, "a ||| {{label}}", "b", None)], "i long, premise string, hypothesis string, label string")
    assert prompts.render(rows, t.first()["jinja"]).first()["parts"] == ["a ||| {{label}} and b", ""]
    assert [tuple(r) for r in prompts.probes(rows, ["premise", "hypothesis"], "i").collect()] == [(1, 0, "a ||| {{label}}"), (1, 1, "b")]


def write_gz(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def test_sources(spark, tmp_path):
    write_gz(tmp_path / "in/a.json.gz", [{"text": f"a{i}", "x": 1} for i in range(4)])
    write_gz(tmp_path / "in/sub/b.jsonl.gz", [{"text": None}, {}, {"text": "b c"}])
    (tmp_path / "in/skip.txt").write_text("no")
    d = str(tmp_path / "in")
    assert len(corpus.expand(spark, [d])) == 2
    assert corpus.documents(spark, [d]).count() == 7
    assert corpus.documents(spark, [d], limit=2).count() == 4
    assert corpus.documents(spark, [d], file_limit=1).count() == 4
    found = corpus.documents(spark, [d], positions=True).collect()
    assert sorted((r.path[-8:], r.line, r.text) for r in found if r.text)[-1] == ("jsonl.gz", 3, "b c")
    total = stats.summary(corpus.documents(spark, [d], positions=True), raw="raw").first()
    assert total["total_documents"] == 7 and total["total_bytes"] == sum(len(json.dumps(r)) + 1 for r in [*({"text": f"a{i}", "x": 1} for i in range(4)), {"text": None}, {}, {"text": "b c"}])
    with pytest.raises(FileNotFoundError):
        corpus.expand(spark, [str(tmp_path / "in/sub"), str(tmp_path)], glob="*.nosuch")
    with pytest.raises(ValueError):
        corpus.limited_files(["a"], 0)
    (tmp_path / "l.csv").write_text("word,notes,categorization\nab.,,x\ncd,,y\nef,,x\n")
    assert corpus.lexicon(spark, str(tmp_path / "l.csv")) == {"x": ["ab.", "ef"], "y": ["cd"]}
    (tmp_path / "f.tsv").write_text("d\ts\t['a', 'b']\ne\t\t['c']\n")
    assert [r.dataset for r in corpus.benchmark_fields(spark, str(tmp_path / "f.tsv"), 2).collect()] == ["d"]
    (tmp_path / "c.jsonl").write_text('{"url": "a", "count": 1}\n{"url": "b", "count": 5}\n')
    assert [r.url for r in corpus.counted_keys(spark, str(tmp_path / "c.jsonl"), "url").collect()] == ["b", "a"]
    assert corpus.json_lines(spark, str(tmp_path / "c.jsonl")).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "long text"), ("1", "other"), ("2", ""), ("3", None)], "id string, text string")
    rows = sinks.search_rows(df, "id", 4).collect()
    assert [(r.id, r.text) for r in rows] == [("1", "long")]
    named = spark.createDataFrame([("/x/f.gz", 1, "t", "r")], "path string, line long, text string, raw string")
    assert sinks.search_rows(named).first()["id"] == "f.gz-0"
    out = str(tmp_path / "o")
    sinks.write_json(df, out)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_json(df, out)
    sinks.write_json(df.limit(1), out, force=True)
    assert spark.read.json(out).count() == 1
    assert sinks.auto_name("d", 3, 20, 5, 10, 1) == "d/n3-k20-h5--limit10--seed1.jsonl" and sinks.auto_name("d/x.jsonl", 1, 1) == "d/x.jsonl"
    chunks = sinks.in_chunks(spark.range(11), 3, "id").groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("low")).orderBy("chunk").collect()
    assert [tuple(r) for r in chunks] == [(0, 3, 0), (1, 3, 3), (2, 5, 6)]
    n = sinks.normalised(spark.createDataFrame([(1, "t", "C Sharp", 5)], "id long, text string, lang string, stars long"), "s", "today").first()
    assert n.lang == "c-sharp" and n.metadata.stars == 5
    sinks.in_batches(spark.range(10).selectExpr("cast(id as string) text"), str(tmp_path / "b"), 3)
    assert spark.read.json(str(tmp_path / "b")).count() == 10
    sinks.id_list(df, str(tmp_path / "ids"))
    assert spark.read.parquet(str(tmp_path / "ids")).count() == 4 and sinks.compacted(df, 1).rdd.getNumPartitions() == 1


def test_samples(spark):
    df = spark.range(10000).selectExpr("id", "cast(id as string) as text", "id % 3 as g")
    assert 800 < sample.bernoulli(df, 0.1, 1).count() < 1200
    assert sample.sampled_values(df, "text", 1.0).count() == 10000
    split = {r.split: r["count"] for r in sample.split_by_hash(df).groupBy("split").count().collect()}
    assert split["train"] > 9900 and sum(split.values()) == 10000
    assert sample.first_rows(df, 2, ["g"], ["id"]).count() == 6
    assert sample.random_rows(df, 7, 1).count() == 7 and sample.random_rows(df, 7, 1).distinct().count() == 7


def test_streaming(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    from lodewright.streaming import counts as streams

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"url": "http://a.org/x"}\n{"url": "https://b.org"}\n{"url": "http://a.org"}\n')
    stream = streams.arriving(spark, str(tmp_path / "in"), StructType([StructField("url", StringType())]))
    query = streams.counting(stream, counts.locations, "seen", str(tmp_path / "checkpoint"), once=True)
    query.awaitTermination(60)
    assert {r.url: r["count"] for r in spark.table("seen").collect()} == {"a.org": 2, "b.org": 1}
    timed = stream.withColumn("at", F.lit("2024-01-01 00:10:00").cast("timestamp"))
    assert streams.windowed(timed, F.col("url"), "at").isStreaming


def test_command_line(spark, tmp_path, capsys):
    write_gz(tmp_path / "in/a.json.gz", [{"text": "a b a b"}, {"text": "a b"}])
    d = str(tmp_path / "in")
    assert cli.main(["topk", d, "-n", "2", "-k", "1"]) == 0
    assert capsys.readouterr().out == '[1/1] "a b" (count = 3)\n'
    assert cli.main(["stats", d, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["total_tokens"] == 6
    assert cli.main(["count", d, "-s", "b a", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["count"] == 1
    assert cli.main(["search", d, "-p", "b", "--with-locations", "--json"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    assert cli.main(["unique", d, "-n", "1", "--json"]) == 0 and json.loads(capsys.readouterr().out) == {"unique_count": 2}
    assert cli.main(["analyze", "lengths", d, "--json"]) == 0
    capsys.readouterr()
    assert cli.main(["topk", d, "-n", "0"]) == 1 and "1 or more" in capsys.readouterr().err
    assert cli.main(["search", d, "-p", "b", "--locations-limit", "1"]) == 1
    out = str(tmp_path / "out")
    assert cli.main(["botk", d, "-n", "1", "-o", out, "-q"]) == 0
    assert spark.read.json(out + "/n1-k20-h5.jsonl").count() == 2
    assert cli.size_bytes("2") == 2 << 30 and cli.size_bytes("5MB") == 5_000_000
