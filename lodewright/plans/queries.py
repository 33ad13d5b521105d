"""Named queries: each applies one analysis to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counts, ngrams, overlap, pii, profanity, sample, search, sentiment, stats
from ..operators.index import CorpusIndex

PHRASES = ["of the", "the the", "que de", "No such phrase here", "of"]
PATTERNS = [r"[0-9]{3}", r"https?://", r"\b[A-Z][a-z]+\.", r"the +of", r"[^\x00-\x7F]+"]
SEARCHED = ["in the", "de la", "der und"]
WORDS = ["the", "de", "und", "of", "nosuchword"]
#: Stands in for a lexicon file: classes and fragments that occur in the test texts.
LEXICON = {"offensive-minority-reference": ["thanonble", "erthat"], "offensive-not-minority": ["and of", "reaux?"], "harmless-minority": ["the", "para", "nicht"]}
SPIKES = {"char_lengths": range(0, 200), "token_lengths": range(0, 30)}
LANGS = ["de", "en", "es", "fr"]
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def _index(spark: SparkSession, d: str) -> CorpusIndex:
    return CorpusIndex(_docs(spark, d), "doc_id")


def _grams(function: Callable, **how) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = function(_docs(spark, d), **how)
        return out.select("string", "count", "rank") if "rank" in out.columns else out

    return query


def unique_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.unique_each(_docs(spark, d), (1, 2, 3))


def search_locations(spark: SparkSession, d: str) -> DataFrame:
    return search.locations(_docs(spark, d), PATTERNS[:2], ["doc_id"])


def dedup_attributes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.keep_first(_docs(spark, d), ["doc_id"]).select("doc_id", "source", "contaminated")


def dedup_survivors(spark: SparkSession, d: str) -> DataFrame:
    return overlap.keep_first(_docs(spark, d), ["doc_id"]).where("not contaminated").select("doc_id", F.md5("text").alias("key"))


def _blocked(spark: SparkSession, d: str) -> DataFrame:
    """Texts that the first source shares with others: the blocklist of decontaminate_attributes."""
    docs = _docs(spark, d)
    first = docs.agg(F.min("source").alias("s"))
    return docs.join(F.broadcast(first), docs["source"] == F.col("s")).select(F.md5("text").alias("key"))


def decontaminate_attributes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.flag_contaminated(_docs(spark, d), _blocked(spark, d)).select("doc_id", "source", "contaminated")


def removed_by_source(spark: SparkSession, d: str) -> DataFrame:
    return overlap.removed_by_source(overlap.keep_first(_docs(spark, d), ["doc_id"]))


def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("source", F.md5("text").alias("key"))
    even = docs.where("source is not null and length(source) % 2 = 0")
    odd = docs.where("source is not null and length(source) % 2 = 1")
    return overlap.overlap_pair(even, odd)


def overlap_powerset(spark: SparkSession, d: str) -> DataFrame:
    keyed = _docs(spark, d).select(F.col("lang").alias("dataset"), F.md5("text").alias("key"))
    return overlap.subset_sizes(keyed, LANGS)


def top_duplicate_examples(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    top = overlap.top_duplicates(counts.text_keys(docs.where("text is not null")))
    return overlap.examples(docs, top, ["doc_id"], ["doc_id"]).select("key", "count", "doc_id", F.length("text").cast("long").alias("n_chars"))


def public_suffix_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.public_suffix_counts(counts.locations(_pages(spark, d)))


def phrase_docs(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).documents(SEARCHED).select("doc_id", "lang")


def _counted(predicate: dict) -> Query:
    return lambda spark, d: _index(spark, d).documents(**predicate).agg(F.count("*").alias("documents"))


def per_phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).document_counts(table(spark, d, "benchmark"), "item_id")


def contamination_pct(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).contamination(table(spark, d, "benchmark"), "item_id")


def paired_contamination_pct(spark: SparkSession, d: str) -> DataFrame:
    """The halves of each item as two parts that the same document must hold."""
    t = F.split("text", " ")
    half = F.ceil(F.size(t) / 2).cast("int")
    pieces = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.array_join(F.slice(t, F.lit(1), half), " ").alias("text")), F.struct(F.lit(1).cast("long").alias("part"), F.array_join(F.slice(t, half + 1, F.size(t)), " ").alias("text")))
    probes = table(spark, d, "benchmark").select("item_id", F.inline(pieces))
    return _index(spark, d).contamination(probes, "item_id", "part")


def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.languages(_docs(spark, d), F.coalesce("lang", F.lit("un")))


def profanity_model(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    return profanity.by_model(docs, F.col("toxic"))


def year_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.years(table(spark, d, "events"), "ts")


def per_file_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first three documents of each source, as of each file."""
    return sample.first_rows(_docs(spark, d), 3, ["source"], ["doc_id"]).select("source", "doc_id")


def user_modes(spark: SparkSession, d: str) -> DataFrame:
    return counts.modes(table(spark, d, "events"), "event_type")


def queries() -> dict[str, Query]:
    on_docs = lambda f, *a, **k: lambda spark, d: f(_docs(spark, d), *a, **k)
    on_pages = lambda f, *a, **k: lambda spark, d: f(_pages(spark, d), *a, **k)
    return {
        "topk_1gram": _grams(ngrams.topk, n=1),
        "topk_3gram": _grams(ngrams.topk, n=3),
        "topk_5gram": _grams(ngrams.topk, n=5),
        "botk_2gram": _grams(ngrams.botk, n=2),
        "unique_ngrams": unique_ngrams,
        "count_phrases": lambda s, d: search.count_sequences(_docs(s, d), PHRASES).select("string", "count"),
        "search_regex": lambda s, d: search.count_patterns(_docs(s, d), PATTERNS),
        "search_locations": search_locations,
        "corpus_stats": on_docs(stats.summary),
        "stats_extreme_docs": on_docs(stats.extremes, ["doc_id"]),
        "scheme_counts": on_pages(counts.schemes),
        "url_counts": on_pages(counts.locations),
        "url_token_counts": on_pages(counts.location_tokens, text="html"),
        "public_suffix_counts": public_suffix_counts,
        "extension_counts": on_pages(counts.extensions),
        "language_counts": language_counts,
        "year_counts": year_counts,
        "length_histogram": on_docs(counts.lengths),
        "length_distribution": lambda s, d: counts.length_shares(counts.lengths(_docs(s, d))),
        "length_spikes": on_docs(counts.length_spikes, **SPIKES),
        "pii_counts": on_docs(pii.counts),
        "profanity_taxonomy": on_docs(profanity.taxonomy, LEXICON),
        "profanity_model": profanity_model,
        "sentiment_terms": on_docs(sentiment.co_occurrence),
        "text_hash_counts": lambda s, d: counts.text_keys(_docs(s, d), "text", "lang"),
        "url_key_counts": on_pages(counts.url_keys),
        "duplicate_summary": lambda s, d: overlap.duplicate_summary(counts.text_keys(_docs(s, d), "text", "lang"), "lang"),
        "removed_by_source": removed_by_source,
        "dedup_attributes": dedup_attributes,
        "dedup_survivors": dedup_survivors,
        "decontaminate_attributes": decontaminate_attributes,
        "overlap_pairs": overlap_pairs,
        "overlap_powerset": overlap_powerset,
        "top_duplicate_examples": top_duplicate_examples,
        "phrase_doc_count": _counted({"phrases": SEARCHED}),
        "all_phrases_doc_count": _counted({"phrases": ["the", "of the"], "all_phrases": True, "subset_filter": {"lang": "en"}}),
        "regexp_doc_count": _counted({"phrases": ["th.{3,5}ing", "pap?a"], "is_regexp": True}),
        "slop_doc_count": _counted({"phrases": "of the", "slop": 2}),
        "phrase_docs": phrase_docs,
        "per_phrase_counts": per_phrase_counts,
        "unigram_ttf": lambda s, d: _index(s, d).term_frequencies(WORDS),
        "contamination_pct": contamination_pct,
        "paired_contamination_pct": paired_contamination_pct,
        "hash_split": lambda s, d: sample.split_by_hash(_docs(s, d)).select("doc_id", "split"),
        "per_file_limit": per_file_limit,
        "most_frequent_values": user_modes,
        "random_sample": lambda s, d: sample.sampled_values(_docs(s, d), "source", 0.1, 7),
    }
