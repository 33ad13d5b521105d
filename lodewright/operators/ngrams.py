"""Most common, least common and distinct n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import MOST_SHIFTS, exploded_ngrams, ngram_pieces, unicode_tokens
from ..sources.scratch import written
from . import packed

#: Joins tokens inside: sorts before every character of a token, so that joined n-grams sort as their token lists do.
SEPARATOR = "\0"
Tokens = Callable[[str], Column]
#: So many hashes are looked up inside the scan, and so many in a broadcast table; beyond that all n-grams are counted as strings.
LISTED, BROADCAST = 1000, 1_000_000


def counts(df: DataFrame, n: int, text: str = "text", tokens: Tokens = unicode_tokens) -> DataFrame:
    """(ngram, count) of every n-gram: tokens joined by SEPARATOR. N-grams never cross documents; null texts have none.

    One shuffle of partial counts by n-gram.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    return exploded_ngrams(df, tokens(text), n, separator=SEPARATOR).groupBy("ngram").agg(F.count("*").alias("count"))


def _ranked(counted: DataFrame, k: int, order: list[Column]) -> DataFrame:
    if k < 1:
        raise ValueError("k must be 1 or more")
    best = counted.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.orderBy(*order)).cast("int")  # over k rows
    return best.select(F.split("ngram", SEPARATOR).alias("tokens"), F.replace("ngram", F.lit(SEPARATOR), F.lit(" ")).alias("string"), "count", rank.alias("rank"))


def _most_frequent(df: DataFrame, n: int, k: int, threshold: int, text: str, tokens: Tokens) -> DataFrame | None:
    """(ngram, count) of all that can be among the k most frequent; None if that can't be told from hashes.

    First hashes alone are counted, then the n-grams of those that are as frequent as the k-th one. A hash is at least
    as frequent as each of its n-grams, so that no n-gram which reaches that count is lost.
    """
    spark = df.sparkSession
    found = written(packed.frequent(df, n, k, threshold, text, tokens), "frequent")
    of_best = found.orderBy(F.desc("count")).limit(k).agg(F.min("count").alias("least"), F.count("*").alias("n")).first()
    least = of_best["least"] if of_best["n"] == k else threshold + 1
    wanted = found.where(F.col("count") >= least).select("h")
    listed = [r["h"] for r in wanted.limit(LISTED + 1).collect()]
    rows = ngram_pieces(df, tokens(text), n, separator=SEPARATOR, whole=True)
    hashed = rows.df.withColumn("h", F.xxhash64(*rows.pieces))
    if len(listed) <= LISTED:
        own = hashed.where(F.col("h").isin(listed)) if listed else hashed.where(F.lit(False))
    elif wanted.count() <= BROADCAST:
        own = hashed.join(F.broadcast(wanted), "h", "left_semi")
    else:
        return None
    counted = own.select(rows.joined().alias("ngram")).groupBy("ngram").agg(F.count("*").alias("count")).where(F.col("count") > threshold)
    best = written(counted.orderBy(F.desc("count"), F.desc("ngram")).limit(k), "most-frequent")
    if of_best["n"] == k and best.where(F.col("count") >= least).count() < k:  # n-grams that share a hash: others may be as frequent
        return None
    return best


def topk(df: DataFrame, n: int = 3, k: int = 20, threshold: int = 1, text: str = "text", tokens: Tokens = unicode_tokens) -> DataFrame:
    """tokens, string, count, rank of the k most frequent n-grams that occur more than ``threshold`` times.

    Counts are exact. Ties go to the greater n-gram, token by token. Hashes are counted first, n-grams of the most
    frequent ones afterwards, so that the others are never shuffled; df is read twice.
    """
    if n < 1 or k < 1:
        raise ValueError("n and k must be 1 or more")
    best = _most_frequent(df, n, k, max(threshold, 0), text, tokens)
    if best is None:
        best = counts(df, n, text, tokens).where(F.col("count") > threshold)
    return _ranked(best, k, [F.desc("count"), F.desc("ngram")])


def botk(df: DataFrame, n: int = 3, k: int = 20, threshold: int = 4_294_967_295, keep: float = 1.0, seed: int | None = None, text: str = "text", tokens: Tokens = unicode_tokens) -> DataFrame:
    """The k least frequent n-grams that occur fewer than ``threshold`` times, ties to the greater n-gram.

    With ``keep`` below 1 each n-gram takes part with that probability, so that reruns with other seeds show others.
    """
    if not 0 < keep <= 1:
        raise ValueError("keep must be above 0 and at most 1")
    found = counts(df, n, text, tokens).where(F.col("count") < threshold)
    if keep < 1:
        found = found.where(F.rand(seed) <= keep)
    return _ranked(found, k, [F.asc("count"), F.desc("ngram")])


def unique(df: DataFrame, n: int = 1, text: str = "text", tokens: Tokens = unicode_tokens) -> DataFrame:
    """unique_count: how many different n-grams there are, told apart by 96 bits of hashes."""
    return unique_each(df, (n,), text, tokens).select("unique_count")


def unique_each(df: DataFrame, ns: Iterable[int] = (1, 2, 3), text: str = "text", tokens: Tokens = unicode_tokens) -> DataFrame:
    """(n, unique_count) of several n, each text tokenized once; see unique()."""
    ns = tuple(ns)
    if not ns or min(ns) < 1:
        raise ValueError("n must be 1 or more")
    large = [n for n in ns if n > MOST_SHIFTS]
    found = None
    for some in [[n for n in ns if n <= MOST_SHIFTS], *[[n] for n in large]]:
        if some:
            own = packed.distinct_counts(df, tuple(some), text, tokens)
            found = own if found is None else found.unionByName(own)
    total = lambda n: F.coalesce(F.sum(F.when(F.col("n") == n, F.col("m"))), F.lit(0)).cast("long")
    sums = found.agg(*[total(n).alias(f"_{n}") for n in ns])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"_{n}").alias("unique_count")) for n in ns])))


def approximate_unique(df: DataFrame, n: int = 1, error: float = 0.01, text: str = "text", tokens: Tokens = unicode_tokens) -> DataFrame:
    """unique_count by HyperLogLog++: no shuffle but of one sketch a task."""
    return exploded_ngrams(df, tokens(text), n, separator=SEPARATOR).agg(F.approx_count_distinct("ngram", error).alias("unique_count"))


def approximate_topk(df: DataFrame, n: int = 3, k: int = 20, tracked: int = 100_000, text: str = "text", tokens: Tokens = unicode_tokens) -> DataFrame:
    """string, count, rank by a frequent-items sketch of ``tracked`` counters a task, in bounded memory without a shuffle by key."""
    top = exploded_ngrams(df, tokens(text), n, separator=SEPARATOR).agg(F.expr(f"approx_top_k(ngram, {int(k)}, {int(tracked)})").alias("t"))
    return top.select(F.posexplode("t").alias("at", "x")).select(F.replace("x.item", F.lit(SEPARATOR), F.lit(" ")).alias("string"), F.col("x.count").alias("count"), (F.col("at") + 1).alias("rank"))
