"""Analyses that count documents by a key made of each: one expression, one shuffle of partial counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..functions.tokens import col, segment_count, strip, wordpunct_count
from ..functions.values import blank, text_key, too_long, year

#: Lengths that stand out in known corpora: fixed values.
CHAR_SPIKES = {
    "c4": [192, 515, 434, 499, 322, 86],
    "mc4": [73257, 219, 186, 16629, 568, 331, 519, 2024, 526, 524, 489, 160, 4114, 697, 17189],
    "oscar": [101, 367, 108, 150, 126, 24827, 132, 106, 136, 266, 110, 141, 105, 180, 120, 138, 116, 103, 197, 182, 543, 162, 124, 154, 763, 225, 24847, 145, 114, 520, 122, 501],
    "pile": [8194, 201, 35, 100000, 71, 73],
    "s2orc0": [160, 327],
    "stack": [172, 243, 182, 189, 154, 458, 192, 155, 2082, 263, 180, 1964, 158, 230, 178, 95, 2148, 84, 2058, 20000, 214, 1935, 550, 147, 1568, 109, 285, 232, 188, 3962, 88, 107, 1477, 393, 2114, 54, 4043, 2053, 208, 2116, 138, 200, 32, 197, 2153, 38, 175, 2603, 204, 2029, 60, 211, 1098, 254],
    "redpajama": [126, 133, 134, 118],
}
TOKEN_SPIKES = {
    "mc4": [99, 42, 6214, 236, 37, 71, 35, 92],
    "oscar": [64, 27, 18, 22, 4962, 74, 56, 31, 20, 105, 25, 34, 157, 248, 35, 4966, 99, 425],
    "pile": [9, 18, 20, 36],
    "redpajama": [23, 19, 54, 52, 30, 95, 32, 98, 96, 64, 66],
    "stack": [20, 33, 23, 17, 36, 10, 26, 4004, 13, 99, 39, 29, 8, 61, 454],
}


def count_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    """(name, count)."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("count"))


def schemes(df: DataFrame, url: str = "url") -> DataFrame:
    return count_by(df, urls.scheme(url), "scheme")


def locations(df: DataFrame, url: str = "url") -> DataFrame:
    """(url, count): documents by the network location of their URL; empty is a key like others."""
    return count_by(df, urls.netloc(url), "url")


def location_tokens(df: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """(url, count): tokens by network location; locations that are empty or hold white space are left out."""
    found = df.select(urls.netloc(url).alias("url"), F.coalesce(segment_count(text), F.lit(0)).alias("_n"))
    return found.where(F.rlike("url", F.lit(r"^\S+$"))).groupBy("url").agg(F.sum("_n").alias("count"))


def public_suffix_counts(counted: DataFrame, rules: Iterable[str] | None = None) -> DataFrame:
    """(high_level_domain, count) from locations(): their counts summed by public suffix; hosts without one are left out."""
    hosts = counted.select(urls.host("url").alias("host"), "count")
    known = urls.public_suffixes(hosts, "host", rules)
    return hosts.join(known, "host").groupBy(F.col("suffix").alias("high_level_domain")).agg(F.sum("count").alias("count"))


def extensions(df: DataFrame, url: str = "url") -> DataFrame:
    return count_by(df, urls.image_extension(url), "ext")


def languages(df: DataFrame, label: Column, text: str = "text") -> DataFrame:
    """(language, count): by ``label``, a column or a classifier's UDF on the text; ``long`` for long texts.

    Blank texts are left out, and so are those that the classifier gives null.
    """
    key = F.when(too_long(text), F.lit("long")).otherwise(label)
    return count_by(df.where(~blank(text)), key, "language").where("language is not null")


def years(df: DataFrame, *dates: str) -> DataFrame:
    """(year, count): by the year of the first date that is there; ``None`` without one."""
    return count_by(df, F.coalesce(year(*dates).cast("string"), F.lit("None")), "year")


def lengths(df: DataFrame, text: str = "text") -> DataFrame:
    """(key, count): ``chars N`` and ``tokens N`` for each document, ``text is None`` for a null text."""
    t = F.col(text)
    keys = F.when(t.isNull(), F.array(F.lit("text is None"))).otherwise(F.array(F.concat(F.lit("chars "), F.length(t).cast("string")), F.concat(F.lit("tokens "), wordpunct_count(strip(t)).cast("string"))))
    return df.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("count"))


def length_shares(counted: DataFrame) -> DataFrame:
    """(kind, length, share) from lengths(): the share of each length among those of its kind."""
    parts = F.split("key", " ")
    own = counted.where("key != 'text is None'").select(parts[0].alias("kind"), parts[1].cast("long").alias("length"), "count")
    total = F.sum("count").over(Window.partitionBy("kind"))  # rows are distinct lengths, not documents
    return own.select("kind", "length", (F.col("count") / total).alias("share"))


def length_spikes(df: DataFrame, char_lengths: Iterable[int] = (), token_lengths: Iterable[int] = (), text: str = "text") -> DataFrame:
    """(key, count): texts of the given lengths, as ``L tok / text`` and ``L char / text``, line feeds as (newline)."""
    t, shown = F.col(text), F.replace(text, F.lit("\n"), F.lit("(newline)"))
    n, m = wordpunct_count(strip(t)), F.length(t)
    one = lambda size, among, unit: F.when(size.isin(*among), F.concat(size.cast("string"), F.lit(f" {unit} / "), shown)) if among else F.lit(None).cast("string")
    keys = F.array_compact(F.array(one(n, list(token_lengths), "tok"), one(m, list(char_lengths), "char")))
    return df.where(t.isNotNull()).select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("count"))


def spikes_of(df: DataFrame, dataset: str, text: str = "text") -> DataFrame:
    """length_spikes() at the known lengths of a corpus."""
    if dataset not in CHAR_SPIKES and dataset not in TOKEN_SPIKES:
        raise ValueError(f"no lengths are known for {dataset!r}")
    return length_spikes(df, CHAR_SPIKES.get(dataset, ()), TOKEN_SPIKES.get(dataset, ()), text)


def text_keys(df: DataFrame, text: str = "text", *group: str) -> DataFrame:
    """(group, key, count): documents by the MD5 of their text."""
    return df.groupBy(*group, text_key(text).alias("key")).agg(F.count("*").alias("count"))


def url_keys(df: DataFrame, url: str = "url", *group: str) -> DataFrame:
    """(group, key, count): documents by URL, ``null`` for none."""
    return df.groupBy(*group, F.coalesce(col(url), F.lit("null")).alias("key")).agg(F.count("*").alias("count"))


def modes(df: DataFrame, column: str) -> DataFrame:
    """(value, count): the most frequent values, all of them in a tie; nulls are no value."""
    found = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    most = found.agg(F.max("count").alias("_most"))
    return found.join(F.broadcast(most), F.col("count") == F.col("_most")).drop("_most")


def template_counts(templates: DataFrame) -> DataFrame:
    """(dataset, templates): how many templates each data set has."""
    return templates.groupBy("dataset").agg(F.count("*").alias("templates"))


def links_alive(df: DataFrame, fetch: Callable[[str], int], url: str = "url") -> DataFrame:
    """(alive, count): URLs by whether ``fetch`` (URL -> HTTP status) answers below 400.

    OSError, which connection and HTTP errors are, means dead; anything else ends the job. Distinct URLs are asked once.
    """
    each = df.groupBy(F.col(url).alias("url")).agg(F.count("*").alias("n"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            alive = []
            for u in frame["url"]:
                try:
                    alive.append(u is not None and fetch(u) < 400)
                except OSError:
                    alive.append(False)
            yield pd.DataFrame({"alive": alive, "n": frame["n"]})

    return each.mapInPandas(run, "alive boolean, n long").groupBy("alive").agg(F.sum("n").alias("count"))
