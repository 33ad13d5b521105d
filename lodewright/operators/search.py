"""Counts of exact token sequences and of regular expressions, and where they are."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.tokens import unicode_tokens

#: What a linear-time matcher doesn't have.
_LOOK = re.compile(r"(?<!\\)(?:\\\\)*\(\?(?:[=!]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]")
_GAP = "\x1f"


def count_sequences(df: DataFrame, searches: Iterable[str], text: str = "text", tokens: Callable[[str], Column] = unicode_tokens) -> DataFrame:
    """string, tokens, count: how often each sequence of tokens occurs in all texts, overlapping occurrences too.

    Strings that are tokenized alike count once, under the first of them. A string without tokens is an error. One pass
    over the texts and one row from each task; all sequences are counted by looking ahead in the joined tokens.
    """
    spark = df.sparkSession
    wanted = [s for s in searches]
    if not wanted:
        raise ValueError("at least one string is needed")
    rows = spark.createDataFrame(list(enumerate(wanted)), "i int, s string").select("i", "s", tokens("s").alias("t")).orderBy("i").collect()
    own: dict[tuple, str] = {}
    for r in rows:
        if not r["t"]:
            raise ValueError(f"no token in {r['s']!r}")
        own.setdefault(tuple(r["t"]), r["s"])
    line = F.concat(F.lit(_GAP), F.array_join(tokens(text), _GAP), F.lit(_GAP))
    parts = []
    for sequence in own:
        quoted = "".join(f"{_GAP}{re.sub(r'([^A-Za-z0-9_])', _quote, t)}" for t in sequence)
        parts.append(F.coalesce(F.sum(F.regexp_count("_line", F.lit(f"(?={quoted}{_GAP})"))), F.lit(0)).cast("long"))
    totals = df.where(F.col(text).isNotNull()).select(line.alias("_line")).agg(*[p.alias(f"c{i}") for i, p in enumerate(parts)])
    each = F.array(*[F.struct(F.lit(s).alias("string"), F.array(*map(F.lit, t)).alias("tokens"), F.col(f"c{i}").alias("count")) for i, (t, s) in enumerate(own.items())])
    return totals.select(F.inline(each))


def _quote(m: re.Match) -> str:
    return f"\\x{{{ord(m[1]):x}}}"


def checked(pattern: str) -> str:
    """The pattern, if it needs neither look-around nor back references and the engine that runs it can read it."""
    if _LOOK.search(pattern):
        raise ValueError(f"look-around and back references are not supported: {pattern!r}")
    from pyspark import SparkContext

    if SparkContext._active_spark_context is not None:
        try:
            SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
        except IllegalArgumentException as e:
            raise ValueError(f"not a regular expression: {pattern!r}: {e}") from None
    return pattern


def count_patterns(df: DataFrame, patterns: Iterable[str], text: str = "text") -> DataFrame:
    """pattern, count: matches of each regular expression in all texts, not overlapping. One pass for all patterns."""
    own = [checked(p) for p in patterns]
    if not own:
        raise ValueError("at least one pattern is needed")
    totals = df.where(F.col(text).isNotNull()).agg(*[F.coalesce(F.sum(F.regexp_count(text, F.lit(p))), F.lit(0)).cast("long").alias(f"c{i}") for i, p in enumerate(own)])
    return totals.select(F.inline(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"c{i}").alias("count")) for i, p in enumerate(own)])))


@F.pandas_udf(ArrayType(LongType()))
def _starts(gaps: pd.Series, matches: pd.Series) -> pd.Series:
    """Where each match starts, from the sizes of the pieces before the matches and of the matches."""
    return pd.Series([np.cumsum(g) + np.cumsum(m) - m for g, m in zip(gaps, matches)], index=gaps.index)


def locations(df: DataFrame, patterns: Iterable[str], keys: list[str], text: str = "text", limit: int | None = None) -> DataFrame:
    """pattern, the columns ``keys``, match, start, end: every match with its offsets in UTF-8 bytes, the end exclusive.

    Matches, and the pieces between them, come from the engine that counts them; Python adds up their sizes alone, and
    only for texts with a match. ``limit`` keeps the first matches of each pattern by keys and start.
    """
    own = [checked(p) for p in patterns]
    if not own:
        raise ValueError("at least one pattern is needed")
    if limit is not None:
        firsts = [locations(df, [p], keys, text).orderBy(*keys, "start").limit(limit) for p in own]  # each task keeps no more
        return reduce(DataFrame.unionByName, firsts)
    hit = reduce(Column.__or__, [F.rlike(text, F.lit(p)) for p in own])
    cut = df.where(hit).select(*keys, *[c for i, p in enumerate(own) for c in (F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_m{i}"), F.split(text, p, -1).alias(f"_g{i}"))])
    each = []
    for i, p in enumerate(own):
        m, g = F.col(f"_m{i}"), F.col(f"_g{i}")
        # split() gives no piece before an empty match at the start of a text
        gaps = F.when(F.size(g) > F.size(m), g).otherwise(F.concat(F.array(F.lit("")), g))
        starts = _starts(F.transform(F.slice(gaps, F.lit(1), F.size(m)), _bytes), F.transform(m, _bytes))
        each.append(F.transform(F.arrays_zip(m.alias("m"), starts.alias("s")), _of(p)))
    found = cut.select(*keys, F.explode(F.concat(*each)).alias("_x"))
    return found.select(F.col("_x.p").alias("pattern"), *keys, F.col("_x.m").alias("match"), F.col("_x.s").alias("start"), (F.col("_x.s") + _bytes(F.col("_x.m"))).alias("end"))


def _of(pattern: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(pattern).alias("p"), x["m"].alias("m"), x["s"].alias("s"))


def _bytes(x: Column) -> Column:
    return F.octet_length(x).cast("long")


def grouped_locations(found: DataFrame, path: str = "path", line: str = "line") -> DataFrame:
    """pattern, path, matches: the matches of a file as an array, for reports of limited size."""
    each = F.struct(line, "match", "start", "end")
    return found.groupBy("pattern", path).agg(F.array_sort(F.collect_list(each)).alias("matches"))
