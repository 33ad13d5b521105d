"""Offensive language by a lexicon of three classes, or by a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import sentences
from ..functions.values import blank, too_long

#: Lexicon classes in the order of counting; a match of the last one doesn't make a document profane.
CLASSES = ("offensive-minority-reference", "offensive-not-minority", "harmless-minority")


def class_pattern(words: list[str], compat: bool = False) -> str:
    """One alternation of whole words in any case. Words are fragments of regular expressions and not escaped.

    With ``compat`` the last word matches only before a backspace character, as with the closing \\b taken literally.
    """
    if not words:
        return "(?!)"
    inner = r"\b|\b".join(words)
    return rf"(?iU)\b{inner}" + ("\\x08" if compat else r"\b")


def taxonomy(df: DataFrame, lexicon: dict[str, list[str]], text: str = "text", compat: bool = False) -> DataFrame:
    """(profanity, count): documents as ``profane`` or ``not profane``, and matches by class.

    Harmless matches don't make a document profane. Texts over the limit are counted as ``long`` alone, blank texts not
    at all. One pass over the texts, one row from each task; keys without a count are left out.
    """
    found = df.where(~blank(text)).select(F.col(text).alias("_t"), too_long(text).alias("_long"))
    own = {c: class_pattern(lexicon.get(c, []), compat) for c in CLASSES}
    found = found.select("_long", *[F.when(~F.col("_long"), F.regexp_count("_t", F.lit(p)) if lexicon.get(c) else F.lit(0)).otherwise(0).alias(f"n{i}") for i, (c, p) in enumerate(own.items())])
    profane = (F.col("n0") + F.col("n1")) > 0
    parts = {"long": F.col("_long").cast("int"), "profane": (~F.col("_long") & profane).cast("int"), "not profane": (~F.col("_long") & ~profane).cast("int")} | {c: F.col(f"n{i}") for i, c in enumerate(own)}
    totals = found.agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in parts.items()])
    return totals.select(F.inline(F.array(*[F.struct(F.lit(k).alias("profanity"), F.col(f"`{k}`").alias("count")) for k in parts]))).where(F.col("count") > 0)


def by_model(df: DataFrame, flag: Column, text: str = "text") -> DataFrame:
    """(profanity, count) by ``flag``, true or 1 for a profane text: a column, or a classifier's UDF on the text."""
    label = F.when(flag.cast("boolean"), F.lit("profane")).otherwise(F.lit("not profane"))
    key = F.when(too_long(text), F.lit("long")).otherwise(label)
    return df.where(~blank(text)).groupBy(key.alias("profanity")).agg(F.count("*").alias("count"))


def any_sentence(flags, text: str = "text") -> Column:
    """Whether a classifier of many sentences (array<string> -> array<boolean>) flags one of a text's."""
    return F.exists(flags(sentences(text)), lambda x: x)
