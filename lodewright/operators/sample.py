"""Samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import held_out, lookup


def bernoulli(df: DataFrame, fraction: float = 0.01, seed: int | None = None) -> DataFrame:
    """Each row with probability ``fraction``; no shuffle."""
    return df.sample(False, fraction, seed)


def sampled_values(df: DataFrame, key: str, fraction: float = 0.01, seed: int | None = None) -> DataFrame:
    """``value`` of the key (column, else field of metadata, else empty) of sampled rows."""
    return bernoulli(df, fraction, seed).select(lookup(df, key).alias("value"))


def split_by_hash(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``split``: train, valid or test by the hash of the text, so that equal texts stay together."""
    return df.withColumn("split", held_out(text))


def first_rows(df: DataFrame, n: int, group: list[str], order: list[str]) -> DataFrame:
    """The first n rows of each group. Groups are files here; a file is one task's work in the reader too."""
    from pyspark.sql.window import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def random_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n rows drawn at random without replacement: each task keeps n, none sorts the table."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")
