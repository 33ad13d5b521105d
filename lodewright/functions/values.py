"""Dates, hashes, lengths and look-ups of single values."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructType

from .tokens import col, strip

#: Texts of more code points than this are counted as ``long`` by the classifiers, and left out by sentiment.
LONG = 99_999


def blank(text: str | Column) -> Column:
    """Null, empty or white space alone."""
    return F.coalesce(~F.rlike(col(text), F.lit(r"[^\s\p{Z}]")), F.lit(True))


def too_long(text: str | Column, most: int = LONG) -> Column:
    return F.length(col(text)) > most


def text_key(text: str | Column) -> Column:
    """MD5 of the UTF-8 text in hex, and the key ``None`` for a null text."""
    return F.coalesce(F.md5(col(text)), F.lit("None"))


@F.pandas_udf(StringType())
def blake2b_hex(text: pd.Series) -> pd.Series:
    """BLAKE2b of the stripped text, an id for URLs. Spark has no such function."""
    return text.map(lambda x: None if x is None else hashlib.blake2b(x.strip().encode()).hexdigest())


def held_out(text: str | Column) -> Column:
    """train, valid or test by the first three hex digits of the SHA-1 of the text."""
    start = F.substring(F.sha1(F.coalesce(col(text), F.lit(""))), 1, 3)
    return F.when(start.isin("fff", "ffe"), "test").when(start.isin("ffd", "ffc"), "valid").otherwise("train")


def year(*dates: str | Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy")) -> Column:
    """Year of the first of ``dates`` that isn't null; null where it can't be read as ISO or one of ``formats``."""
    first = F.coalesce(*[col(d).cast("string") for d in dates])
    return F.year(F.coalesce(F.try_to_timestamp(first), *[F.try_to_timestamp(first, F.lit(f)) for f in formats]))


@F.pandas_udf(IntegerType())
def free_form_year(date: pd.Series) -> pd.Series:
    """Year of a date as people write them (March 5, 2020), for what year() can't read."""
    from dateutil import parser

    def one(x):
        try:
            return None if x is None else parser.parse(x).year
        except (ValueError, OverflowError):
            return None

    return date.map(one).astype("Int32")


def lookup(df: DataFrame, key: str, within: str = "metadata") -> Column:
    """The value of ``key`` as a string: a column of df, else a field of the struct or map ``within``, else empty.

    Presence decides, as with a dictionary: a column that is there and null gives null. A map is asked row by row.
    """
    if key in df.columns:
        return F.col(key).cast("string")
    if within in df.columns:
        kind = df.schema[within].dataType
        if isinstance(kind, StructType) and key in kind.names:
            return F.col(within).getField(key).cast("string")
        if isinstance(kind, MapType):
            return F.when(F.map_contains_key(within, F.lit(key)), F.col(within)[key].cast("string")).otherwise("")
    return F.lit("")


__all__ = ["LONG", "blake2b_hex", "blank", "free_form_year", "held_out", "lookup", "strip", "text_key", "too_long", "year"]
