"""Summary of a corpus: documents, tokens, bytes, and the shortest and longest documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import unicode_count
from ..sources.scratch import written


def _sized(df: DataFrame, keys: list[str], text: str, raw: str | None, count: Callable[[str], Column]) -> DataFrame:
    size = F.octet_length(F.col(raw)) + 1 if raw else F.octet_length(F.col(text))
    return df.select(*keys, count(text).alias("_tokens"), size.alias("_bytes"))


def summary(df: DataFrame, text: str = "text", raw: str | None = None, count: Callable[[str], Column] = unicode_count) -> DataFrame:
    """total_tokens, total_documents, total_bytes, document_max_tokens, document_min_tokens in one row.

    Rows with null text are documents without tokens; they are not the shortest. Bytes are those of the column ``raw``,
    the input line, and its line end; of the text where there are no lines. Without any text max and min are null.
    """
    t = F.col("_tokens")
    return _sized(df, [], text, raw, count).agg(
        F.coalesce(F.sum(t), F.lit(0)).cast("long").alias("total_tokens"),
        F.count("*").alias("total_documents"),
        F.coalesce(F.sum("_bytes"), F.lit(0)).cast("long").alias("total_bytes"),
        F.max(t).alias("document_max_tokens"),
        F.min(t).alias("document_min_tokens"),
    )


def extremes(df: DataFrame, keys: list[str], text: str = "text", count: Callable[[str], Column] = unicode_count) -> DataFrame:
    """kind (max or min), the columns ``keys``, tokens: all documents with the most and all with the fewest tokens."""
    # counted once: a plan without the table would count in both sides of the join, and again in each side's filter
    sized = written(_sized(df.where(F.col(text).isNotNull()), keys, text, None, count).select(*keys, "_tokens"), "sizes").where("_tokens is not null")
    ends = sized.agg(F.max("_tokens").alias("_max"), F.min("_tokens").alias("_min"))
    ends = ends.select(F.inline(F.array(F.struct(F.lit("max").alias("kind"), F.col("_max").alias("_tokens")), F.struct(F.lit("min").alias("kind"), F.col("_min").alias("_tokens")))))
    return sized.join(F.broadcast(ends), "_tokens").select("kind", *keys, F.col("_tokens").alias("tokens"))
