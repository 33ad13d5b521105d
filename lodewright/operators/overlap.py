"""Exact duplicates inside a corpus and overlaps between corpora, by keys (hashes of texts, or URLs)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

#: Data sets whose subsets are all reported at most: 2 to this power rows.
MOST_DATASETS = 16


def overlap_pair(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """Keys that are in both tables, once each."""
    return a.select(key).intersect(b.select(key))


def subset_sizes(keyed: DataFrame, datasets: list[str], dataset: str = "dataset", key: str = "key", least: int = 1) -> DataFrame:
    """(datasets, size): for every subset of ``datasets`` how many different keys all of its members have.

    One shuffle for all subsets: each key gets the set of data sets that it is in as bits, keys are counted by that set,
    and the counts of a set are added to all of its subsets. Names are joined by commas; subsets of fewer than ``least``
    members and empty intersections are left out.
    """
    if len(datasets) > MOST_DATASETS:
        raise ValueError(f"at most {MOST_DATASETS} data sets")
    bit = F.lit(None).cast("long")
    for i, name in enumerate(datasets):
        bit = F.when(F.col(dataset) == name, F.lit(1 << i)).otherwise(bit)
    masks = keyed.select(F.col(key).alias("k"), bit.cast("long").alias("b")).where("b is not null").groupBy("k").agg(F.bit_or("b").alias("mask"))
    total = np.zeros(1 << len(datasets), np.int64)
    for r in masks.groupBy("mask").agg(F.count("*").alias("n")).collect():  # one row for each set of data sets
        total[r["mask"]] = r["n"]
    for i in range(len(datasets)):  # each set's count goes to the set without i
        both = total.reshape(-1, 2, 1 << i)
        both[:, 0] += both[:, 1]
    rows = [(",".join(d for i, d in enumerate(datasets) if m >> i & 1), int(total[m])) for m in range(1, len(total)) if total[m] and m.bit_count() >= least]
    return keyed.sparkSession.createDataFrame(rows, "datasets string, size long")


def duplicate_keys(counted: DataFrame) -> DataFrame:
    """Keys with a count above 1, from text_keys() or url_keys()."""
    return counted.where(F.col("count") > 1).select("key")


def duplicate_summary(counted: DataFrame, *group: str) -> DataFrame:
    """duplicates, total (documents), uniq_duplicates, uniq_total (keys) for each group of counted keys."""
    n, twice = F.col("count"), F.col("count") > 1
    return counted.groupBy(*group).agg(
        F.coalesce(F.sum(F.when(twice, n)), F.lit(0)).cast("long").alias("duplicates"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total"),
        F.count(F.when(twice, 1)).alias("uniq_duplicates"),
        F.count("*").alias("uniq_total"),
    )


def keep_first(df: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """df with ``contaminated``: true for each copy of a text but the first by ``order``. Null texts are left out.

    The first of each text is a minimum that is aggregated before the shuffle, so a text with a great many copies
    doesn't gather in one task, as it would in a window; the join back is one that Spark can split.
    """
    rows = df.where(F.col(text).isNotNull()).withColumns({"_k": F.md5(text), "_o": F.struct(*order)})
    first = rows.groupBy("_k").agg(F.min("_o").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_k", "_first")
    marked = rows.join(first, "_k", "left").withColumn("contaminated", F.coalesce(F.col("_o") != F.col("_first"), F.lit(False)))
    return marked.drop("_k", "_o", "_first")


def flag_contaminated(df: DataFrame, blocklist: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """df with ``contaminated``: whether the MD5 of the text is in the blocklist. Null texts are left out."""
    block = blocklist.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    rows = df.where(F.col(text).isNotNull()).withColumn("_k", F.md5(text))
    return rows.join(block, "_k", "left").withColumn("contaminated", F.col("_hit").isNotNull()).drop("_k", "_hit")


def removed_by_source(flagged: DataFrame, source: str = "source") -> DataFrame:
    """(source, removed): flagged documents by source, ``no_source`` for a null."""
    return flagged.where("contaminated").groupBy(F.coalesce(F.col(source), F.lit("no_source")).alias("source")).agg(F.count("*").alias("removed"))


def top_duplicates(counted: DataFrame, k: int = 30) -> DataFrame:
    """The k keys with the most copies, ties to the greater key; keys that occur once are left out."""
    return counted.where(F.col("count") > 1).orderBy(F.desc("count"), F.desc("key")).limit(k)


def examples(df: DataFrame, wanted: DataFrame, order: list[str], keep: list[str], text: str = "text") -> DataFrame:
    """(key, count, keep..., text): the first document of each wanted key, with the count that the key came with."""
    rows = df.where(F.col(text).isNotNull()).select(F.md5(text).alias("key"), F.struct(*order).alias("_o"), F.struct(*keep, text).alias("_d"))
    first = rows.join(wanted, "key", "left_semi").groupBy("key").agg(F.min_by("_d", "_o").alias("_d"))
    return wanted.join(first, "key").select("key", "count", "_d.*").orderBy(F.desc("count"), F.desc("key"))


def numbered_copies(df: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """df with ``copy``, the number of a document among those with its text, by ``order``.

    Rows are dealt to partitions by ranges of text hash and order, and written once: a text with a great many copies
    spreads over several, whose counts are added up.
    """
    ranged = df.withColumn("_k", F.md5(text)).repartitionByRange("_k", *order).withColumn("_part", F.spark_partition_id())
    placed = written(ranged, "copies")
    sizes = placed.groupBy("_k", "_part").agg(F.count("*").alias("_n"))
    several = sizes.groupBy("_k").agg(F.count("*").alias("_parts")).where("_parts > 1").select("_k")
    earlier = F.sum("_n").over(Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.join(several, F.equal_null(sizes["_k"], several["_k"]), "left_semi").select("_k", "_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    own = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_k", "_part").orderBy(*order)))
    out = own.join(before.withColumnRenamed("_part", "_p").withColumnRenamed("_k", "_key"), F.equal_null(F.col("_k"), F.col("_key")) & (F.col("_part") == F.col("_p")), "left")
    return out.withColumn("copy", (F.col("_at") + F.coalesce("_before", F.lit(0))).cast("int")).select(*df.columns, "copy")
