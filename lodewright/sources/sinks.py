"""Writing counts, attributes, documents and search tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .scratch import written


def write_json(df: DataFrame, path: str, force: bool = False, compression: str | None = None) -> None:
    """JSON lines at ``path``, which must not be there unless ``force``; then it is replaced as a whole."""
    writer = df.write.mode("overwrite" if force else "errorifexists")
    (writer.option("compression", compression) if compression else writer).json(path)


def auto_name(out: str, n: int, k: int, hashes: int | None = None, limit: int | None = None, seed: int | None = None) -> str:
    """``out`` itself if it has an extension, else a name made of the parameters inside it."""
    if os.path.splitext(out)[1]:
        return out
    parts = [f"n{n}", f"k{k}"] + ([f"h{hashes}"] if hashes is not None else []) + ([f"-limit{limit}"] if limit is not None else []) + ([f"-seed{seed}"] if seed is not None else [])
    return os.path.join(out, "-".join(parts) + ".jsonl")


def shown(rows: list, total: int | None = None) -> list[str]:
    """Ranked n-grams as people read them."""
    total = total or len(rows)
    return [f'[{i}/{total}] "{r["string"]}" (count = {r["count"]:,d})' for i, r in enumerate(rows, 1)]


def json_records(df: DataFrame) -> DataFrame:
    """One column of JSON strings, one for each row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def attributes(flagged: DataFrame) -> DataFrame:
    """id, source, contaminated: the flags without the documents."""
    return flagged.select("id", "source", "contaminated")


def survivors(flagged: DataFrame) -> DataFrame:
    """The documents that carry no flag."""
    return flagged.where(~F.col("contaminated")).drop("contaminated")


def search_rows(df: DataFrame, id_field: str | None = None, most: int | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """What a search table holds: id, text and the other columns but ``skip``.

    id is ``id_field``, or file name and number of the line from 0 (columns path and line, from documents()). Text is
    cut to ``most`` code points; null and empty texts are left out. The first row of an id stays: by path and line
    where they are there, else by text.
    """
    if id_field is None:
        name = F.concat(F.regexp_extract("path", r"([^/]*)$", 1), F.lit("-"), (F.col("line") - 1).cast("string"))
        out = df.withColumn("id", name)
    else:
        out = df.withColumn("id", F.col(id_field).cast("string"))
    out = out.where("text is not null and text != ''")
    order = [c for c in ("path", "line") if c in df.columns] or ["text"]
    out = out.withColumn("_at", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_at = 1")
    if most is not None:
        out = out.withColumn("text", F.substring("text", 1, most))
    return out.drop("_at", "path", "line", "raw", *skip)


def normalised(df: DataFrame, source: str, added: str, ids: str = "id", text: str = "text", lang: str = "lang", timestamp: str | None = None) -> DataFrame:
    """id, text, lang, metadata, timestamp, source, added: every other column goes into the struct metadata.

    lang is lower-cased with - for white space.
    """
    rest = [c for c in df.columns if c not in (ids, text, lang)]
    return df.select(
        F.col(ids).cast("string").alias("id"),
        F.col(text).alias("text"),
        F.regexp_replace(F.lower(F.col(lang)), r"\s", "-").alias("lang"),
        (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("metadata"),
        F.lit(timestamp).cast("string").alias("timestamp"),
        F.lit(source).alias("source"),
        F.lit(added).alias("added"),
    )


def in_batches(df: DataFrame, path: str, rows: int, force: bool = False) -> None:
    """gzip JSON lines of at most ``rows`` rows a file."""
    df.write.mode("overwrite" if force else "errorifexists").option("compression", "gzip").option("maxRecordsPerFile", rows).json(path)


def resumed_batches(df: DataFrame, path: str, rows: int, key: str = "id") -> int:
    """Adds to ``path`` the rows of df whose ``key`` isn't there yet, as in_batches() writes them; the number of rows added.

    A job that ended early leaves no half-written batch behind, so calling this again takes up where it stopped. Rows
    without a key are taken in a first call only.
    """
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    new = df
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        there = spark.read.schema(StructType([df.schema[key]])).json(path).select(key).distinct()
        new = df.where(F.col(key).isNotNull()).join(there, key, "left_anti")
    seen = Observation()
    new.observe(seen, F.count("*").alias("n")).write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", rows).json(path)
    return seen.get["n"]


def in_chunks(df: DataFrame, chunks: int, order: str) -> DataFrame:
    """df with ``chunk`` from 0: equal runs of rows by ``order``, the last takes the remainder.

    The rows are dealt to partitions by range and written once with their partition and place; ranks come from that
    table's counts by partition, not from one global window.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    placed = written(ranged, "ranged")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, at = {}, 0
    for part in sorted(sizes):
        before[part] = at
        at += sizes[part]
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "_part int, _before long")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_id")) - 1
    size = max(1, at // chunks)
    return placed.join(starts, "_part").withColumn("chunk", F.least(F.floor(rank / F.lit(size)), F.lit(chunks - 1)).cast("int")).drop("_part", "_id", "_before")


def compacted(df: DataFrame, files: int) -> DataFrame:
    """df in ``files`` partitions, joined from neighbours without a shuffle."""
    return df.coalesce(files)


def id_list(df: DataFrame, path: str, force: bool = False) -> None:
    """The ids alone as Parquet, for random access."""
    df.select("id").write.mode("overwrite" if force else "errorifexists").parquet(path)
