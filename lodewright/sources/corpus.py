"""Reading corpora: JSON lines in any compression, Parquet, lexicons, field tables and templates."""

from __future__ import annotations

import ast
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

GLOB = "*.json*.gz"
TEXT = StructType([StructField("text", StringType())])


def expand(spark: SparkSession, paths: Iterable[str], glob: str = GLOB) -> list[str]:
    """The files behind ``paths``: files as given, directories as all files below them that match ``glob``, in order.

    Works on any file system that Spark reads. No file at all is an error.
    """
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    pattern = jvm.org.apache.hadoop.fs.GlobPattern(glob)
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(conf)
        if fs.getFileStatus(where).isFile():
            out.append(p)
            continue
        files, found = fs.listFiles(where, True), []
        while files.hasNext():
            f = files.next().getPath()
            if pattern.matches(f.getName()):
                found.append(f.toString())
        if not found:
            raise FileNotFoundError(f"no {glob} files below {p}")
        out += sorted(found)
    if not out:
        raise FileNotFoundError("no input files")
    return out


def limited_files(files: list[str], file_limit: int | None = None) -> list[str]:
    """The first ``file_limit`` files."""
    if file_limit is None:
        return files
    if file_limit < 1:
        raise ValueError("file limit must be 1 or more")
    return files[:file_limit]


def numbered(df: DataFrame, *group: str) -> DataFrame:
    """df with ``line``, the number of a row in its ``group`` from 1, by the order in which Spark reads it.

    monotonically_increasing_id() follows the order of a file's lines; the window makes it start anew with each file,
    as several small files may share one partition. A compressed file is one task anyway.
    """
    marked = df.withColumn("_id", F.monotonically_increasing_id())
    return marked.withColumn("line", F.row_number().over(Window.partitionBy(*group).orderBy("_id")).cast("long")).drop("_id")


def lines(spark: SparkSession, paths: Iterable[str], limit: int | None = None, file_limit: int | None = None, glob: str = GLOB, positions: bool = False) -> DataFrame:
    """(path, raw[, line]) of every line; ``limit`` keeps the first lines of each file, not of the whole corpus."""
    files = limited_files(expand(spark, paths, glob), file_limit)
    raw = spark.read.text(files).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    if limit is None and not positions:
        return raw
    out = numbered(raw, "path")
    out = out.where(F.col("line") <= limit) if limit is not None else out
    return out if positions else out.drop("line")


def documents(spark: SparkSession, paths: Iterable[str], schema: StructType = TEXT, mode: str = "FAILFAST", limit: int | None = None, file_limit: int | None = None, glob: str = GLOB, positions: bool = False) -> DataFrame:
    """JSON lines as rows: only the fields of ``schema`` are decoded; a missing or null text is a null.

    FAILFAST ends the job at a line that is no JSON; PERMISSIVE keeps it as nulls. With ``positions``, path, line and
    raw (the line itself) come too; without them or a limit this is Spark's own JSON source, which prunes columns.
    """
    if positions or limit is not None:
        found = lines(spark, paths, limit, file_limit, glob, positions=True)
        parsed = found.withColumn("_j", F.from_json("raw", schema, {"mode": mode}))
        out = parsed.select("path", "line", "raw", "_j.*")
        return out if positions else out.select(*schema.names)
    files = limited_files(expand(spark, paths, glob), file_limit)
    return spark.read.schema(schema).option("mode", mode).json(files)


def json_lines(spark: SparkSession, paths: str | list[str], schema: StructType | None = None) -> DataFrame:
    """JSON lines, plain or compressed, from any file system; the schema is inferred only if none is given."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(paths)


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def renamed_text(df: DataFrame, field: str) -> DataFrame:
    """df with the column ``field`` called text, as the analyses expect."""
    return df if field == "text" else df.drop("text").withColumnRenamed(field, "text")


def lexicon(spark: SparkSession, path: str, word: str = "word", label: str = "categorization") -> dict[str, list[str]]:
    """label -> words in the order of a CSV file with a header. Words are fragments of regular expressions.

    A lexicon becomes one pattern for each label, so it is read on the driver.
    """
    rows = spark.read.option("header", True).csv(path).select(F.col(word).alias("w"), F.col(label).alias("l")).where("w is not null and l is not null").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["l"], []).append(r["w"])
    return out


def benchmark_fields(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(dataset, sub_dataset, fields) of a TSV file in which fields is a list literal; rows with ``least`` fields or more."""

    @F.udf("array<string>")
    def parsed(x: str | None):  # a few hundred rows of configuration
        try:
            found = ast.literal_eval(x) if x else []
        except (ValueError, SyntaxError):
            return None
        return [str(f) for f in found] if isinstance(found, (list, tuple)) else None

    table = spark.read.option("sep", "\t").schema("dataset string, sub_dataset string, fields string").csv(path)
    return table.withColumn("fields", parsed("fields")).where(F.size("fields") >= least)


def counted_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, count) of JSON lines, most frequent first; ties by key."""
    return spark.read.schema(f"`{key}` string, count long").json(path).orderBy(F.desc("count"), key)
