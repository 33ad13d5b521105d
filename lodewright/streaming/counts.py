"""The count analyses over streams: the same expressions, with results updated as documents arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, glob: str = "*.json*", files: int = 1000) -> DataFrame:
    """JSON-lines files as they appear below ``path``, at most ``files`` of them a batch."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).json(path)


def counting(stream: DataFrame, analysis: Callable[[DataFrame], DataFrame], name: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs a count analysis (schemes, locations, lengths, ...) on a stream; the view ``name`` holds the counts so far.

    Every batch is written by the executors below ``checkpoint`` before the view moves on to it, and the one before
    last goes, as readers may be in the middle of the last: no count passes through the driver.
    """
    spark = stream.sparkSession
    counts = f"{checkpoint.rstrip('/')}-counts"

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{counts}/{number}"
        batch.write.mode("overwrite").parquet(path)
        spark.read.schema(batch.schema).parquet(path).createOrReplaceTempView(name)
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{counts}/{number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    writer = analysis(stream).writeStream.outputMode("complete").foreachBatch(keep).queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed(stream: DataFrame, key: Column, time: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, count) in tumbling windows of event time; a window is final ``late`` after its end."""
    marked = stream.withWatermark(time, late)
    return marked.groupBy(F.window(time, size).alias("w"), key.alias("key")).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), "key", "count")
