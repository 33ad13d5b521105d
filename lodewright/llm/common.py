"""What the operators of this subpackage share: scratch tables, Arrow batches, row identity and connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of an Arrow batch that goes to a Python worker; a batch holds one row at least, however long.
BATCH_BYTES = 2 << 20

_own_dirs: dict[str, str] = {}
_LIBC = ctypes.CDLL(None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, or one of our own where that is unset.

    A folder of our own is local: it is refused unless the driver is the only machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="lodewright-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors.

    The files go when the driver's JVM ends, or earlier by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the files of saved() tables that nothing reads any more, and lets Spark drop the shuffles behind them."""
    for df in tables:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files stay on the executors' disks until the driver's JVM notices that their plan is gone.

    What Python has let go of, the JVM learns within a second.
    """
    gc.collect()
    time.sleep(1.2)
    spark.sparkContext._jvm.System.gc()
    if hasattr(_LIBC, "malloc_trim"):  # what the driver's Python has freed goes back to the system
        _LIBC.malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Long texts must not meet in one Arrow batch: its bytes are bounded, not only its rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def by_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch; it returns a dict of columns in the order of the schema."""
    small_batches(df.sparkSession)
    kinds = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


class Veil:
    """A caller's table under column names of our own (c0, c1, ...), so that no name of the caller's can clash.

    Names are found as Spark finds them: in any case, the same spelling first. Repeated names are different columns.
    """

    def __init__(self, docs: DataFrame):
        self.schema, self.names = docs.schema, docs.columns
        self.own = [f"c{i}" for i in range(len(self.names))]
        self.df = docs.toDF(*self.own)

    def at(self, name: str) -> str:
        for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
            for c, own in zip(self.names, self.own):
                if same(c):
                    return own
        raise ValueError(f"a column {name} is needed; there are {', '.join(self.names)}")

    def col(self, name: str) -> F.Column:
        return F.col(self.at(name))

    def keyed(self) -> DataFrame:
        """df with _d, _n and _th: see keyed()."""
        d, t = self.col("doc_id"), self.col("text")
        return self.df.withColumns({"_d": F.coalesce(d.cast("long"), F.lit(0)), "_n": d.isNull(), "_th": F.xxhash64(t, t.isNull())})

    def fields(self, *without: str) -> StructType:
        """Our names with the caller's kinds, without the columns so named."""
        return StructType([StructField(own, f.dataType, f.nullable) for own, f in zip(self.own, self.schema) if f.name not in without])

    def back(self, df: DataFrame, added: tuple[str, ...] = ()) -> DataFrame:
        """The caller's columns under their names, those called like added ones left out, and then the added ones."""
        return df.select(*[F.col(own).alias(name) for own, name in zip(self.own, self.names) if name not in added], *added)


def text_hash(text: str = "text") -> F.Column:
    """Tells apart rows that share a doc_id; a null text has a hash of its own."""
    return F.xxhash64(F.col(text), F.col(text).isNull())


def keyed(docs: DataFrame) -> DataFrame:
    """Columns that identify a row and are never null: _d and _n (doc_id or 0, and whether it is null), _th; and text, as bytes."""
    veil = Veil(docs)
    return veil.keyed().select(*KEY, veil.col("text").cast("binary").alias("text"))


KEY = ["_d", "_n", "_th"]


def least_share(key: F.Column, share: float) -> F.Column:
    """Whether a 64-bit hash is among the least ``share`` of all hashes: a sample that needs no sorting."""
    return F.lit(True) if share >= 1 else key < F.lit(int(share * 2**64) - 2**63)


def text_once(veil: Veil) -> tuple[DataFrame, str, Callable[[pa.RecordBatch], list[str]]]:
    """(rows, column, texts of a batch): the caller's columns, and the text, which goes to Python once: as it is if it is a string."""
    own = veil.at("text")
    if isinstance(veil.schema[veil.own.index(own)].dataType, StringType):
        return veil.df, own, lambda batch: [t or "" for t in batch.column(own).to_pylist()]
    rows = veil.df.withColumn("_t", F.col(own).cast("binary"))
    return rows, "_t", lambda batch: [(t or b"").decode("utf-8", "replace") for t in batch.column("_t").to_pylist()]


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that it reaches.

    Alternating large-star and small-star steps: each is two shuffles keyed by node, the edge table is written to the
    shared folder after each round, and the rounds grow with the logarithm of the longest path. Only the number of
    edges and a checksum reach the driver. Self-loops and nulls are ignored; an empty table gives an empty table.
    """
    now = saved(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _mark(nxt)
        release(now)
        now = nxt
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash fingerprints of consecutive runs of 64-bit hashes: a bit is 1 if set in over half of a run's hashes.

    counts: how many hashes each run has. A run of none gives 0. Byte-wide counters in one 64-bit word sum 255 hashes
    at a time, so that no bit matrix is built.
    """
    counts = np.asarray(counts, np.int64)
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    runs = counts[some]
    pieces = -(-runs // 255)
    first = np.cumsum(runs) - runs
    piece_of = np.repeat(np.arange(len(runs)), pieces)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[piece_of] + 255 * nth
    ends = np.cumsum(pieces) - pieces
    got = np.zeros(len(runs), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), ends, axis=0)
        over = (2 * ones > runs[:, None]).astype(np.uint64)
        for j in range(8):
            got |= over[:, j] << np.uint64(8 * j + k)
    out[some] = got
    return out
