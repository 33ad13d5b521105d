"""TFRecord files of tf.train.Example messages as rows."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def framed(data: bytes) -> Iterator[bytes]:
    """The records of a TFRecord file: length, its checksum, data, its checksum. Checksums aren't verified."""
    at = 0
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a record is cut off")
        size = struct.unpack_from("<Q", data, at)[0]
        if at + 16 + size > len(data):
            raise ValueError("a record is cut off")
        yield data[at + 12 : at + 12 + size]
        at += 16 + size


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, content) of a protobuf message's fields that have a length; others are passed over."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 2:
            size, at = _varint(data, at)
            yield tag >> 3, data[at : at + size]
            at += size
        elif tag & 7 == 0:
            _, at = _varint(data, at)
        else:
            at += {1: 8, 5: 4}[tag & 7]


def first_bytes(example: bytes) -> dict[str, bytes]:
    """name -> first value of each feature of an Example that is a list of byte strings."""
    out: dict[str, bytes] = {}
    for _, features in _fields(example):
        for _, entry in _fields(features):
            pair = dict(_fields(entry))  # 1: name, 2: feature
            for kind, values in _fields(pair.get(2, b"")):
                found = next((v for n, v in _fields(values) if n == 1), None) if kind == 1 else None
                if found is not None:
                    out[pair[1].decode("utf-8", "replace")] = found
    return out


def tfrecords(spark: SparkSession, paths: str | list[str], features: Iterable[str] = ("text", "url", "timestamp"), glob: str = "*tfrecord*") -> DataFrame:
    """A row for each record, with the features as strings; one that is missing is null. gzip files are told by their start.

    A file is one task's and at most 2 GB, as Spark hands it over whole.
    """
    names = list(features)
    schema = ", ".join(f"`{n}` string" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                rows: list[dict] = []
                for record in framed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    rows.append(first_bytes(record))
                    if len(rows) == 1000:
                        yield _table(rows, names)
                        rows = []
                yield _table(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(paths)
    return files.select("content").mapInArrow(run, schema)


def _table(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n].decode("utf-8", "replace") if n in r else None for r in rows], pa.string()) for n in names], names=names)


def shard_names(prefix: str, count: int, name: str = "train", suffix: str = ".parquet") -> list[str]:
    """Paths of the ``count`` shards of a data set, name-00000-of-00004.parquet and so on, below ``prefix``."""
    return [f"{prefix.rstrip('/')}/{name}-{i:05d}-of-{count:05d}{suffix}" for i in range(count)]
