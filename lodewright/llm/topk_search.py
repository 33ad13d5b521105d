"""Exact top-k inner products: tiles of queries against shards of all rows, with lists merged in a tree."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, saved, small_batches

SCALE, K, EVERY = 64, 20, 20
#: Bytes of a tile of queries, which is broadcast; more queries make more tiles, each a pass over the rows.
TILE_BYTES = 16 << 20
#: Partial lists that one merging step takes in.
FAN_IN = 16
_LONG = 2**63 - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); vectors null or with null or non-finite components are left out.

    So are vectors without a vec_id, and those of which scale * x is beyond the range of a double.
    """
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.col("x").isNotNull() & F.col("vec_id").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < F.lit(float("inf"))))
    # kept as doubles, which hold such whole numbers exactly
    return x.where(fine).select("vec_id", F.transform("x", lambda c: _floor(c * scale)).alias("v"))


def _floor(c: F.Column) -> F.Column:
    """floor() of a double as a double: Spark's floor() gives a long, which large values don't fit."""
    return F.when(F.abs(c) < F.lit(2.0**52), F.floor(F.when(F.abs(c) < F.lit(2.0**52), c).otherwise(F.lit(0.0))).cast("double")).otherwise(c)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, ids, row numbers, matrix) for each dimension that occurs in the batch."""
    (ids, rows), v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row")), batch.column("v")
    sizes, flat = np.diff(np.asarray(v.offsets)), v.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), ids[at], rows[at], flat[(starts[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64; beyond the long range they stay at its ends."""
    most = (np.abs(q).max(initial=0)) * (np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in c], object).reshape(c.shape).T
    return np.clip(big, -_LONG - 1, _LONG).astype(np.int64) if big.size else np.zeros((len(q), len(c)), np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one list: higher score first, then smaller id. Partial selection, then a sort of what is left."""
    if len(ids) > k:
        edge = -np.partition(-scores, k - 1)[k - 1]
        keep = scores >= edge
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products among all other rows.

    Both tables hold vec_id and v from quantised(), and may hold ``row``, a number of a row that tells those with one
    vec_id apart: then each row is a query of its own, and only it is left out of its results. Without it, rows with
    the query's vec_id are never its result, and a vec_id that is repeated is searched once, with its first vector in
    the order of components. Ties go to the smaller vec_id, and vectors of another length than the query's are not
    compared with it. Repeated candidates each count. Scores beyond the range of a long stay at its ends.

    The queries are taken in tiles of a fixed number of bytes, so that what is broadcast doesn't grow; every tile meets
    every shard of candidates in one matrix product, each task returns one list a query, and the lists of tasks merge
    in steps of FAN_IN, so no task holds more than the lists of a query. A tile's lists and its broadcast go before the
    next tile starts.
    """
    spark = candidates.sparkSession
    small_batches(spark)
    if "row" not in candidates.columns or "row" not in queries.columns:
        queries = queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("row", F.col("vec_id"))
        candidates = candidates.select("vec_id", F.col("vec_id").alias("row"), "v")
    asked = saved(queries.select("vec_id", "row", "v"), "queries")
    candidates = saved(candidates.select("vec_id", "row", "v"), "candidates")
    size = asked.agg(F.sum(F.size("v") * 8 + 24)).first()[0]
    tiles = max(1, -(-int(size or 0) // tile_bytes))
    merged = []
    for t in range(tiles):
        own = asked if tiles == 1 else asked.where(F.pmod(F.xxhash64("row"), F.lit(tiles)) == t)
        blocks: dict[int, list] = {}
        for d, *block in (x for b in own.toArrow().combine_chunks().to_batches() if b.num_rows for x in _rows(b)):
            blocks.setdefault(d, []).append(block)
        block = spark.sparkContext.broadcast({d: tuple(map(np.concatenate, zip(*x))) for d, x in blocks.items()})
        lists = saved(candidates.mapInArrow(_search(block, k), "query_id long, row long, task int, ids array<long>, scores array<long>"), "lists")
        merged.append(saved(_merged(lists, k), "top"))
        release(lists)
        block.destroy()
    release(asked, candidates)
    return reduce(DataFrame.unionByName, merged)


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best: dict[int, list] = {d: [(np.zeros(0, np.int64),) * 2] * len(ids) for d, (ids, _, _) in block.value.items()}
        for batch in batches:
            for d, ids, rows, vectors in _rows(batch) if batch.num_rows else ():
                if d not in best:
                    continue
                _, query_rows, q = block.value[d]
                for at in range(0, len(q), 512):
                    scores = products(q[at : at + 512], vectors)
                    most = scores.max(axis=1, initial=-_LONG - 1)
                    for j, own in enumerate(scores, at):
                        if len(best[d][j][1]) == k and most[j - at] < best[d][j][1][-1]:
                            continue
                        other = rows != query_rows[j]
                        near = _best(ids[other], own[other], k)
                        old = best[d][j]
                        best[d][j] = _best(np.concatenate([old[0], near[0]]), np.concatenate([old[1], near[1]]), k)
        task = TaskContext.get().partitionId()
        for d, lists in best.items():
            ids, rows, _ = block.value[d]
            for at in range(0, len(lists), 4096):
                own = lists[at : at + 4096]
                columns = [pa.array(ids[at : at + 4096]), pa.array(rows[at : at + 4096]), pa.array(np.full(len(own), task, np.int32)), *(pa.array([x[i] for x in own], pa.list_(pa.int64())) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "row", "task", "ids", "scores"])

    return run


def _merged(parts: DataFrame, k: int) -> DataFrame:
    one = F.arrays_zip("scores", "ids")
    lists = parts.select("query_id", "row", "task", F.transform(one, lambda x: F.struct(F.bitwise_not(x["scores"]).alias("down"), x["ids"].alias("vec_id"))).alias("top"))
    most = parts.agg(F.max("task")).first()[0]
    width = 1 + (most or 0)
    while True:
        width = -(-width // FAN_IN)
        key = [F.col("query_id"), F.col("row")] + ([F.floor(F.col("task") / FAN_IN).cast("int").alias("task")] if width > 1 else [F.lit(0).alias("task")])
        lists = lists.groupBy(*key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if width <= 1:
            break
    out = lists.select("query_id", F.posexplode("top").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.bitwise_not("x.down").alias("score"))


def search(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """The rows whose vec_id is divisible by ``every`` as queries against all rows but themselves."""
    v = saved(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbers stay once written
    out = top_k(v, v.where(F.col("vec_id") % every == 0), k)
    release(v)
    return out
