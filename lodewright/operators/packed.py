"""Hashes of n-grams, counted as sorted arrays that are dealt to parts: no row and no string is made for each n-gram."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import ngram_pieces

#: Bytes of input for each part, and n-grams that a task holds before it makes arrays of different ones.
PART_BYTES, HELD = 4 << 20, 2_000_000

Arrays = tuple[np.ndarray, np.ndarray, np.ndarray]
_PACKED = "n int, part int, hashes binary, others binary, counts binary"


def _parts(df: DataFrame) -> int:
    """How many parts the hashes of df are dealt to, by the size that Spark knows or guesses."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 200 if size >= 1 << 60 else min(max(16, size // PART_BYTES), 1 << 20)


def alike(h: np.ndarray, g: np.ndarray, counts: np.ndarray) -> Arrays:
    """Different pairs (h, g) with their counts added up, in the order of h."""
    if not len(h):
        return h, g, counts
    order = np.argsort(h)
    h, g, counts = h[order], g[order], counts[order]
    same, other = h[1:] == h[:-1], g[1:] != g[:-1]
    if (same & other).any():  # hardly ever: two n-grams have one h
        order = np.lexsort((g, h))
        h, g, counts = h[order], g[order], counts[order]
        same, other = h[1:] == h[:-1], g[1:] != g[:-1]
    starts = np.flatnonzero(np.append(True, ~same | other))
    return h[starts], g[starts], np.add.reduceat(counts, starts)


def packed(df: DataFrame, ns: tuple[int, ...], text: str, tokens: Callable[[str], Column]) -> DataFrame:
    """(n, part, hashes, others, counts): 64 and 32 bits of the hashes of each n-gram and how often a task met it, many to a row.

    The text is tokenized once for all ``ns``.
    """
    parts, rows = _parts(df), ngram_pieces(df, tokens(text), max(ns))
    columns = []
    for n in ns:
        own = rows.pieces[:n]
        columns += [F.when(own[-1].isNotNull(), F.xxhash64(*own)).alias(f"h{n}"), F.hash(*own).alias(f"g{n}")]
    schema = pa.schema([("n", pa.int32()), ("part", pa.int32()), *[(c, pa.binary()) for c in ("hashes", "others", "counts")]])

    def blobs(n: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, g = (np.concatenate(x) for x in zip(*held))
        h, g, counts = alike(h, g, np.ones(len(h), np.int64))
        part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # ranges, as h is sorted
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(part)).tolist()
        for low in range(0, len(cuts), 256):
            some = [slice(a, b) for a, b in zip(cuts[low : low + 256].tolist(), ends[low : low + 256])]
            made = [pa.array([x[s].tobytes() for s in some], pa.binary()) for x in (h, g, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(part[cuts[low : low + 256]].astype(np.int32)), *made], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {n: [] for n in ns}, 0
        for batch in batches:
            for n in ns:
                h, g = batch.column(f"h{n}"), batch.column(f"g{n}")
                if h.null_count:
                    h, g = h.drop_null(), g.filter(h.is_valid())
                # copies, as a batch's memory is used again
                held[n].append((h.to_numpy().view(np.uint64).copy(), g.to_numpy().view(np.uint32).copy()))
                size += len(h)
            if size >= HELD:
                for n in ns:
                    yield from blobs(n, held[n])
                held, size = {n: [] for n in ns}, 0
        for n in ns:
            if held[n]:
                yield from blobs(n, held[n])

    return rows.df.select(*columns).mapInArrow(run, _PACKED)


def by_part(rows: DataFrame, work: Callable[[], Callable[[int, Arrays], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """work()(n, arrays) of all that is in a part; ``work`` is called once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, least, of_task = None, [], 0, HELD, work()

        def together() -> Arrays:
            return alike(*(np.concatenate(x) for x in zip(*held)))

        for batch in batches:
            for n, part, *own in zip(*(batch.column(c) for c in ("n", "part", "hashes", "others", "counts"))):
                key = n.as_py(), part.as_py()
                if key != now:
                    if now is not None and (out := of_task(now[0], together())) is not None:
                        yield out
                    now, held, size, least = key, [], 0, HELD
                held.append(tuple(np.frombuffer(x.as_py(), t) for x, t in zip(own, (np.uint64, np.uint32, np.int64))))
                size += len(held[-1][0])
                if size >= least:
                    held = [together()]
                    size = len(held[0][0])
                    least = 2 * size + HELD
        if now is not None and (out := of_task(now[0], together())) is not None:
            yield out

    return rows.repartition("n", "part").sortWithinPartitions("n", "part").mapInArrow(run, schema)


def distinct_counts(df: DataFrame, ns: tuple[int, ...], text: str, tokens: Callable[[str], Column]) -> DataFrame:
    """(n, m): rows to add up to the number of different n-grams."""

    def work() -> Callable[[int, Arrays], pa.RecordBatch]:
        return lambda n, arrays: pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([len(arrays[0])], pa.int64())], names=["n", "m"])

    return by_part(packed(df, ns, text, tokens), work, "n int, m long")


def frequent(df: DataFrame, n: int, k: int, threshold: int, text: str, tokens: Callable[[str], Column]) -> DataFrame:
    """(h, count): hashes that occur more than ``threshold`` times; a task leaves out those that k others of it exceed."""

    def work() -> Callable[[int, Arrays], pa.RecordBatch | None]:
        best = np.zeros(0, np.int64)

        def of_task(_: int, arrays: Arrays) -> pa.RecordBatch | None:
            nonlocal best
            h, starts = np.unique(arrays[0], return_index=True)  # by h alone, which is what n-grams are sought by
            counts = np.add.reduceat(arrays[2], starts)
            some = counts > threshold
            h, counts = h[some], counts[some]
            best = np.sort(np.append(best, counts))[-k:]
            some = counts >= (best[0] if len(best) == k else 0)
            if not some.any():
                return None
            return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(counts[some])], names=["h", "count"])

        return of_task

    return by_part(packed(df, (n,), text, tokens), work, "h long, count long")
