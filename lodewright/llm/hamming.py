"""Links between 64-bit fingerprints at few differing bits, found through equal segments, without listing all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

SEGMENTS, WIDTH = 4, 16
#: Fingerprints in one tile of a bucket; a larger bucket is cut into pairs of chunks, one task's work each.
TILE = 8192
#: Buckets up to this size are compared many at once, pair by pair; larger ones by a search that skips what it has met.
SMALL = 96
_LOW = np.uint64(0xFFFF)


def segment_bits(x: np.ndarray, i: int) -> np.ndarray:
    return np.bitwise_count((x >> np.uint64(WIDTH * (i % SEGMENTS))) & _LOW)


def ring(x: np.ndarray, i: int, radius: int) -> np.ndarray:
    """Whether differences x pass: chains of 1, 2, ... consecutive segments from i stay within l * radius / SEGMENTS bits.

    If x has at most radius bits, then at least one start i passes (the pigeonring principle), so that testing every
    start loses no link. The last chain is the whole word, the full Hamming check.
    """
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for n in range(1, SEGMENTS + 1):
        total = total + segment_bits(x, i + n - 1)
        ok &= total * SEGMENTS <= n * radius
        if not ok.any():
            break
    return ok


def within(x: np.ndarray, i: int, radius: int) -> np.ndarray:
    """The full Hamming check alone: the plain pigeonhole test, as buckets agree in a segment already."""
    return np.bitwise_count(x) <= radius


def any_ring(x: np.ndarray, i: int, radius: int) -> np.ndarray:
    """ring() from any start, for buckets that don't agree in a segment."""
    return np.logical_or.reduce([ring(x, start, radius) for start in range(SEGMENTS)])


def close_pairs(group: np.ndarray, values: np.ndarray, seg: np.ndarray, radius: int, test: Callable = within) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that pass in many small groups at once: row j against row j + d of the same group."""
    d, left = 1, np.arange(len(group))
    while True:
        left = left[left + d < len(group)]
        left = left[group[left + d] == group[left]]
        if not len(left):
            return
        x = values[left] ^ values[left + d]
        if test is within:
            near = left[np.bitwise_count(x) <= radius]
        else:
            near = np.concatenate([left[seg[left] == i][test(x[seg[left] == i], i, radius)] for i in range(SEGMENTS)])
        if len(near):
            yield near, near + d
        d += 1


def find(up: dict, x):
    """The root of x in a forest of nodes, paths halved on the way; a node that isn't in it is its own root."""
    while (y := up.get(x, x)) != x:
        z = up.get(y, y)
        up[x] = z
        x = z
    return x


def _forest(values: np.ndarray, halves: np.ndarray, whole: bool, i: int, radius: int, test: Callable) -> tuple[list, list]:
    """A spanning forest of the links in one tile: a search by breadth that meets each fingerprint once."""
    left, a, b = np.arange(len(values)), [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step, front = front[:64], front[64:]
            for at in step:
                hit = test(values[left] ^ values[at], i, radius)
                if not whole:
                    hit &= halves[left] != halves[at]
                if hit.any():
                    new = left[hit]
                    left = left[~hit]
                    a += [values[at]] * len(new)
                    b += values[new].tolist()
                    front = np.concatenate([front, new])
                if not len(left):
                    break
    return a, b


def _small(keys: np.ndarray, seg: np.ndarray, values: np.ndarray, radius: int, test: Callable) -> tuple[list, list]:
    """Links in many small buckets at once, without those between values that are joined already."""
    up: dict[int, int] = {}
    a, b = [], []
    for i, j in close_pairs(keys, values, seg, radius, test):
        for x, y in zip(values[i].tolist(), values[j].tolist()):
            p, q = find(up, x), find(up, y)
            if p != q:
                up[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
    return a, b


def links(fingerprints: DataFrame, radius: int, test: Callable = ring, tile: int = TILE) -> DataFrame:
    """(a, b) longs that join the distinct fingerprints (column fp) exactly as all pairs at radius bits or fewer would.

    Every fingerprint goes to a bucket for each of its four segments. A pair at 3 bits or fewer shares one. A bucket of
    more than ``tile`` fingerprints is cut into chunks, and each pair of chunks is a tile, so no task holds an unbounded
    bucket. In a tile only a spanning forest is returned, at most one link for each fingerprint, however many pairs are
    close. radius may be 0 to 3.
    """
    if not 0 <= radius < SEGMENTS:
        raise ValueError("radius must be below the number of segments")
    cut = F.array(*[F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned("fp", WIDTH * i).bitwiseAND(F.lit(0xFFFF)).alias("value")) for i in range(SEGMENTS)])
    rows = fingerprints.select("fp", F.explode(cut).alias("s")).select("fp", (F.col("s.seg") * 65536 + F.col("s.value")).cast("long").alias("bucket"))
    return tiled_links(rows, test, radius, tile)


def tiled_links(rows: DataFrame, test: Callable, radius: int, tile: int = TILE) -> DataFrame:
    """links() of fingerprints that share a bucket: columns fp and bucket, no pair twice."""
    small_batches(rows.sparkSession)
    large = saved(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > tile), "buckets")
    chunks = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(tile)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    tiles = (
        rows.join(large, "bucket", "left").select("fp", "bucket", chunks.alias("chunks")).select("fp", "bucket", "chunks", mine.alias("p"))
        .select("fp", "bucket", "p", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("q"))
        .select("fp", "bucket", "p", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"))
    )
    dealt = tiles.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            # columns: fp, bucket, p, lo, hi
            change = np.flatnonzero((np.diff(rows[:, 1]) != 0) | (np.diff(rows[:, 3]) != 0) | (np.diff(rows[:, 4]) != 0)) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.concatenate([starts, [len(rows)]]))
            values, seg = np.ascontiguousarray(rows[:, 0]).view(np.uint64), (rows[:, 1] >> WIDTH) & (SEGMENTS - 1)
            group = np.repeat(np.arange(len(starts)), sizes)
            tiny = np.repeat((sizes <= SMALL) & (rows[starts, 3] == rows[starts, 4]), sizes)
            a, b = _small(group[tiny], seg[tiny], values[tiny], radius, test)
            for g in np.flatnonzero((sizes > 1) & ~tiny[starts]):
                at = slice(starts[g], starts[g] + sizes[g])
                x, y = _forest(values[at], rows[at, 2], rows[starts[g], 3] == rows[starts[g], 4], int(seg[starts[g]]), radius, test)
                a += x
                b += y
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if kept:
                rows = np.concatenate([*kept, rows])
            last = rows[-1, [1, 3, 4]]
            ends = np.flatnonzero((rows[:, [1, 3, 4]] != last).any(axis=1))
            cut = ends[-1] + 1 if len(ends) else 0
            if cut:
                yield from work(rows[:cut])
            kept = [rows[cut:]]
        if kept and len(kept[0]):
            yield from work(kept[0])

    return dealt.mapInArrow(run, "a long, b long").distinct()
