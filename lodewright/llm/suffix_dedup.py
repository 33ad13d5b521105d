"""Removes the bytes of strings of 200 bytes that occur anywhere else, by suffix sorting of the places that may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import KEY, Veil, arrow_schema, by_batch, drop_shuffles, keyed, release, saved, small_batches
from .suffix_array import adjacent_common, suffix_array

LENGTH = 200
#: Bytes of the string that marks a place; each string of LENGTH bytes holds LENGTH - GRAM + 1 of them.
GRAM = 64
#: Units of one group that are sorted together; larger groups are divided by longer common strings.
MOST_UNITS = 2000
#: Bytes that a task sorts at once: whole groups up to this size, or one group.
SORT_BYTES = 400_000
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Marks:
    """Content-defined marks: in each string of ``length`` bytes, the leftmost of its grams with the least hash.

    Equal strings have the same gram marked at the same place, so that only strings around equal marks need comparing.
    """

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.grams = length, gram, length - gram + 1
        n = _CHUNK + length + 8
        self.up, self.down = _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))

    def _hashes(self, t: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            total = np.zeros(len(t) + 1, np.uint64)
            np.cumsum((t.astype(np.uint64) + np.uint64(1)) * self.up[: len(t)], out=total[1:])
            x = (total[self.gram :] - total[: -self.gram]) * self.down[: len(t) - self.gram + 1]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
        return x

    def find(self, t: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text number, place in t, first start, last start, hash) of every mark in texts that stand one after another in t.

        The strings whose mark it is begin from the first start to the last one: each string has one mark, and those of
        one mark are neighbours.
        """
        ends = np.cumsum(lengths)
        out = []
        for low in range(0, max(0, len(t) - self.length + 1), _CHUNK):
            part = t[low : low + _CHUNK + self.length - 1]
            hashes = self._hashes(part)
            # the place in the low bits: of equal hashes the leftmost is least
            least = (hashes & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(hashes), dtype=np.uint64)
            width = 1
            while 2 * width <= self.grams:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < self.grams:
                least = np.minimum(least[: -(self.grams - width)], least[self.grams - width :])
            starts = low + np.arange(len(least))
            text = np.searchsorted(ends, starts, side="right")
            inside = starts + self.length <= ends[text]
            at, text, starts = (least[inside] & np.uint64(0xFFFFF)).astype(np.int64), text[inside], starts[inside]
            if len(at):
                new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                out.append((text[new], at[new] + low, starts[new], starts[np.append(new[1:], len(at)) - 1], hashes[at[new]]))
        if not out:
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
        text, at, first, last, hashes = (np.concatenate(x) for x in zip(*out))
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        return text[new], at[new], first[new], last[np.append(new[1:], len(at)) - 1], hashes[new]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes]:
    """All bytes of a binary column one after another, and the length of each (a null is empty)."""
    parts = [x or b"" for x in column.to_pylist()]
    joined = b"".join(parts)
    return np.frombuffer(joined, np.uint8), np.array([len(x) for x in parts], np.int64), joined


def marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """_d, _n, _th, at, low, more, mark, unit, one row for each mark of each text.

    The strings that have the mark at ``at`` begin at ``low`` and the ``more`` places after it. Their bytes together are
    the unit; its hash tells at which place the mark is, too.
    """
    finder = Marks(length, gram)

    def work(batch: pa.RecordBatch) -> dict:
        t, lengths, joined = _bytes_of(batch.column("text"))
        text, at, first, last, mark = finder.find(t, lengths)
        units = [xxhash.xxh3_64_intdigest(joined[a : b + length], c - a) for a, b, c in zip(first.tolist(), last.tolist(), at.tolist())]
        take, zero = pa.array(text), (np.cumsum(lengths) - lengths)[text]
        return {k: batch.column(k).take(take) for k in KEY} | {"at": at - zero, "low": first - zero, "more": last - first, "mark": mark.view(np.int64), "unit": np.array(units, np.uint64).view(np.int64)}

    return by_batch(keyed(docs), work, "_d long, _n boolean, _th long, at int, low int, more int, mark long, unit long")


_PART = "_d long, _n boolean, _th long, n long, low int, more int, a int, b int, mark long, unit long, bytes binary"


def _parts(batch: pa.RecordBatch, length: int) -> dict:
    """Each unit in two parts: strings that hold more on the left of the common bytes a:b than on the right, and the others.

    A string needs length - (b - a) bytes besides these, so at least half of them on its longer side. These become
    common bytes, too, and their hash the part's mark: equal strings are in parts with the same mark.
    """
    take, out = [], {k: [] for k in ("low", "more", "a", "b", "mark", "unit", "bytes")}
    for i, (low, more, a, b, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("low", "more", "a", "b", "bytes")))):
        half = (length - (b - a) + 1) // 2
        last = low + more
        for side, x, y, c, d in ((0, low, min(last, a - half), a - half, b), (1, max(low, a - half + 1), last, a, b + half)):
            if x > y:
                continue
            own = text[x - low : y - low + length]
            take.append(i)
            for k, v in zip(out, (x, y - x, c, d, xxhash.xxh3_64_intdigest(text[c - low : d - low], 2 * (d - c) + side), xxhash.xxh3_64_intdigest(own, c - x), own)):
                out[k].append(v)
    index = pa.array(take, pa.int64())
    longs = {k: np.array(out[k], np.uint64).view(np.int64) for k in ("mark", "unit")}
    return {k: batch.column(k).take(index) for k in (*KEY, "n")} | out | longs


def _spans_of(rows: list[dict], length: int) -> Iterator[tuple]:
    """(_d, _n, _th, low, high): the runs of bytes of units that occur once covered by strings that occur twice in rows or in a unit that occurs twice."""
    text = b"".join(r["bytes"] for r in rows)
    sizes = np.array([len(r["bytes"]) for r in rows])
    first = np.cumsum(sizes) - sizes
    order = suffix_array(text, length)
    equal = adjacent_common(text, order, length)
    # a run of neighbours with a long common prefix is one class of equal strings
    kind = np.concatenate([[0], np.cumsum(~equal)])
    unit = np.searchsorted(first, order, side="right") - 1
    inside = order - first[unit] + length <= sizes[unit]
    order, kind, unit = order[inside], kind[inside], unit[inside]
    weight = np.array([min(2, r["n"]) for r in rows])[unit]
    hit = np.bincount(kind, weight)[kind] > 1
    o = np.sort(order[hit])
    if not len(o):
        return
    u = np.searchsorted(first, o, side="right") - 1
    starts = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (o[1:] > o[:-1] + 1)))
    for a, b in zip(starts, np.append(starts[1:], len(o)) - 1):
        r = rows[u[a]]
        if r["n"] == 1:
            zero = r["low"] - first[u[a]]
            yield r["_d"], r["_n"], r["_th"], int(o[a] + zero), int(o[b] + zero) + length


def _sorted_spans(parts: DataFrame, length: int) -> DataFrame:
    """Spans (see _spans_of) of parts that share a mark; equal ones are told by their hashes and sorted once."""
    schema = "_d long, _n boolean, _th long, low int, high int"
    small_batches(parts.sparkSession)
    kinds = arrow_schema(parts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full: list[dict] = []
        found: list[tuple] = []
        size, own, same = 0, [], []

        def whole() -> None:
            """One of several equal parts goes on, with their number; they are covered from end to end."""
            if len(same) > 1 or same[0]["n"] > 1:
                found.extend((r["_d"], r["_n"], r["_th"], r["low"], r["low"] + r["more"] + length) for r in same if r["n"] == 1)
            own.append(same[0] | {"n": sum(r["n"] for r in same)})

        def close() -> None:
            nonlocal size
            whole()
            if len(own) > 1 and any(r["n"] == 1 for r in own):
                full.extend(own)
                size += sum(len(r["bytes"]) for r in own)

        def flush() -> Iterator[pa.RecordBatch]:
            found.extend(_spans_of(full, length) if full else ())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), kinds)], schema=kinds)

        for batch in batches:
            for row in batch.to_pylist():
                if same and (row["mark"], row["unit"]) == (same[0]["mark"], same[0]["unit"]):
                    same.append(row)
                    continue
                if same and row["mark"] == same[0]["mark"]:
                    whole()
                elif same:
                    close()
                    own = []
                    if size > SORT_BYTES or len(found) > 10_000:
                        yield from flush()
                        full, found, size = [], [], 0
                same = [row]
        if same:
            close()
        yield from flush()

    return parts.repartition("mark").sortWithinPartitions("mark", "unit").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_units: int = MOST_UNITS) -> DataFrame:
    """_d, _n, _th, spans: for each text that has any, the merged spans (low, high) covered by repeated strings.

    A mark that occurs once can't be in a repeated string. A unit that occurs twice is repeated whole: large groups of
    copies end here, as counts. What is left are marks with different units: one copy of each is cut into parts that
    share longer strings (see _parts), and the parts of one mark meet in a suffix array. Marks with over ``most_units``
    parts aren't gathered: their equal parts are counted, and one of each is cut into parts with longer common strings
    still, until these are of ``length`` bytes, when all that share a mark are equal. So no group is unbounded, and
    each string is in one part of each round. Units and common strings are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    every = saved(marks(docs, length, gram), "marks")
    often = every.groupBy("mark").agg(F.count("*").alias("n"), (F.min("unit") != F.max("unit")).alias("differ")).where("n > 1").select("mark", "differ")
    often = saved(often, "often")  # so that a join with a very common mark can be split
    shared = saved(every.join(often, "mark"), "shared")
    release(every, often)
    del every, often
    drop_shuffles(spark)
    place = F.struct(*KEY, "low", "more", "at")
    units = saved(shared.groupBy("mark", "unit", "differ").agg(F.count("*").alias("n"), F.min(place).alias("p")), "units")
    whole = shared.join(units.where("n > 1").select("mark", "unit"), ["mark", "unit"]).select(*KEY, "low", (F.col("low") + F.col("more") + length).alias("high"))
    once = units.where("differ").groupBy("mark").agg(F.min("n").alias("least")).where("least = 1").select("mark")
    needed = units.where("differ").join(once, "mark").select("p.*", "n")
    wanted = needed.groupBy(*KEY).agg(F.collect_list(F.struct("n", "low", "more", "at")).alias("units"))
    cut = keyed(docs).join(wanted, KEY).select(*KEY, "text", F.explode("units").alias("u"))
    own = F.substring("text", F.col("u.low") + 1, F.col("u.more") + length)
    cut = cut.select(*KEY, "u.n", "u.low", "u.more", F.col("u.at").alias("a"), (F.col("u.at") + gram).alias("b"), own.alias("bytes"))
    runs, done = [saved(whole, "whole")], []
    while True:
        parts = saved(by_batch(cut, lambda batch: _parts(batch, length), _PART), "parts")
        done.append(parts)
        large = saved(parts.groupBy("mark").agg(F.count("*").alias("parts")).where(F.col("parts") > most_units).select("mark"), "large")
        done.append(large)
        if not large.take(1):
            runs.append(saved(_sorted_spans(parts, length), "spans"))
            break
        runs.append(saved(_sorted_spans(parts.join(large, "mark", "left_anti"), length), "spans"))
        parts = saved(parts.join(large, "mark"), "parts")
        done.append(parts)
        rest = ("low", "more", "a", "b", "bytes")
        counts = saved(parts.groupBy("mark", "unit").agg(F.sum("n").alias("all"), F.min(F.struct(*KEY, "low")).alias("p")), "counts")
        done.append(counts)
        equal = parts.where("n = 1").join(counts.where("all > 1").select("mark", "unit"), ["mark", "unit"])
        runs.append(saved(equal.select(*KEY, "low", (F.col("low") + F.col("more") + length).alias("high")), "equal"))
        if not parts.where(F.col("b") - F.col("a") < length).take(1):
            break
        one = counts.select("unit", "mark", "all", "p.*")
        cut = parts.drop("n").join(one, [*KEY, "low", "mark", "unit"]).dropDuplicates([*KEY, "low", "mark", "unit"]).select(*KEY, F.col("all").alias("n"), *rest)
    every = runs[0]
    for more in runs[1:]:
        every = every.unionByName(more)
    found = saved(every.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("spans")), "found")
    release(shared, units, *runs, *done)
    drop_shuffles(spark)
    return found


def _kept(batch: pa.RecordBatch) -> dict:
    out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
    for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
        text, removed, count, done, at = text or b"", 0, 0, 0, -1
        kept = hashlib.sha256()
        for s in spans or ():
            low, high = max(0, s["low"]), min(len(text), s["high"])
            if low > at:
                kept.update(text[done:low])
                count += 1
                removed += high - low
            else:
                removed += max(0, high - at)
            at = done = max(at, high)
        kept.update(text[done:])
        for k, v in zip(out, (len(text), removed, count, kept.hexdigest())):
            out[k].append(v)
    return {"doc_id": batch.column("doc_id")} | out


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    A byte goes if it is in a string of ``length`` bytes that also starts anywhere else, in any text or its own.
    Matches never cross texts. Null and short texts lose nothing; repeated rows lose all that is in such strings, since
    each has it too. Columns other than doc_id and text are not looked at.
    """
    spans = repeated_spans(docs, length)
    rows = keyed(docs).join(spans, KEY, "left").select(F.when(~F.col("_n"), F.col("_d")).alias("doc_id"), "text", "spans")
    return by_batch(rows, _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the kept bytes as text; bytes that no longer form UTF-8 where a cut splits a character are replaced."""
    spans, veil = repeated_spans(docs, length), Veil(docs)
    own = veil.at("text")

    def work(batch: pa.RecordBatch) -> dict:
        texts = []
        for text, own_spans in zip(batch.column("_t").to_pylist(), batch.column("spans").to_pylist()):
            if text is not None and own_spans:
                parts, done = [], 0
                for s in own_spans:
                    parts.append(text[done : max(done, s["low"], 0)])
                    done = max(done, s["high"])
                text = b"".join([*parts, text[done:]])
            texts.append(None if text is None else text.decode("utf-8", "replace"))
        return {k: batch.column(k) for k in fields.names if k != own} | {own: texts}

    fields = StructType([StructField(f.name, StringType()) if f.name == own else f for f in veil.fields()])
    rows = veil.keyed().join(spans, KEY, "left").select(*[c for c in veil.own if c != own], F.col(own).cast("binary").alias("_t"), "spans")
    return veil.back(by_batch(rows, work, fields))
