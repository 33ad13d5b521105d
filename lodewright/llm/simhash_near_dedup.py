"""SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, Veil, by_batch, connected, majority, saved, text_hash
from .hamming import links, ring

SEED, WORDS, RADIUS = 42, 3, 3


def shingle_hashes(text: bytes | None, words: int = WORDS) -> list[int]:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter; of nothing if there is no word."""
    split = (text or b"").lower().split()
    if len(split) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(split), SEED)] if split else []
    return [xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*[split[i:] for i in range(words)]))]


def _fingerprints(batch: pa.RecordBatch) -> dict:
    sizes, parts = [], []
    for text in batch.column("text").to_pylist():
        own = shingle_hashes(text)
        sizes.append(len(own))
        if own:
            parts.append(np.array(own, np.uint64))
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "fp": majority(hashes, sizes).view(np.int64)}


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), fp (a long that holds the 64 bits) of every row."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), F.col("text").cast("binary").alias("text"))
    return by_batch(cut, _fingerprints, "doc_id long, th long, fp long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, th, fp, component_id, one row for each row of docs.

    Documents are linked if their fingerprints differ in ``radius`` bits or fewer; component_id is the smallest doc_id
    that can be reached. Equal fingerprints are one node, so that a large group of copies costs one node and no pair.
    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay repeated rows of one
    component. A null doc_id is never the smallest; a component of nothing else has component_id null. Columns other
    than doc_id and text are not looked at.
    """
    rows = saved(fingerprints(docs), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(links(nodes, radius, ring))
    own = saved(nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least"), "components")
    joined = own.join(own.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    known = saved(nodes.join(joined, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "known")  # so that the join with a common fingerprint can be split
    return rows.join(known, "fp").select("doc_id", "th", "fp", "component_id")


def hex_digits(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that are the first of their component: smallest doc_id, then smallest hash of the text.

    Of repeated rows one is kept.
    """
    found = near_duplicates(docs, radius)
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k"))
    first = first.select(F.coalesce("k.doc_id", F.lit(0)).alias("_d"), F.col("k.none").alias("_n"), F.col("k.th").alias("_th"))
    veil = Veil(docs)
    return veil.back(veil.keyed().join(first, KEY, "left_semi").dropDuplicates(KEY))
