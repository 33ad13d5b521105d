"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree deals blocks to output shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import Veil, saved

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Blocks of all sources together, and blocks for each shard of mixes with so many shards that these are more. The driver
#: plans blocks, not documents: one for each 50,000,000 words at most.
BLOCKS, OF_SHARD = 20_000, 2
#: Sources are data sets, whose totals the driver holds; a table with more different ones is refused.
MOST_SOURCES = 1_000_000
SHARDS, SEED = 64, 20240901
#: Words of a shard: larger mixes have more than SHARDS shards, so that one task sorts each.
SHARD_WORDS = 100_000_000
WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, th (hash of the text), size (words of the whole text; a null text has none)."""
    veil = Veil(docs)
    doc_id, source, th, size = _facts(veil)
    return veil.df.select(doc_id.alias("doc_id"), source.alias("source"), th.alias("th"), size.alias("size"))


def _facts(veil: Veil) -> tuple[F.Column, F.Column, F.Column, F.Column]:
    text = veil.col("text")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return veil.col("doc_id").cast("long"), veil.col("source").cast("string"), F.xxhash64(text), size


def targets(totals: list[int], weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words for each source, given in order: ``share`` of all words by repeating weights, none above ``most`` times its own.

    What is above goes to the other sources by weight, again and again, until none is above.
    """
    size, weight = np.array(totals, float), np.array([weights[i % len(weights)] for i in range(len(totals))], float)
    out, free, left = np.zeros(len(size)), np.ones(len(size), bool), share * float(sum(totals))
    while free.any():
        part = left * weight[free] / weight[free].sum()
        over = part > most * size[free]
        if not over.any():
            out[free] = part
            break
        at = np.flatnonzero(free)[over]
        out[at] = most * size[at]
        left -= out[at].sum()
        free[at] = False
    return out.tolist()


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many blocks of each source a shard gets.

    The quotas of a node are split between its halves by a multivariate hypergeometric draw, down to single shards, so
    that the columns add up to the quotas exactly and the shards' totals differ by one block at most. Each node has a
    seed of its own, from its place in the tree.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.asarray(quotas, np.int64))]
    while stack:
        low, high, own = stack.pop()
        if high - low == 1:
            out[low] = own
            continue
        mid = (low + high) // 2
        total = int(own.sum())
        draw = total * (mid - low) // (high - low)
        left = np.random.default_rng((seed, low, high)).multivariate_hypergeometric(own, draw, method="marginals") if total else own * 0
        stack += [(low, mid, left), (mid, high, own - left)]
    return out


def _key(seed: int) -> F.Column:
    return F.xxhash64("doc_id", "th", "size", F.lit(seed))


def _order() -> F.Column:
    """Where a document stands in its block; rows that agree in id and text stand together."""
    return F.struct("key", F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("n"), "th")


class Plan:
    """Which shards the draws of each block go to: made from a table of sizes(), applied to any table with its columns.

    A document is in one block of its source, by a hash of its id and text. The blocks of a source stand in a seeded
    order; whole rounds over the source and then blocks of that order, the last one only as far as it is needed, are
    the source's quota of drawn blocks and make up its target, to within half a document (rows that agree in id and
    text count as one there). The splitting tree partitions the quotas of all sources among the shards, and each shard
    then draws its blocks, disjoint, from a permutation of the source's list. Only totals of the sources and of the
    blocks reach the driver, and what is broadcast has a row for each block.
    """

    def __init__(self, rows: DataFrame, shards: int | None = None, seed: int = SEED, blocks: int = BLOCKS):
        spark, self.seed = rows.sparkSession, seed
        by = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).limit(MOST_SOURCES + 1).collect()
        if len(by) > MOST_SOURCES:
            raise ValueError(f"there are over {MOST_SOURCES} different sources")
        by = sorted(by, key=lambda r: (r["source"] is None, r["source"] or ""))
        wanted, total = targets([r["words"] for r in by]), max(1, sum(r["n"] for r in by))
        self.shards = shards or max(SHARDS, -(-int(sum(wanted)) // SHARD_WORDS))
        blocks = min(max(blocks, OF_SHARD * self.shards), max(1, total // 64))
        cut = [max(1, -(-r["n"] * blocks // total)) for r in by]
        kind = StructType([StructField("s", StringType()), StructField("sid", IntegerType()), StructField("source_size", LongType()), StructField("target", DoubleType()), StructField("nblocks", IntegerType())])
        self.sources = spark.createDataFrame([(r["source"], i, r["words"], t, b) for i, (r, t, b) in enumerate(zip(by, wanted, cut))], kind)
        tagged = self._tagged(rows)
        held: dict[int, list[tuple[int, int]]] = {}
        for r in tagged.groupBy("sid", "block").agg(F.sum("size").alias("words")).collect():
            held.setdefault(r["sid"], []).append((r["block"], r["words"]))
        chosen = _deal([(r["words"], t) for r, t in zip(by, wanted)], held, self.shards, seed)
        # the block in which a target ends is drawn document by document: up to a place in its order
        ended = spark.createDataFrame([(a, b, need) for a, b, _, need, _ in chosen if need], "sid int, block int, need double")
        before = F.coalesce(F.sum("size").over(Window.partitionBy("sid", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = tagged.join(F.broadcast(ended), ["sid", "block"]).withColumn("at", _order()).withColumn("before", before)
        last = {(r["sid"], r["block"]): r["at"] for r in inside.where(F.col("before") + F.col("size") / 2 < F.col("need")).groupBy("sid", "block").agg(F.max("at").alias("at")).collect()}
        kind = StructType([StructField("sid", IntegerType()), StructField("block", IntegerType()), StructField("whole", IntegerType()), StructField("last", tagged.select(_order().alias("o")).schema["o"].dataType), StructField("shards", ArrayType(IntegerType()))])
        self.blocks = spark.createDataFrame([(a, b, whole, last.get((a, b)), to) for a, b, whole, _, to in chosen], kind)

    def _tagged(self, rows: DataFrame) -> DataFrame:
        known = rows.withColumn("key", _key(self.seed)).join(F.broadcast(self.sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        return known.withColumn("block", F.pmod("key", F.col("nblocks")).cast("int")).drop("nblocks")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows with source_size, target, key and ``to``, the shards that the draws of a row's block went to, in the order of draws.

        Both joins are with tables of a row for each source or block, which are broadcast.
        """
        draws = F.col("whole") + F.coalesce(_order() <= F.col("last"), F.lit(False)).cast("int")
        joined = self._tagged(rows).join(F.broadcast(self.blocks), ["sid", "block"])
        return joined.withColumn("to", F.slice("shards", F.lit(1), draws)).drop("whole", "last", "shards", "sid", "block")


def _deal(sources: list, held: dict, shards: int, seed: int) -> list[tuple[int, int, int, float, list[int]]]:
    """(sid, block, whole draws, words wanted of one draw more, shard of each draw) of every block that has any."""
    drawn, quotas = [], np.zeros(max(1, len(sources)), np.int64)
    for sid, own in sorted(held.items()):
        own, (size, target) = sorted(own), sources[sid]
        rounds = int(target // size) if size else 0
        left, chosen, list_of = target - rounds * size, [], []
        for at in np.random.default_rng((seed, sid)).permutation(len(own)):
            block, words = own[at]
            more = left >= 0.5
            whole, need = (rounds + 1, 0.0) if more and words <= left else (rounds, left if more else 0.0)
            left -= words
            list_of += [len(chosen)] * (whole + (need > 0))
            chosen.append((block, whole, float(need)))
        quotas[sid] = len(list_of)
        drawn.append((sid, chosen, list_of))
    tree, out = split_tree(quotas, shards, seed), []
    for sid, chosen, list_of in drawn:
        to: list[list[int]] = [[] for _ in chosen]
        shard = np.repeat(np.arange(shards), tree[:, sid])
        for i, s in zip(np.random.default_rng((seed, sid, 1)).permutation(len(list_of)), shard):
            to[list_of[i]].append(int(s))
        out += [(sid, block, whole, need, own) for (block, whole, need), own in zip(chosen, to)]
    return out


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs: taken counts a document's words once for each shard that drew it.

    Sources are ordered by code point, null last; null doc_id and null text are rows like others (size 0). Repeated rows
    are rows of their own. An empty table gives an empty table. Columns other than doc_id, text and source are not
    looked at.
    """
    rows = saved(sizes(docs), "sizes")
    taken = (F.col("size") * F.size("to")).cast("long")
    return Plan(rows, **how).dealt(rows).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: docs' columns, and _draw, _shard and _place (columns of docs that are called so are replaced).

    A document comes once for each shard that drew its block, _draw numbers these draws. A shard is in one partition,
    shuffled: ordered by _place, a seeded hash. Texts are dealt once, to their shards.
    """
    veil = Veil(docs)
    plan = Plan(saved(sizes(docs), "sizes"), **how)
    doc_id, source, th, size = _facts(veil)
    rows = veil.df.withColumns({"doc_id": doc_id, "source": source, "th": th, "size": size})
    drawn = plan.dealt(rows).select(*veil.own, "key", F.posexplode("to").alias("at", "_shard")).withColumn("_draw", (F.col("at") + 1).cast("int"))
    drawn = drawn.withColumn("_place", F.xxhash64("key", "_draw", F.lit(plan.seed + 1)))
    out = drawn.repartition(plan.shards, "_shard").sortWithinPartitions("_shard", "_place")
    return veil.back(out, ("_draw", "_shard", "_place"))
