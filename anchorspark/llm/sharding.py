"""Shards by a hierarchical weighted hash tree.

A document descends region, rack and shard; at each level every child draws
-ln(u) / weight, u a hash of the document and the child, and the smallest draw
wins.  Weight that is added later competes as a draw of its own, beside the
regions' draws, that leads straight to the subtree it was added to: a document
moves only if the added draw wins, and then only into that subtree.

Defined results: null doc_id hashes as the text "null"; a null text has no
bytes and the CRC of nothing; repeated rows share a shard and take a slot each;
a text's length plays no part but in its size; an empty table gives an empty table; other input columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


@dataclass(frozen=True)
class Tree:
    """racks[r][k] lists the weights of the shards in rack k of region r, numbered in that order; added: (shard, weight), in order of time."""

    racks: tuple[tuple[tuple[float, ...], ...], ...]
    added: tuple[tuple[int, float], ...] = field(default=())

    @staticmethod
    def even(regions: int, racks: int, shards: int) -> Tree:
        return Tree(tuple(tuple((1.0,) * shards for _ in range(racks)) for _ in range(regions)))

    @property
    def n_shards(self) -> int:
        return max(sum(len(k) for r in self.racks for k in r), *(s + 1 for s, _ in self.added), 0) if self.added else sum(len(k) for r in self.racks for k in r)

    def grow(self, weight: float = 1.0) -> Tree:
        return Tree(self.racks, (*self.added, (self.n_shards, weight)))


def _draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw with the node's weight as its rate, from the key's hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def _least(draws: list[tuple[Column, Column]]) -> Column:
    return F.array_min(F.array(*(F.struct(d.alias("draw"), to.alias("to")) for d, to in draws)))["to"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key."""
    number, regions = 0, []
    for r, racks in enumerate(tree.racks):
        inner = []
        for k, weights in enumerate(racks):
            leaf = _least([(_draw(key, f"{r}/{k}/{s}", w), F.lit(number + s)) for s, w in enumerate(weights)])
            inner.append((sum(weights), leaf))
            number += len(weights)
        rack = _least([(_draw(key, f"{r}/{k}", w), F.lit(k)) for k, (w, _) in enumerate(inner)])
        down = F.lit(None).cast("int")
        for k, (_, leaf) in reversed(list(enumerate(inner))):
            down = F.when(rack == k, leaf).otherwise(down)
        regions.append((sum(w for w, _ in inner), down))
    draws = [(_draw(key, f"{r}", w), F.lit(r)) for r, (w, _) in enumerate(regions)]
    draws += [(_draw(key, f"added {n}", w), F.lit(-1 - s)) for n, (s, w) in enumerate(tree.added)]
    top, out = _least(draws), F.lit(None).cast("int")
    for r, (_, down) in reversed(list(enumerate(regions))):
        out = F.when(top == r, down).otherwise(out)
    return F.when(top < 0, -1 - top).otherwise(out).cast("int")


def shard(docs: DataFrame, tree: Tree, rows_per_block: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard after one more was added.

    Slots are numbered in blocks, so no task holds a whole shard; a row's block is
    stored with it, so repeated ids spread over blocks and a retry finds them there.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text, key = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    grown = tree.grow()
    placed = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), shard_of(key, tree).alias("shard"), shard_of(key, grown).alias("grown_shard"), F.xxhash64(F.lit("block"), key, F.monotonically_increasing_id()).alias("h"))
    placed = scratch.table(placed, "placed")
    blocks = max(1, placed.count() // (tree.n_shards * rows_per_block), 16)
    placed = placed.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    sizes = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by shard order by block rows between unbounded preceding and 1 preceding), 0)")
    sizes = scratch.table(sizes.select("shard", "block", before.alias("before")), "blocks")
    rank = F.expr("row_number() over (partition by shard, block order by doc_id, text_crc32, size) - 1")
    return placed.withColumn("in_block", rank).join(sizes, ["shard", "block"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("in_block")).cast("long").alias("slot"), "grown_shard")
