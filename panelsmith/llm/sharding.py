"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted hash draws."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelsmith.session import settle


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(n_shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """Shards 0..n-1 of weight 1, filled rack by rack and region by region."""
    return [Shard(s // (per_rack * racks_per_region), s // per_rack, s) for s in range(n_shards)]


def grown(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region and rack of its own.

    Only the new region's weight differs, so rows move into it alone, and it holds nothing but the new shard.
    """
    new = Shard(max(s.region for s in tree) + 1, max(s.rack for s in tree) + 1, max(s.shard for s in tree) + 1, weight)
    return [*tree, new]


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    """Time of a node's first arrival: exponential with the node's weight as rate, so the least wins by weight."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{level}/{node}"), key), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**53))) / F.lit(float(weight))


def _first(key: Column, level: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.array_min(F.array(*[
        F.struct(_draw(key, level, n, w).alias("t"), F.lit(n).alias("n")) for n, w in sorted(weights.items())
    ]))["n"]


def shard_of(key: Column, tree: Sequence[Shard]) -> Column:
    """Shard of a string key. At each level the children of the node reached so far draw for the key."""
    tree = [s for s in tree if s.weight > 0]
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for s in tree:
        regions.setdefault(s.region, {}).setdefault(s.rack, {})[s.shard] = s.weight

    def weight(racks):
        return sum(sum(shards.values()) for shards in racks.values())

    def chosen(at: Column, branches: dict[int, Column]) -> Column:
        out = None
        for n, value in branches.items():
            out = F.when(at == n, value) if out is None else out.when(at == n, value)
        return out

    region = _first(key, "region", {r: weight(racks) for r, racks in regions.items()})
    by_region = {}
    for r, racks in regions.items():
        rack = _first(key, "rack", {k: sum(shards.values()) for k, shards in racks.items()})
        by_region[r] = chosen(rack, {k: _first(key, "shard", shards) for k, shards in racks.items()})
    return chosen(region, by_region).cast("int")


def assign_shards(
    docs: DataFrame, tree: Sequence[Shard], id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = 50_000
) -> DataFrame:
    """One row per document: its shard, its slot there, and its shard in the grown tree.

    The id and the tree alone decide the shard. Rows without an id share one key. Slots are
    gapless from 0 in each shard, in the order of a hash of the row; they are counted by blocks of about
    `rows_per_block` rows whose number follows the table, so no shard is ever sorted in one task. Rows equal in
    id and text are interchangeable and take neighbouring slots. A null text has no bytes. An
    empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
    )
    rows = rows.select(
        "doc_id", "size", "text_crc32",
        shard_of(F.col("key"), tree).alias("shard"),
        shard_of(F.col("key"), grown(tree)).alias("grown_shard"),
        F.xxhash64("key", "text_crc32", "size").alias("rank"),
    )
    rows = settle(rows, "shards")
    blocks = max(1, math.ceil(rows.count() / (rows_per_block * len(tree))))
    # the rank is signed; its shift to 0..2^53 keeps the order, so blocks are ranges of it
    share = (F.shiftright("rank", 11) + F.lit(2**52)).cast("double") / F.lit(float(2**53))
    rows = rows.withColumn("block", F.floor(share * blocks))
    before = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = before.select("shard", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = W.partitionBy("shard", "block").orderBy("rank", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("at", F.row_number().over(within)).join(before, ["shard", "block"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("ahead") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard",
    )
