"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Shards hang under racks and racks under regions. Every node has a weight, the number of shards below it. A
row descends from the root: at each level every child draws ``-ln(u) / weight`` from a hash of the row's key
and the child's name, and the smallest draw wins. A child's draw depends on nothing but its own name and
weight, so a change of weights moves rows only into or out of the subtrees whose weights change.

Regions are filled one after another. A shard that opens a new region leaves all other weights as they were,
so the rows that move all move into that shard: 24 shards fill three regions of eight, and the 25th opens a
fourth. Adding a shard to a region that is only part full moves rows into that region's subtree, which may
land on its older shards too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.llm.common import staged, table

#: Hash bits that make up a draw; 52 are exact in a double.
DRAW_BITS = 52


@dataclass(frozen=True)
class Tree:
    """``shards`` shards, ``per_rack`` to a rack and ``racks`` racks to a region."""

    shards: int
    per_rack: int = 2
    racks: int = 4

    def rack_of(self, shard: int) -> int:
        return shard // self.per_rack

    def region_of(self, shard: int) -> int:
        return shard // (self.per_rack * self.racks)

    def children(self) -> tuple[list[tuple[int, int]], dict[int, list[tuple[int, int]]], dict[int, list[tuple[int, int]]]]:
        """(region, weight) pairs, and by region the racks and by rack the shards with their weights."""
        regions: dict[int, int] = {}
        racks: dict[int, dict[int, int]] = {}
        leaves: dict[int, list[tuple[int, int]]] = {}
        for shard in range(self.shards):
            region, rack = self.region_of(shard), self.rack_of(shard)
            regions[region] = regions.get(region, 0) + 1
            racks.setdefault(region, {})[rack] = racks.setdefault(region, {}).get(rack, 0) + 1
            leaves.setdefault(rack, []).append((shard, 1))
        return sorted(regions.items()), {k: sorted(v.items()) for k, v in racks.items()}, leaves


def draw(key: Column, node: str, weight: int) -> Column:
    """The weighted draw of a node for a key: exponential with the node's weight as its rate."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{node}:"), key)), 1, DRAW_BITS // 4)
    uniform = (F.conv(digest, 16, 10).cast("long") + F.lit(1)).cast("double") / F.lit(float(2**DRAW_BITS + 1))
    return -F.log(uniform) / F.lit(float(weight))


def winner(key: Column, level: str, nodes: list[tuple[int, int]]) -> Column:
    """The node with the smallest draw; equal draws go to the smaller number."""
    if len(nodes) == 1:
        return F.lit(nodes[0][0])
    return F.least(*(F.struct(draw(key, f"{level}{n}", w).alias("draw"), F.lit(n).alias("node")) for n, w in nodes))["node"]


def descend(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """``df`` with the shard of ``key`` in column ``name``, one level after another so that each draw is made once."""
    regions, racks, shards = tree.children()
    region, rack = f"__{name}_region", f"__{name}_rack"

    def below(level: str, groups: dict[int, list[tuple[int, int]]], chosen: str) -> Column:
        out = None
        for parent, nodes in sorted(groups.items()):
            pick = winner(key, level, nodes)
            out = F.when(F.col(chosen) == parent, pick) if out is None else out.when(F.col(chosen) == parent, pick)
        return out

    return (
        df.withColumn(region, winner(key, "region", regions))
        .withColumn(rack, below("rack", racks, region))
        .withColumn(name, below("shard", shards, rack))
        .drop(region, rack)
    )


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, rows_per_slice: int = 250_000) -> DataFrame:
    """Put every row into a shard by its key, and number the rows of each shard without gaps.

    Law ``key``: the key and the number of shards decide alone. A null key is placed as the key ``null``; a
    null text has size 8 and checksum 0; repeated rows get slots of their own; an empty table gives no rows.
    Only ``id_col`` and ``text_col`` are read, so further columns never clash.

    Slots come from two levels of counting. Each shard is cut by a hash of the key and the text into slices of about
    ``rows_per_slice`` rows; rows are numbered within their slice and slices are offset by the running sum
    of the slices before. No task sees more than some slices, however many rows a shard has. Rows
    that share a key, or have none, are spread by their texts; only equal rows share a slice.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    base = df.select(
        F.col(id_col).alias("doc_id"),
        key.alias("__key"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    tree = Tree(shards)
    placed = descend(base, F.col("__key"), tree, "shard")
    placed = descend(placed, F.col("__key"), Tree(shards + 1), "grown_shard")
    placed = staged(placed, "shards")
    rows = placed.count()
    slices = max(8, math.ceil(rows / shards / rows_per_slice))
    sliced = placed.withColumn("__slice", F.pmod(F.xxhash64("__key", "text_crc32", "size", F.lit("slice")), F.lit(slices)).cast("int"))
    # shards x slices rows, which follows rows / rows_per_slice; one running sum per shard
    counts = sliced.groupBy("shard", "__slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    order = Window.partitionBy("shard", "__slice").orderBy("__key", "text_crc32", "size")
    numbered = sliced.withColumn("__row", F.row_number().over(order))
    return numbered.join(offsets, ["shard", "__slice"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("__offset") + F.col("__row") - 1).cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 by law ``key``."""
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
