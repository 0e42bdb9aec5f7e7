"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A tree has regions, racks and shards.  Every shard draws an arrival time from the row's key: an
exponential variable whose rate is the shard's weight, computed from a hash.  A rack's draw is the
earliest among its shards, a region's the earliest among its racks; the earliest of exponentials
is again exponential with the summed rate, so each inner node draws in proportion to its weight.
A row descends: earliest region, its earliest rack, its earliest shard.

A shard's draw depends on the key and the shard alone.  A changed weight alters draws only on the
path above that shard, so rows move only into or out of that subtree; a new shard takes rows only
into itself.

Defined results: a null key counts as one key of its own, a null text as an empty one; equal keys
always share a shard; repeated rows keep separate slots; an empty table gives an empty result;
further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadquarry.session import spool

#: Slots are numbered in this many slices of a shard, so that no task sorts a whole shard.
SLICES = 1024
OVERHEAD_BYTES = 16


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def grid(n_shards: int, shards_per_rack: int = 5, racks_per_region: int = 4) -> list[Leaf]:
    """``n_shards`` equal shards, filled rack by rack and region by region."""
    return [Leaf(i // (shards_per_rack * racks_per_region), i // shards_per_rack, i) for i in range(n_shards)]


def _draw(key: Column, leaf: Leaf) -> Column:
    """Arrival time of the row at one shard: -ln(uniform) / weight."""
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null")), F.lit(leaf.shard)), 11)
    return -F.log((bits.cast("double") + 0.5) * F.lit(math.ldexp(1.0, -53))) / F.lit(float(leaf.weight))


def _earliest(children: list[tuple[Column, int]]) -> Column:
    """(draw, id) of the child that arrives first; ties go to the smaller id."""
    return F.array_min(F.array(*[F.struct(d.alias("draw"), F.lit(i).alias("id")) for d, i in children]))


def place(df: DataFrame, key: Column, tree: list[Leaf], prefix: str = "") -> DataFrame:
    """Adds region, rack and shard (int) by descending the tree."""
    leaves = sorted((x for x in tree if x.weight > 0), key=lambda x: (x.region, x.rack, x.shard))
    racks = sorted({(x.region, x.rack) for x in leaves})
    regions = sorted({x.region for x in leaves})
    p = f"_{prefix}"
    drawn = df.withColumns({f"{p}leaf{x.shard}": _draw(key, x) for x in leaves})
    drawn = drawn.withColumns({f"{p}rack{k}": _earliest(
        [(F.col(f"{p}leaf{x.shard}"), x.shard) for x in leaves if x.rack == k and x.region == r]) for r, k in racks})
    drawn = drawn.withColumns({f"{p}region{r}": _earliest(
        [(F.col(f"{p}rack{k}.draw"), k) for q, k in racks if q == r]) for r in regions})
    drawn = drawn.withColumn(f"{prefix}region", _earliest([(F.col(f"{p}region{r}.draw"), r) for r in regions]).id)
    chosen = F.lit(None).cast("int")
    for r in regions:
        chosen = F.when(F.col(f"{prefix}region") == r, F.col(f"{p}region{r}.id")).otherwise(chosen)
    drawn = drawn.withColumn(f"{prefix}rack", chosen)
    chosen = F.lit(None).cast("int")
    for _, k in racks:
        chosen = F.when(F.col(f"{prefix}rack") == k, F.col(f"{p}rack{k}.id")).otherwise(chosen)
    drawn = drawn.withColumn(f"{prefix}shard", chosen)
    return drawn.select(*df.columns, f"{prefix}region", f"{prefix}rack", f"{prefix}shard")


def shard_documents(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, slot and, for a second tree, grown_shard.

    Slots number the rows of a shard from 0 without gaps: rows are ranked inside hashed slices of
    a shard, and each slice starts where the counted rows of the earlier ones end.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = place(narrow, F.col("doc_id"), tree)
    if grown:
        placed = place(placed, F.col("doc_id"), grown, "grown_").drop("grown_region", "grown_rack")
    placed = spool(placed.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(SLICES)).cast("int")))
    counts = placed.groupBy("shard", "slice").count()
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size"))
    # One row per shard and slice: its size is fixed by the tree and SLICES.
    ranked = placed.withColumn("rank", rank).join(F.broadcast(starts), ["shard", "slice"])
    return ranked.select(
        "doc_id", "size", "text_crc32", "region", "rack", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"),
        *(["grown_shard"] if grown else []))
