"""Merkle manifest of a table: one tree per group, one root over the groups, a proof for every row.

A row is a leaf: the SHA-256 of its columns.  Leaves of a group ascend by the order columns; while
several nodes remain, every ``FANOUT`` consecutive ones become the hash of their concatenation.  What
remains is the group's subroot, and the subroots, in the order of the groups, give the root likewise.

Cogrouped subtree exchange: ``FANOUT ** LEVELS`` consecutive leaves are a superblock.  Superblocks are
first reduced to one node each; these nodes are the leaves of a tree that is ``FANOUT ** LEVELS`` times
smaller and goes through the same exchange until one node a group is left.  On the way back each
superblock's leaves meet the outer nodes that their proofs need, one row per superblock, in one
cogroup, and the local reduction, the joining of the proofs and the folding happen there together.
A group that holds most rows is many superblocks, so no task depends on the size of a group.

Texts are hashed where they are read; only ids and digests are shuffled.

Defined results: a null column counts as ``-`` in a leaf; a null group is a group of its own and the
first one; rows without an order value come first in their group; rows with equal order values ascend
by leaf, so repeated rows have leaves of their own in the tree; a row whose ``presented`` digest is null
is folded from its leaf; very long texts are hashed whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadquarry.operators.rank import BROADCAST_GROUPS, row_numbers
from leadquarry.session import discard, spool

FANOUT = 8
LEVELS = 3
SPAN = FANOUT ** LEVELS


def leaf_of(*columns: Column) -> Column:
    """Digest of columns: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    as_text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in as_text]), 256)


def fold(leaf: str, proof: list[str], places: list[int]) -> str:
    """The root that a leaf leads to: its siblings level by level, and its place among them."""
    for siblings, place in zip(proof, places):
        leaf = sha256(f"{siblings[:64 * place]}{leaf}{siblings[64 * place:]}".encode()).hexdigest()
    return leaf


def _sent(df: DataFrame) -> DataFrame:
    """Broadcast if it is small enough; a shuffle join else."""
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows with g (number of the group), pos, n (size of the group); and (g, n) per group."""
    mid = F.monotonically_increasing_id()
    laid = spool(rows.orderBy(F.asc_nulls_first("grp"), F.asc_nulls_first("ord"), "leaf").withColumns(
        {"pid": F.shiftright(mid, 33), "at": mid.bitwiseAND(F.lit((1 << 33) - 1))}))
    runs = spool(laid.groupBy("pid", "grp").agg(F.count("*").alias("rows"), F.min("at").alias("first")))
    groups = runs.groupBy("grp").agg(F.sum("rows").alias("n"))
    groups = spool(row_numbers(groups, [F.asc_nulls_first("grp")], "g"))
    before = Window.partitionBy("grp").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).join(
        _sent(groups.withColumnRenamed("grp", "of")), F.col("grp").eqNullSafe(F.col("of"))).select(
        F.col("pid").alias("p"), F.col("grp").alias("of"), "g", "n", "start")
    starts = spool(starts)  # a row per partition and group in it
    same = (F.col("pid") == F.col("p")) & F.col("grp").eqNullSafe(F.col("of"))
    out = laid.join(_sent(starts), same).withColumn("pos", F.col("start") + F.col("at")).drop("pid", "at", "p", "of", "start")
    return out, groups.select("g", "n"), [laid, runs, groups, starts]


def _level(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.concat_ws("", F.slice(nodes, i * FANOUT + 1, FANOUT)), 256))


def _blocks(nodes: DataFrame) -> DataFrame:
    """One node per superblock; ``nodes`` and the result have g, pos, n, node."""
    out = nodes.groupBy("g", F.expr(f"pos DIV {SPAN}").alias("b")).agg(
        F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x.node).alias("x"))
    for _ in range(LEVELS):  # a group of one superblock stops at one node, the others rise all levels
        out = out.withColumn("x", F.when((F.col("n") > SPAN) | (F.size("x") > 1), _level(F.col("x"))).otherwise(F.col("x")))
    return out.select("g", F.col("b").alias("pos"), F.expr(f"(n + {SPAN - 1}) DIV {SPAN}").alias("n"), F.col("x")[0].alias("node"))


def _siblings(nodes: list[str]) -> list[str]:
    out = []
    for at in range(0, len(nodes), FANOUT):
        run = nodes[at:at + FANOUT]
        out += ["".join(run[:i] + run[i + 1:]) for i in range(len(run))]
    return out


def _finish(inner: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """One superblock: local reduction, proofs joined with the outer nodes, folding."""
    inner = inner.sort_values("pos", ignore_index=True)
    nodes, many, local = inner["node"].tolist(), inner["n"].iloc[0] > SPAN, []
    while len(local) < LEVELS and (many or len(nodes) > 1):
        local.append(_siblings(nodes))
        nodes = [sha256("".join(nodes[at:at + FANOUT]).encode()).hexdigest() for at in range(0, len(nodes), FANOUT)]
    above, turns, top = list(outer["proof"].iloc[0]), list(outer["places"].iloc[0]), outer["top"].iloc[0]
    scale = [FANOUT ** k for k in range(len(local))]
    inner["proof"] = [[s[i // d] for s, d in zip(local, scale)] + above for i in range(len(inner))]
    inner["places"] = [[i // d % FANOUT for d in scale] + turns for i in range(len(inner))]
    inner["top"] = top
    if "presented" in inner:
        shown = inner["presented"].where(inner["presented"].notna(), inner["node"])
        inner["folded_root"] = [fold(*x) for x in zip(shown, inner["proof"], inner["places"])]
    return inner.drop(columns=["b", "n"])


def _exchange(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """``nodes`` with proof, places and top; ``outer`` has those per superblock (g, b)."""
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema if f.name != "n"]
    folded = ["folded_root string"] if "presented" in nodes.columns else []
    schema = ", ".join([*kept, "proof array<string>", "places array<int>", "top string", *folded])
    inner = nodes.withColumn("b", F.expr(f"pos DIV {SPAN}")).groupBy("g", "b")
    return inner.cogroup(outer.groupBy("g", "b")).applyInPandas(_finish, schema)


def _outer(nodes: DataFrame, held: list[DataFrame]) -> DataFrame:
    """g, b, proof, places, top: what lies above each superblock of ``nodes`` (g, pos, n, node)."""
    blocks = spool(_blocks(nodes))
    held.append(blocks)
    if blocks.where("n > 1").isEmpty():
        return blocks.select("g", F.col("pos").alias("b"), F.array().cast("array<string>").alias("proof"),
                             F.array().cast("array<int>").alias("places"), F.col("node").alias("top"))
    return _exchange(blocks, _outer(blocks, held)).select("g", F.col("pos").alias("b"), "proof", "places", "top")


def manifest(rows: DataFrame, leaf: Column, group: Column, order: Column, presented: Column | None = None) -> DataFrame:
    """ord, grp, leaf, presented, position, subroot, root, proof, places, folded_root, verified: one row per row.

    ``proof`` has the siblings of every level as one string, leaf first and root last, ``places`` the
    place among them; ``fold`` leads from a leaf to the root.  ``presented`` is the digest to be checked,
    by default the leaf itself.
    """
    leaves = rows.select(order.alias("ord"), group.alias("grp"), leaf.alias("leaf"),
                         (F.lit(None).cast("string") if presented is None else presented).alias("presented"))
    placed, groups, held = _placed(leaves)
    nodes = spool(placed.withColumnRenamed("leaf", "node"))
    discard(held[0])
    held[0] = nodes
    outer = spool(_outer(nodes.select("g", "pos", "n", "node"), held))
    held.append(outer)
    n_groups = groups.count()
    subroots = outer.where("b = 0").select(F.lit(0).cast("long").alias("g"), (F.col("g") - 1).alias("pos"),
                                           F.lit(n_groups).cast("long").alias("n"), F.col("top").alias("node"))
    above = spool(_exchange(subroots, _outer(subroots, held)).select(
        (F.col("pos") + 1).alias("of"), F.col("proof").alias("p2"), F.col("places").alias("t2"), F.col("top").alias("root")))
    held.append(above)
    outer = outer.join(_sent(above), F.col("g") == F.col("of")).select(
        "g", "b", F.concat("proof", "p2").alias("proof"), F.concat("places", "t2").alias("places"),
        F.concat("top", "root").alias("top"))  # both digests, 64 letters each
    out = _exchange(nodes, outer)
    root = F.substring("top", 65, 64)
    return out.select("ord", "grp", F.col("node").alias("leaf"), "presented", F.col("pos").alias("position"),
                      F.substring("top", 1, 64).alias("subroot"), root.alias("root"), "proof", "places", "folded_root",
                      (F.col("folded_root") == root).alias("verified"))
