"""Exact top-k inner-product search by distributed histogram selection.

Queries and candidates are dealt into blocks of bounded size and every pair of blocks meets in one
group, so each score is computed in some task and no task holds more than two blocks.  A round sums
a histogram of every query's scores over all groups, finds the bucket that holds its k-th best
score and cuts that bucket again, until it is one score wide.  A last round keeps the scores that
reach the k-th and breaks ties by the smaller id.

A group reports a query's buckets only down to the one in which it has k scores itself: the global
k-th score cannot lie below.  Scores are not stored between rounds; computing them again is cheaper
than moving them.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do
rows without an id; of repeated ids the smallest vector counts; vectors meet only vectors of their
own length; a query with fewer candidates than k gets all; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadquarry.session import discard, spool

CANDIDATES_PER_BLOCK = 2048
QUERIES_PER_BLOCK = 4096
BUCKETS = 256
#: Queries scored at a time inside a group.
STRIP = 512


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, one row per id."""
    e = F.col(embedding)
    usable = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.where(usable & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(float) @ c.astype(float).T).astype(np.int64) if most < 2.0**53 else q @ c.T


def _strips(left: pd.DataFrame, right: pd.DataFrame):
    """(rows of left, their scores, mask of the candidates that are not the query itself)."""
    if not len(left) or not len(right):
        return
    c, ids = np.stack(right.v.to_numpy()), right.vec_id.to_numpy()
    for at in range(0, len(left), STRIP):
        part = left.iloc[at:at + STRIP]
        yield part, _scores(np.stack(part.v.to_numpy()), c), part.vec_id.to_numpy()[:, None] != ids


def _histogram(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    found = [pd.DataFrame({"vec_id": np.empty(0, np.int64), "bucket": np.empty(0, np.int64), "n": np.empty(0, np.int64)})]
    for part, s, other in _strips(left, right):
        low, high, width, need = (part[x].to_numpy()[:, None] for x in ("low", "high", "width", "need"))
        inside = other & (s >= low) & (s < high)
        bucket = np.where(inside, (s - low) // width, 0) + np.arange(len(part))[:, None] * BUCKETS
        n = np.bincount(bucket[inside], minlength=len(part) * BUCKETS).reshape(len(part), BUCKETS)
        better = n[:, ::-1].cumsum(1)[:, ::-1] - n
        row, col = np.nonzero((n > 0) & (better < need))
        found.append(pd.DataFrame({"vec_id": part.vec_id.to_numpy()[row], "bucket": col, "n": n[row, col]}))
    return pd.concat(found)


def _winners(k: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    found = [pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})]
    ids = right.vec_id.to_numpy() if len(right) else np.empty(0, np.int64)
    for part, s, other in _strips(left, right):
        row, col = np.nonzero(other & (s >= part.low.to_numpy()[:, None]))
        score = s[row, col]
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, row)  # position of the query's best row
        own = np.arange(len(row)) - first < k
        found.append(pd.DataFrame({"query_id": part.vec_id.to_numpy()[row[own]], "vec_id": ids[col[own]], "score": score[own]}))
    return pd.concat(found)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64,
          vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other vectors, ties to the smaller id."""
    all_rows = spool(quantised(vectors, vec_id, embedding, scale).withColumns(
        {"dims": F.size("v"), "norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))}))
    asked = all_rows.where(is_query)
    total, longest, n_asked = all_rows.agg(
        F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0)), F.count(F.when(is_query, 1))).first()
    c_blocks, q_blocks = max(1, -(-total // CANDIDATES_PER_BLOCK)), max(1, -(-n_asked // QUERIES_PER_BLOCK))
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = all_rows.select(*[F.col(c).alias(c) for c in ("dims", "vec_id", "v")],  # columns of their own
                                 block(c_blocks, 1).alias("cb"), each(q_blocks).alias("qb"))

    def meet(state: DataFrame, run, schema: str) -> DataFrame:
        queries = asked.select("dims", "vec_id", "v").join(state, "vec_id").withColumns(
            {"qb": block(q_blocks, 2), "cb": each(c_blocks)})
        key = ["dims", "qb", "cb"]
        return queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInPandas(run, schema)

    # Scores lie within +-bound by Cauchy and Schwarz.
    bound = (F.ceil(F.col("norm") * F.lit(longest)) + 1).cast("long")
    state = asked.select("vec_id", (-bound).alias("low"), (bound + 1).alias("high"), F.lit(k).cast("long").alias("need"))
    width = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("high") - F.col("low")) / BUCKETS).cast("long"))
    rounds = max(1, math.ceil(math.log(2 * longest * longest + 8, BUCKETS)))
    for _ in range(rounds):
        state = state.withColumn("width", width)
        n = meet(state, _histogram, "vec_id long, bucket long, n long").groupBy("vec_id", "bucket").agg(F.sum("n").alias("n"))
        best_first = Window.partitionBy("vec_id").orderBy(F.desc("bucket"))
        n = n.withColumns({"upto": F.sum("n").over(best_first), "all": F.sum("n").over(Window.partitionBy("vec_id"))})
        n = n.join(state, "vec_id").where(F.col("upto") >= F.least("need", "all"))
        at = n.groupBy("vec_id").agg(F.max(F.struct("bucket", "n", "upto", "all", "need", "low", "high", "width")).alias("b"))
        low = F.col("b.low") + F.col("b.bucket") * F.col("b.width")
        before, state = state, spool(at.select(
            "vec_id", low.alias("low"), F.least(F.col("b.high"), low + F.col("b.width")).alias("high"),
            (F.least("b.need", "b.all") - (F.col("b.upto") - F.col("b.n"))).alias("need")))
        if hasattr(before, "_spooled_at"):
            discard(before)
    found = meet(state, partial(_winners, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
