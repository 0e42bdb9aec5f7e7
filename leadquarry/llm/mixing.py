"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a uniform hash.  A source that shall give the share ``t`` of its own size ``S``
takes ``floor(t / S)`` whole copies, and one more copy of the documents whose hash lies below a
threshold.  The threshold comes from histograms: sizes are summed by source and hash bucket, the
bucket in which the budget runs out is cut into finer buckets, and only its documents are read
again, until a single hash is left.  The document there is taken if that brings the source nearer
to its target.  Nothing is sorted but one row per source and bucket.

Defined results: a null key hashes like the empty string; rows with equal keys are taken together;
null texts and empty ones have size 0 and are taken or left by their hash like any other; a null
source is a source of its own, last in order; an empty table gives an empty result; clashing
column names of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadquarry.llm.common import n_words
from leadquarry.session import discard, spool

HASH_BITS = 60
#: Bits of the hash that one histogram resolves.
LEVEL_BITS = 10
#: With more sources than this the per-source tables are joined by shuffle, not sent to all tasks.
BROADCAST_SOURCES = 100_000


def unit_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5, which any engine can recompute."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: weighted shares of the budget, none above ``most`` times its source.

    The excess of capped sources is dealt out again by weight until none is above: the sources
    capped in the end are those with the smallest cap per weight, so one pass in that order finds
    the final rate.  One row per source is all that is ordered here.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    t = sizes.select("source", "source_size", weight.alias("weight"))
    t = t.withColumns({"cap": most * F.col("source_size"), "budget": share * F.sum("source_size").over(everything)})
    t = t.withColumn("limit", F.col("cap") / F.col("weight"))
    by_limit = Window.orderBy("limit", F.col("source").asc_nulls_last())
    t = t.withColumn("nth", F.row_number().over(by_limit))
    earlier = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("nth").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("rate", (F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
                     / F.sum("weight").over(later))
    fits = F.when(F.col("rate") <= F.col("limit"), F.struct("nth", "rate"))
    t = t.withColumn("rate", F.coalesce(F.min(fits).over(everything).rate, F.max("limit").over(everything)))
    return t.select("source", "source_size", F.least("cap", F.col("rate") * F.col("weight")).alias("target"))


def _join_sources(df: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    right = per_source.withColumnRenamed("source", "of_source")
    right = F.broadcast(right) if few else right
    return df.join(right, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def thresholds(sized: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """source, below: documents with a hash under ``below`` come nearest to the budget ``part``."""
    state = budgets.select("source", F.col("part").alias("left"), F.lit(0).cast("long").alias("prefix"))
    done = None
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - (level + 1) * LEVEL_BITS
        inside = _join_sources(sized, state, few).where(
            F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        buckets = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"),
            F.first("left").alias("left"))
        # At most 2 ** LEVEL_BITS rows per source.
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        boundary = buckets.withColumn("upto", upto).where(F.col("upto") > F.col("left")).groupBy("source").agg(
            F.min(F.struct("bucket", "words", "low", "high", "left", "upto")).alias("b")).select("source", "b.*")
        boundary = boundary.withColumn("left", F.col("left") - (F.col("upto") - F.col("words")))
        boundary = spool(boundary)
        single = boundary.where("low = high").select("source", F.when(
            F.col("words") - F.col("left") < F.col("left"), F.col("low") + 1).otherwise(F.col("low")).alias("below"))
        done = single if done is None else done.unionByName(single)
        state = boundary.where("low < high").select("source", "left", F.col("bucket").alias("prefix"))
        if state.isEmpty():
            break
    return done


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        doc_id: str = "doc_id", source: str = "source", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; with ``keep`` also the input's row as ``row``."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                         unit_hash(F.col(doc_id)).alias("hash"))
    sized = spool(narrow)
    sums = spool(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    few = sums.count() <= BROADCAST_SOURCES
    goal = targets(sums, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = spool(goal.withColumn("whole", whole).withColumn(
        "part", F.col("target") - F.col("whole") * F.col("source_size")))
    below = thresholds(sized, goal, few).withColumnRenamed("source", "b_source")
    plan = spool(goal.join(below, F.col("source").eqNullSafe(F.col("b_source")), "left").select(
        "source", "source_size", "target", "whole", F.coalesce("below", F.lit(0).cast("long")).alias("below")))
    discard(sums)
    if keep:
        sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                            n_words(F.col(text)).alias("size"), unit_hash(F.col(doc_id)).alias("hash"),
                            F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    copies = F.col("whole") + (F.col("hash") < F.col("below")).cast("long")
    out = _join_sources(sized, plan, few).withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).alias("taken"), *(["row"] if keep else []))
