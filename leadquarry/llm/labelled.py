"""Bounded, reproducible samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadquarry.session import spool


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids are in fold zero."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, trained: Column, bound: int,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most about ``bound`` labelled documents of the training folds.

    A document labelled more than once counts with its highest label.  Where more rows are
    labelled than ``bound``, those with the smallest hashes of their ids are taken.  The sample is
    bounded, so it is sent to the tasks that read the documents, and no text is shuffled.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & trained).groupBy(
        F.col("doc_id").alias("of_doc")).agg(F.max(label).cast("int").alias("y"))
    one = spool(one)
    n = one.count()
    if n > bound:
        one = one.where(F.pmod(F.xxhash64(F.col("of_doc"), F.lit("sample")), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return narrow.join(F.broadcast(one), F.col("doc_id") == F.col("of_doc")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
