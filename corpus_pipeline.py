"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Every stage works on all rows that the one before kept.  Rows with null texts or ids pass through
the filters like any other (see the operators for what that means there); an empty table gives an
empty result; columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadquarry.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from leadquarry.llm.common import table
from leadquarry.llm.labelled import fold
from leadquarry.session import shared_folder

N_SHARDS = 40
REJECTED_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under ``REJECTED_FROM``; the lexicon is learned from the labelled training folds."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.with_score(docs, lexicon, "_toxicity").where(F.col("_toxicity") < REJECTED_FROM).drop("_toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8, and op3's fingerprints."""
    return near_dedup.deduplicate(docs, near_dedup.NEAR_TEXTS, prints=near_dedup.SimHash())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    taken = mixing.mix(docs, keep=True).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the mixed documents over the shards; one row per row of the input."""
    return sharding.shard_documents(docs, sharding.grid(N_SHARDS), sharding.grid(N_SHARDS + 1))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Learned and fingerprint stages have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
