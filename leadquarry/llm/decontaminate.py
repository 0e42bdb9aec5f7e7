"""Benchmark decontamination by SimHash over item-sized windows (DataFrame functions only).

Shingles of five words weigh the inverse of the number of different item texts that hold them, so
text that many items share counts little and an item listed again counts as before; in a window the
shingles that no item holds weigh what its others do on average.  Windows as long as a benchmark item are laid over every
place where a document's shingle falls on the same shingle of an item; a window without any item
shingle has similarity zero.  Each window gets a weighted SimHash.  Fingerprints of windows and
items are cut into ``radius + 1`` blocks; two within the radius agree in one block at least, so an
equality join on blocks finds every such pair.  The pairs are then verified exactly: weighted
Jaccard similarity of the two shingle sets of at least ``similarity``.

Windows whose shingles do not lie in benchmark items to the share ``similarity`` at least cannot reach it with any item and are dropped before they are fingerprinted.

A document's leaks depend on its text alone, so windows go by hashes of the text: equal texts are
looked at once, different texts under one id are kept apart.

Defined results: words are runs of letters and digits, lower-cased; null and empty texts and texts
shorter than a shingle match nothing, nor do items shorter than a shingle; rows without an id
cannot be reported but are dropped by ``clean`` like any other; documents of equal id are reported
once, with their best window; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadquarry.session import discard, spool

SHINGLE = 5
BITS = 64
#: Sets at a similarity of 0.8 differ in 9.7 bits on average (deviation 2.9); beyond 20 lie about 2 in 10,000.
RADIUS = 20
#: Item shingles up to this number are sent to all tasks; more are joined by shuffle.
BROADCAST_SHINGLES = 2_000_000
WORDS = r"[\p{L}\p{N}]+"


def _shingles(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep..., hs: the hashes of all shingles in order, at least one.

    Explode ``hs`` with the outer generators: for the inner ones the optimizer adds a non-empty
    test, pushes it below the words and so evaluates the words again for every shingle.
    """
    words = df.select(*keep, F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORDS), F.lit(0)).alias("ws"))
    at = F.sequence(F.lit(0), F.size("ws") - SHINGLE)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("ws"), i + j) for j in range(SHINGLE)]))
    return words.where(F.size("ws") >= SHINGLE).select(*keep, hashes.alias("hs"))


def _fingerprint(h: Column, weight: Column) -> Column:
    """Weighted SimHash as one aggregate: a bit is set if the shingles that have it weigh more."""
    votes = [F.sum(F.when(F.getbit(h, F.lit(i)) == 1, weight).otherwise(-weight)) for i in range(BITS)]
    fp = F.lit(0).cast("long")
    for i, v in enumerate(votes):
        fp = fp.bitwiseOR(F.when(v > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return fp


def _blocks(df: DataFrame, radius: int) -> DataFrame:
    """Adds the fingerprint's blocks, one row each."""
    n, start, parts = radius + 1, 0, []
    for i in range(n):
        width = BITS // n + (i >= n - BITS % n)
        value = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        parts.append(F.struct(F.lit(i).alias("no"), value.alias("value")))
        start += width
    return df.withColumn("block", F.explode(F.array(*parts)))


def _key(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("again"), F.col(text)).alias("t2")]


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = RADIUS,
          text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """t1, t2 (hashes of a text), item_id, similarity, start, n: the windows of each text that are similar enough to an item."""
    texts = docs.select(*_key(text), F.col(text).alias("text"))
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    placed = spool(_shingles(items, "text", "item_id").select(
        "item_id", F.xxhash64("hs").alias("item"), F.size("hs").alias("n"), F.posexplode_outer("hs").alias("offset", "h")))
    weights = spool(placed.groupBy("h").agg((1.0 / F.count_distinct("item")).alias("w")))
    item_sets = spool(placed.select("item_id", "h").distinct().join(weights, "h"))
    few = placed.count() <= BROADCAST_SHINGLES
    small = F.broadcast if few else (lambda df: df)

    # Windows: where a document's shingle lies on an item's.
    spots = placed.select("h", "offset", "n").distinct()
    shown = _shingles(texts, "text", "t1", "t2").select("t1", "t2", F.posexplode_outer("hs").alias("p", "h"))
    starts = shown.join(small(spots), "h").select(
        "t1", "t2", F.struct(F.greatest(F.col("p") - F.col("offset"), F.lit(0)).alias("start"), "n").alias("window"))
    per_text = spool(starts.groupBy("t1", "t2").agg(F.collect_set("window").alias("windows")))
    met = texts.join(per_text, ["t1", "t2"]).groupBy("t1", "t2").agg(F.first("text").alias("text"), F.first("windows").alias("windows"))
    hit = _shingles(met, "text", "t1", "t2", "windows")
    laid = hit.select("t1", "t2", "hs", F.explode_outer("windows").alias("window")).select(
        "t1", "t2", "hs", F.col("window.n").alias("n"),
        F.greatest(F.least(F.col("window.start"), F.size("hs") - F.col("window.n")), F.lit(0)).alias("start"))
    window = ["t1", "t2", "start", "n"]
    sets = laid.select(*window, F.explode_outer(F.array_distinct(F.slice("hs", F.col("start") + 1, F.col("n")))).alias("h"))
    weighed = sets.distinct().join(small(weights), "h", "left")
    passed = weighed.groupBy(*window).agg(F.count("*").alias("all"), F.count("w").alias("known"), F.sum("w").alias("shared"))
    passed = spool(passed.where(F.col("known") >= similarity * F.col("all") - 1e-9).select(*window, (F.col("shared") / F.col("known")).alias("mean")))
    held = spool(weighed.join(passed, window).select(*window, "h", F.coalesce("w", "mean").alias("w"), F.col("w").isNotNull().alias("held")))
    prints = spool(held.groupBy(*window).agg(F.sum("w").alias("weight"), _fingerprint(F.col("h"), F.col("w")).alias("fp")))
    weighed = held.where("held")

    # Pairs within the radius: equal in a block, then by all bits.
    item_prints = item_sets.groupBy("item_id").agg(F.sum("w").alias("item_weight"), _fingerprint(F.col("h"), F.col("w")).alias("fp"))
    blocks = _blocks(item_prints, radius).withColumnRenamed("fp", "item_fp")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    pairs = _blocks(prints, radius).join(small(blocks), "block").where(near).select(
        *window, "weight", "item_id", "item_weight").distinct()

    # Exact weighted Jaccard similarity of the pairs.
    common = pairs.join(weighed, window).join(small(item_sets.select("item_id", "h")), ["item_id", "h"]).groupBy(
        *window, "item_id").agg(F.sum("w").alias("common"), F.first("weight").alias("weight"), F.first("item_weight").alias("item_weight"))
    exact = common.withColumn("similarity", F.col("common") / (F.col("weight") + F.col("item_weight") - F.col("common")))
    out = spool(exact.where(F.col("similarity") >= similarity - 1e-9).select("t1", "t2", "item_id", "similarity", "start", "n"))
    discard(per_text, passed, held, prints, placed, weights, item_sets)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = RADIUS,
                 doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: each document's best window per item it leaks."""
    named = docs.where(F.col(doc_id).isNotNull())
    found = leaks(named, benchmark, similarity, radius, text, item_id, item_text)
    best = named.select(F.col(doc_id).cast("long").alias("doc_id"), *_key(text)).join(found, ["t1", "t2"]).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("b"))
    out = spool(best.select("doc_id", "item_id", F.round("b.similarity", 9).alias("similarity"),
                            (-F.col("b.back")).cast("long").alias("start_word"), (F.col("b.n") + SHINGLE - 1).cast("long").alias("n_words")))
    discard(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, whatever their ids."""
    found = leaks(docs, benchmark, text=text).select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).distinct()
    t1, t2 = _key(text)
    keyed = docs.withColumns({"_t1": t1, "_t2": t2})
    return keyed.join(found, ["_t1", "_t2"], "left_anti").select(*docs.columns)
