"""SimHash near-duplicates found by deletion-variant signatures.

A document's fingerprint is a majority vote over the hashes of its word shingles.  Fingerprints
are cut into segments, few enough that two fingerprints within the radius agree, but for one bit
at most, in some segment: with radius r that takes r // 2 + 1 segments.  Each segment is indexed
once per bit with that bit wiped out (a one-wildcard variant), so two such fingerprints share a
variant, and an equality join on variants finds them; the whole fingerprints then decide.

Equal fingerprints are one class before anything else happens, so a group of copies of any size is
one row.  Inside a bucket the classes are linked by a spanning forest of true links, never by all
pairs.  A bucket of more than ``BUCKET`` classes is not compared at all: its members are indexed
again by variants of their remaining bits, which halves what they can differ in, until the buckets
are small.  Variants are counted first (combined before the shuffle), and only those that two
classes share are looked at.

With ``radius`` above 2 * segments - 1 pairs beyond that are found only if some segment happens to
agree; ``guaranteed`` tells the radius up to which none is lost.

Defined results: a null or empty text has the fingerprint zero and is linked like any other; a text
shorter than a shingle is one shingle; repeated rows share their class; the component of rows whose
ids are all null is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadquarry.llm import set_links
from leadquarry.llm.common import spread
from leadquarry.llm.graph import components
from leadquarry.llm.set_links import Jaccard
from leadquarry.llm.shingles import shingle_hashes
from leadquarry.session import discard, settings, spool

BUCKET = 4096
#: A bucket whose path leaves so few bits open holds few classes whatever the data; it is not split again.
FEW_BITS = 8
#: Buckets up to this size are compared in one array operation for all buckets of a size.
STACKED = 48


@dataclass(frozen=True)
class SimHash:
    shingle: int = 3
    words: int = 1  # 64-bit words of the fingerprint; word i hashes with seed + i
    radius: int = 3
    segment_bits: int = 32
    seed: int = 42

    @property
    def bits(self) -> int:
        return 64 * self.words

    @property
    def guaranteed(self) -> int:
        return min(self.radius, 2 * (self.bits // self.segment_bits) - 1)

    @property
    def columns(self) -> list[str]:
        return [f"f{i}" for i in range(self.words)]


#: Near-duplicate texts: the sets of five-word shingles decide, see ``set_links``.
NEAR_TEXTS = Jaccard(shingle=5, similarity=0.8)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # 1 MB of bits at a time, however long the text
        part = hashes[at:at + (1 << 14)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, how: SimHash, doc_id: str = "doc_id", text: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, f0, ...): one row per row of the input; ``keys`` are long columns that are carried along behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            columns = [batch.column(0)]
            for i in range(how.words):
                made = np.array([fingerprint(shingle_hashes(t.as_py(), how.shingle, how.seed + i)) for t in texts], np.uint64)
                columns.append(pa.array(made.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], ["doc_id", *how.columns, *keys])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *keys)
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in (*how.columns, *keys)))


def _variants(classes: DataFrame, how: SimHash) -> DataFrame:
    """One row per class and bit: the bit's segment without the bit, and which bit it was."""
    n, s = how.bits, how.segment_bits
    word = "f0" if how.words == 1 else "CASE p DIV 64 " + " ".join(
        f"WHEN {i} THEN {c}" for i, c in enumerate(how.columns)) + " END"
    out = classes.selectExpr(*how.columns, f"explode(sequence(0, {n - 1})) AS p")
    segment = f"shiftrightunsigned({word}, CAST(p % 64 DIV {s} * {s} AS INT)) & {(1 << s) - 1}L"
    bit = f"shiftleft(1L, CAST(p % {s} AS INT))"
    key = f"concat(p, ':', ({segment}) & ~{bit})" if s > 48 else f"shiftleft(CAST(p AS BIGINT), {s}) | (({segment}) & ~{bit})"
    return out.selectExpr(f"{key} AS k", *how.columns)


def _forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows of x."""
    edges, left = [], np.arange(len(x))
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            v = frontier.pop()
            near = np.bitwise_count(x[left] ^ x[v]).sum(1, dtype=np.int64) <= radius
            if near.any():
                hit, left = left[near], left[~near]
                edges += [(v, h) for h in hit]
                frontier += list(hit)
    return edges


def _bucket_edges(values: np.ndarray, offsets: np.ndarray, radius: int) -> np.ndarray:
    """Row numbers of linked classes, for buckets laid end to end."""
    sizes, found = np.diff(offsets), []
    for m in np.unique(sizes[(sizes > 1) & (sizes <= STACKED)]):
        starts = offsets[:-1][sizes == m]
        a, b = np.triu_indices(m, 1)
        per = max(1, 4_000_000 // len(a))
        for at in range(0, len(starts), per):
            base = starts[at:at + per]
            left, right = base[:, None] + a, base[:, None] + b
            near = np.zeros(left.shape, np.int64)
            for w in range(values.shape[1]):
                near += np.bitwise_count(values[left, w] ^ values[right, w])
            near = near <= radius
            links = near.sum(1)
            few = near & (links < m)[:, None]
            found.append(np.stack([left[few], right[few]], 1))
            for start in base[links >= m]:
                if edges := _forest(values[start:start + m], radius):
                    found.append(np.array(edges) + start)
    for start, m in zip(offsets[:-1][sizes > STACKED], sizes[sizes > STACKED]):
        if edges := _forest(values[start:start + m], radius):
            found.append(np.array(edges) + start)
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _linked(buckets: DataFrame, how: SimHash) -> DataFrame:
    """Links (a0.., b0..) inside buckets of at most BUCKET classes."""
    names = [f"{side}{i}" for side in "ab" for i in range(how.words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            values = np.stack([flat.field(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in how.columns], 1)
            edges = _bucket_edges(values, lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), how.radius)
            both = np.unique(np.concatenate([values[edges[:, 0]], values[edges[:, 1]]], 1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in both.T], names)

    members = buckets.groupBy("k").agg(F.collect_list(F.struct(*how.columns)).alias("members")).select("members")
    return members.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _deeper(hot: DataFrame, how: SimHash) -> DataFrame:
    """Variants of the bits that a bucket's path has not used yet; the path is a list of used bits."""
    pieces = how.guaranteed // 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(i + 1).to_numpy().view(np.uint64) for i in range(how.words)], 1)
            bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8), axis=1, bitorder="little")
            keys, rows = [], []
            for i, path in enumerate(batch.column(0).to_pylist()):
                used = {int(u) for u in path.rpartition("|")[2].split(",")}
                rest = np.array([b for b in range(how.bits) if b not in used], np.int64)
                for piece in np.array_split(rest, pieces):
                    now = ",".join(map(str, sorted(used | set(piece.tolist()))))
                    last = "=" if len(rest) - len(piece) <= FEW_BITS else ""
                    text = "".join(map(str, bits[i, piece]))
                    for j in range(len(piece)):
                        keys.append(f"{last}{path.rpartition('|')[0]}/{piece[j]}:{text[:j]}*{text[j + 1:]}|{now}")
                        rows.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *[pa.array(values[rows, w].view(np.int64)) for w in range(how.words)]],
                ["k", *how.columns])

    return hot.mapInArrow(run, "k string, " + ", ".join(f"{c} long" for c in how.columns))


def class_links(classes: DataFrame, how: SimHash, bucket: int = BUCKET) -> DataFrame:
    """Links between different fingerprints, enough of them to connect all that the radius connects."""
    spark = classes.sparkSession
    variants, found, depth = _variants(classes, how), [], 0
    while True:
        counts = spool(variants.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
        fine = (F.col("n") <= bucket) | (F.col("k").startswith("=") if depth else F.lit(False))
        small = variants.join(counts.where(fine).select("k"), "k")
        with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):  # both sides dealt by variant
            found.append(spool(_linked(small, how)))
        hot = counts.where(~fine).select("k")
        if hot.isEmpty():
            discard(counts)
            break
        hot = variants.join(hot, "k")
        if depth == 0:  # the path starts with the variant and the bits of its segment
            s = how.segment_bits
            used = F.expr(f"array_join(sequence(p DIV {s} * {s}, p DIV {s} * {s} + {s - 1}), ',')")
            hot = hot.withColumn("p", F.shiftright("k", s).cast("int")).withColumn(
                "k", F.concat(F.col("k").cast("string"), F.lit("|"), used)).drop("p")
        variants, depth = spool(_deeper(spool(hot.select("k", *how.columns)), how)), depth + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _hexed(how: SimHash, side: str = "f"):
    return F.concat(*[F.lower(F.lpad(F.hex(f"{side}{i}"), 16, "0")) for i in range(how.words)])


def _roots(prints: DataFrame, how: SimHash) -> DataFrame:
    """(fingerprint, smallest, root): each class, its smallest doc_id and the class its links lead to."""
    classes = spool(prints.groupBy("fingerprint", *how.columns).agg(F.min("doc_id").alias("smallest")))
    links = class_links(spread(classes), how)
    roots = components(links.select(_hexed(how, "a").alias("a"), _hexed(how, "b").alias("b")))
    return spool(classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "smallest", F.coalesce("root", "fingerprint").alias("root")))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """k1, k2, doc_id, text.  A row goes by two hashes of all its columns, nulls marked; equal rows share them."""
    return docs.select(*_key(docs), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _key(docs: DataFrame) -> list:
    parts = [docs[c] for c in docs.columns] + [docs[c].isNull() for c in docs.columns]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("again"), *parts).alias("k2")]


def near_duplicates(docs: DataFrame, how: SimHash | Jaccard = SimHash(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id that links lead to."""
    if isinstance(how, Jaccard):
        prints, rooted, _ = set_links.roots(_keyed(docs, doc_id, text), how)
    else:
        prints = spool(fingerprints(docs, how, doc_id, text).withColumn("fingerprint", _hexed(how)))
        rooted = _roots(prints, how)
    component = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    # Classes are as many as documents at most; a class with very many copies is one row on this side.
    named = spool(rooted.join(component, "root").select("fingerprint", "component_id"))
    out = prints.select("doc_id", "fingerprint").join(named, "fingerprint")
    return out.select("doc_id", "fingerprint", "component_id")


def _joined_roots(keyed: DataFrame, by_sets: DataFrame, how: SimHash) -> DataFrame:
    """``by_sets`` (k1, k2, doc_id, root) with the roots that the links of the fingerprints lead to as well.

    A component of fingerprints links the components of sets that its rows lie in, by way of the smallest of them."""
    prints = spool(fingerprints(keyed, how, keys=("k1", "k2")).withColumn("fingerprint", _hexed(how)))
    rooted = _roots(prints, how)
    named = prints.groupBy("k1", "k2").agg(F.first("fingerprint").alias("fingerprint")).join(
        rooted.select("fingerprint", F.col("root").alias("print")), "fingerprint").select("k1", "k2", "print")
    met = spool(by_sets.select("k1", "k2", "root").join(named, ["k1", "k2"]).select("print", "root").distinct())
    least = met.groupBy("print").agg(F.min("root").alias("least"))
    led = components(met.join(least, "print").where("root <> least").select(F.col("least").alias("a"), F.col("root").alias("b")))
    out = spool(by_sets.join(led.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select(
        "k1", "k2", "doc_id", F.coalesce("further", "root").alias("root")))
    discard(prints, rooted, met, led, by_sets)
    return out


def deduplicate(docs: DataFrame, how: Jaccard = NEAR_TEXTS, doc_id: str = "doc_id", text: str = "text",
                prints: SimHash | None = None) -> DataFrame:
    """The rows of ``docs``, one per component: that with the smallest id, null ids last.

    Texts are linked by their sets (``how``) and, if given, by their fingerprints too (``prints``, op3's method)."""
    keyed = _keyed(docs, doc_id, text)
    classes, rooted, held = set_links.roots(keyed, how)
    # equal rows share a key, and a row of it
    rows = spool(classes.join(rooted.select("fingerprint", "root"), "fingerprint").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("doc_id"), F.min("root").alias("root")))
    discard(*held)
    if prints is not None:
        rows = _joined_roots(keyed, rows, prints)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")).alias("first"))
    kept = spool(first.select("first.k1", "first.k2"))
    discard(rows)
    # Texts are shuffled once, equal rows combined on the way; the kept keys meet them there.
    whole = docs.select(*_key(docs), F.struct(*[docs[c] for c in docs.columns]).alias("row")).groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return whole.join(kept, ["k1", "k2"], "left_semi").select("row.*")
