"""Near-duplicates by exact Jaccard similarity of shingle sets.

Candidates: every class of equal sets has ``BANDS`` keys, each made of ``ROWS`` min-hashes, so two sets
share a key with the odds of their similarity to the power of ``ROWS``; a pair at 0.8 shares none with
odds of 1 in 80,000, one at 0.9 with odds under 1 in 10^13.  A bucket, the classes that share a key, is never paired out.  Its
smallest class, the pivot, meets all others, and that ends a bucket of two.  Classes of buckets that lie in
more components are dealt anew by their rarest shingles: two similar sets share one so early in the order of
rarity that what follows can still reach the similarity, so classes with a mere passage in common do not meet.
Buckets around one largest component are a group with a centre, the shingles of over half of it.  Sets that depart little
from it are all similar to the one that departs least; others must share departures, and are dealt by their rarest ones.
These buckets go on in rounds: each compares the next ``PIVOTS`` classes outside a bucket's largest component
with the rest of it, until one component or none is left.

Narrow before wide: pairs are ids alone.  A 256-bit majority fingerprint per class drops the pairs beyond
``BITS`` bits (a pair at 0.8 lies beyond with odds under 2 in 10 million); then each class is compared with
its smallest partner, and afterwards only pairs whose ends the links found so far leave apart are compared.
What is compared is decided by the whole sets; only sets of classes in such pairs, or dealt anew, are made and shuffled.
A class in very many pairs is a skewed join key, which adaptive execution splits.

Equal sets are one class before anything else happens.  Sets and shingles go by 64-bit hashes: among 10
million sets two differ and share a hash with odds of 3 in a million.

Defined results: null and empty texts are one class, the empty set; a text shorter than a shingle is one
shingle; repeated rows share their class; ties do not matter, a class is named by its hash; very long texts
are taken whole; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadquarry.llm.graph import components
from leadquarry.llm.shingles import shingle_hashes
from leadquarry.operators.skew import lookup_join
from leadquarry.session import discard, settings, spool

#: So many classes of a bucket are compared with all its others a round.
PIVOTS = 256
#: Keys of a class, and min-hashes in a key.
BANDS, ROWS = 48, 7
#: Words of the fingerprint, and the bits in which fingerprints of similar sets may differ.
WORDS, BITS = 4, 80
SKETCH = [f"s{i}" for i in range(WORDS)]
#: Hashes worked on at a time, however long the text.
BLOCK = 1 << 8


@dataclass(frozen=True)
class Jaccard:
    shingle: int = 5
    similarity: float = 0.8
    seed: int = 42


def shingle_set(text: str | None, how: Jaccard) -> np.ndarray:
    return np.unique(shingle_hashes(text, how.shingle, how.seed))


def _mixed(hs: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of each hash."""
    x = hs ^ np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hs: np.ndarray) -> np.ndarray:
    """Majority fingerprint of a set, ``WORDS`` words."""
    out = np.zeros(WORDS, np.uint64)
    for w in range(WORDS if len(hs) else 0):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hs), 1 << 14):
            part = _mixed(hs[at:at + (1 << 14)], w).astype("<u8").view(np.uint8)
            ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        out[w] = np.packbits(2 * ones > len(hs), bitorder="little").view("<u8")[0]
    return out


_RANDOM = _mixed(np.arange(2 * BANDS * ROWS, dtype=np.uint64), 1000).astype(np.uint32).reshape(2, -1, 1)


def bands(hs: np.ndarray) -> np.ndarray:
    """Keys of which two sets share each with the odds of their similarity to the power of ``ROWS``; none for the empty set."""
    if not len(hs):
        return hs
    narrow = (hs >> np.uint64(32)).astype(np.uint32)  # values that coincide only bring more candidates
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hs), BLOCK):
        permuted = narrow[at:at + BLOCK] ^ _RANDOM[0]
        permuted *= _RANDOM[1] | np.uint32(1)
        np.minimum(least, permuted.min(axis=1), out=least)
    least = least.astype(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = _mixed(out ^ least[:, r], r)
    return out


def _described(keyed: DataFrame, how: Jaccard) -> DataFrame:
    """k1, k2, doc_id, the hash c of the text's set, its size n, its fingerprint and its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), how) for t in batch.column(3)]
            c = np.array([xxhash.xxh64_intdigest(hs.astype("<u8").tobytes(), how.seed) for hs in sets], np.uint64)
            prints = np.array([sketch(hs) for hs in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            keys = pa.array([bands(hs).view(np.int64) for hs in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(c.view(np.int64)), pa.array([len(hs) for hs in sets], pa.int32()),
                 *[pa.array(np.ascontiguousarray(w)) for w in prints.T], keys], ["k1", "k2", "doc_id", "c", "n", *SKETCH, "ys"])

    schema = "k1 long, k2 long, doc_id long, c long, n int, " + ", ".join(f"{s} long" for s in SKETCH) + ", ys array<long>"
    return keyed.select("k1", "k2", "doc_id", "text").mapInArrow(run, schema)


def _side(rows: DataFrame, x: str) -> DataFrame:
    """The class, size and fingerprint columns of ``rows``, named for one end of a pair."""
    return rows.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), *[F.col(s).alias(f"{s}{x}") for s in SKETCH])


def _may(how: Jaccard, a: str = "{}a", b: str = "{}b") -> str:
    """Whether sizes and fingerprints let two sets be similar enough."""
    na, nb = a.format("n"), b.format("n")
    apart = " + ".join(f"bit_count({a.format(s)} ^ {b.format(s)})" for s in SKETCH)
    return f"least({na}, {nb}) >= {how.similarity} * greatest({na}, {nb}) - 1e-9 AND {apart} <= {BITS}"


def _similar(pairs: DataFrame, sets: DataFrame, how: Jaccard) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("hs").alias("ha")), "a").join(
        sets.select(F.col("c").alias("b"), F.col("hs").alias("hb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("o"), (F.size("ha") + F.size("hb")).alias("n"))
    return both.where(F.col("o") >= how.similarity * (F.col("n") - F.col("o")) - 1e-9).select("a", "b")


class _Forest:
    """Verified links and the components that they make."""

    def __init__(self, keyed: DataFrame, classes: DataFrame, how: Jaccard):
        self.keyed, self.classes, self.how = keyed, classes, how
        self.led: DataFrame | None = None  # node, root

    def placed(self, rows: DataFrame, c: str, root: str) -> DataFrame:
        """``rows`` with the root of the class in ``c``."""
        if self.led is None:
            return rows.withColumn(root, F.col(c))
        found = rows.join(self.led.select(F.col("node").alias(c), F.col("root").alias(root)), c, "left")
        return found.withColumn(root, F.coalesce(root, c))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """c, hs: the whole sets of the classes in ``wanted``, made from one text each."""
        how = self.how

        @F.pandas_udf("array<long>")
        def whole(texts: pd.Series) -> pd.Series:
            return pd.Series([shingle_set(t, how).view(np.int64) for t in texts])

        reps = self.classes.join(wanted.distinct(), "c", "left_semi").select("c", "k.k1", "k.k2")
        texts = self.keyed.select("k1", "k2", "text").join(reps, ["k1", "k2"]).groupBy("c").agg(F.first("text").alias("text"))
        return spool(texts.select("c", whole("text").alias("hs")))

    def link(self, pairs: DataFrame) -> None:
        """Compare spooled pairs: each class with its smallest partner first, then what is still apart."""
        if pairs.isEmpty():
            return
        sets = self.sets(pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))))
        first = pairs.groupBy("b").agg(F.min("a").alias("a"))
        self._take(_similar(first, sets, self.how))
        apart = self.placed(self.placed(pairs, "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
        rest = spool(apart.join(first, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            self._take(_similar(rest, sets, self.how))
        discard(sets, rest)

    def _take(self, links: DataFrame) -> None:
        links = spool(links)
        if not links.isEmpty():
            known = links if self.led is None else links.unionByName(self.led.select(F.col("node").alias("a"), F.col("root").alias("b")))
            led = components(known)
            if self.led is not None:
                discard(self.led)
            self.led = led
        discard(links)


def _open(left: DataFrame, forest: _Forest) -> DataFrame:
    """The rows of ``left`` whose bucket y lies in more than one component, with root, and main, the largest component."""
    placed = spool(forest.placed(left, "c", "root"))
    main = placed.groupBy("y", "root").agg(F.count("*").alias("m")).groupBy("y").agg(
        F.max(F.struct("m", "root")).alias("x"), F.count("*").alias("roots")).where("roots > 1").select("y", F.col("x.root").alias("main"))
    going = spool(placed.join(main, "y"))
    discard(placed)
    return going


def _reaches(how: Jaccard, ni: str, i: str, nj: str) -> str:
    """Whether a set of ``ni`` shingles, ``i`` of them before the first shared one, can be similar enough to one of ``nj``."""
    return f"{ni} - {i} >= {how.similarity / (1 + how.similarity)} * ({ni} + {nj}) - 1e-9"


def _prefixes(sets: DataFrame, how: Jaccard) -> DataFrame:
    """y, c: the rarest shingles y of each class c.

    Shingles are ordered by the number of classes that hold them.  Similar sets share a shingle so early that
    both can still reach the similarity; a shingle of one class alone only takes a place."""
    held = sets.select("c", F.explode("hs").alias("h"))
    df = held.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ordered = lookup_join(held, df, ["h"]).where("df IS NOT NULL").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
    placed = ordered.join(sets.select("c", F.size("hs").alias("n")), "c").withColumn("own", F.col("n") - F.size("hs"))
    upto = F.floor(F.lit(1 - how.similarity + 1e-9) * F.col("n")).cast("int") + 1 - F.col("own")
    early = placed.where(upto > 0).select("c", "n", "own", F.posexplode(F.slice("hs", F.lit(1), upto)).alias("at", "x"))
    rows = spool(early.select(F.col("x.h").alias("y"), "c", "n", (F.col("own") + F.col("at")).alias("i")))
    # no set of the bucket is smaller than its least, so what cannot reach that one pairs with none
    least = rows.groupBy("y").agg(F.min("n").alias("least"), F.count("*").alias("m")).where("m > 1").select("y", "least")
    out = spool(lookup_join(rows, least, ["y"]).where("least IS NOT NULL").where(
        _reaches(how, "n", "i", f"greatest(least, {how.similarity} * n)")).select("y", "c"))
    discard(rows)
    return out


#: What two sets must share of their departures from one centre, by their slacks, to be similar.
_OWED = "-({} + {}) / 2 - 1e-6"


def _departures(members: DataFrame, sets: DataFrame, how: Jaccard) -> DataFrame:
    """y, c, gone, f: where each set departs from the centre of its group y, and how much slack is left to it.

    The centre holds the shingles of over half of the group.  Two sets are similar if they differ in no more
    than a fixed share of their sizes; the slack f is this share of a set's size less its departures.  So sets
    whose slacks add up to zero or more are similar, and others must share departures: half of what is missing."""
    held = spool(members.join(sets, "c"))
    size = held.groupBy("y").agg(F.count("*").alias("m"))
    count = held.select("y", F.explode("hs").alias("h")).groupBy("y", "h").agg(F.count("*").alias("k"))
    centre = spool(count.join(size, "y").where("2 * k > m").groupBy("y").agg(F.collect_list("h").alias("mid")))
    both = lookup_join(held, centre, ["y"]).withColumn("mid", F.coalesce("mid", F.array().cast("array<bigint>")))
    apart = both.withColumn("gone", F.concat(F.array_except("hs", "mid"), F.array_except("mid", "hs")))
    share = (1 - how.similarity) / (1 + how.similarity)
    out = spool(apart.select("y", "c", "gone", (share * F.size("hs") - F.size("gone")).alias("f")))
    discard(held, centre)
    return out


def _by_departures(going: DataFrame, forest: _Forest) -> DataFrame:
    """y, c, f, rest: classes of groups still open, keyed by their rarest departures; ``rest`` counts those not rarer.

    Sets that owe each other nothing are all similar to the one with the most slack, which is linked with them here."""
    best = spool(going.groupBy("y").agg(F.max(F.struct("f", "c")).alias("z")))
    placed = lookup_join(going.select("y", "c", "f"), best, ["y"]).where("c <> z.c AND f + z.f >= -1e-6")
    near = placed.select(F.least("c", "z.c").alias("a"), F.greatest("c", "z.c").alias("b")).distinct()
    pairs = spool(forest.placed(forest.placed(near, "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b"))
    forest.link(pairs)
    left = _open(going, forest)
    parts = left.select("y", "c", F.explode("gone").alias("h"))
    df = parts.groupBy("y", "h").agg(F.count("*").alias("df")).where("df > 1")
    ordered = lookup_join(parts, df, ["y", "h"]).where("df IS NOT NULL").groupBy("y", "c").agg(
        F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
    owed = F.greatest(F.lit(1), F.ceil(F.expr(_OWED.format("f", "z.f")))).cast("int")
    known = lookup_join(left.select("y", "c", "f", F.size("gone").alias("n")), best, ["y"]).withColumn("owed", owed)
    known = ordered.join(known, ["y", "c"]).withColumn("own", F.col("n") - F.size("hs"))
    upto = F.col("n") - F.col("owed") + 1 - F.col("own")
    early = known.where(upto > 0).select("y", "c", "f", "n", "own", F.posexplode(F.slice("hs", F.lit(1), upto)).alias("at", "x"))
    rows = spool(early.select("y", F.col("x.h").alias("h"), "c", "f", (F.col("n") - F.col("own") - F.col("at")).alias("rest")))
    top = rows.groupBy("y", "h").agg(F.max("f").alias("top"), F.count("*").alias("m")).where("m > 1").select("y", "h", "top")
    out = spool(lookup_join(rows, top, ["y", "h"]).where("top IS NOT NULL").where(f"rest >= {_OWED.format('f', 'top')}").select(
        F.struct("y", "h").alias("y"), "c", "f", "rest"))
    discard(best, pairs, left, rows)
    return out


def _work_off(left: DataFrame, forest: _Forest) -> None:
    """Compare the classes in spooled buckets (y, c), some outside the largest component with all others a round.

    Buckets that the first links leave in several components are dealt anew by rare shingles: a key shared by
    classes that have only a frequent passage in common would meet them all, a rare shingle does not.  Many edits of
    one text share its shingles too: buckets around one component are a group, dealt by departures from its centre."""
    narrow = ["c", "n", *SKETCH]
    met, going = left, _open(left, forest)
    discard(met)
    if going.isEmpty():
        discard(going)
        return
    sets = forest.sets(going.select("c"))
    left = _prefixes(sets, forest.how)
    discard(going)
    going = _open(left, forest)
    discard(left)
    if going.isEmpty():
        discard(going, sets)
        return
    groups = _departures(going.select(F.col("main").alias("y"), "c").distinct(), sets, forest.how)
    left = _by_departures(groups, forest)
    discard(going, sets, groups)
    while True:
        going = _open(left, forest)
        discard(left)
        if going.isEmpty():
            discard(going)
            return
        known = going.join(forest.classes.select(*narrow), "c")
        nth = F.row_number().over(Window.partitionBy("y").orderBy("c"))
        few = known.where("root <> main").withColumn("nth", nth).where(F.col("nth") <= PIVOTS)
        few = spool(few.groupBy("y").agg(F.collect_list(F.struct("root", "f", "rest", *narrow)).alias("few"), F.max("c").alias("upto")))
        owes = f"p.root <> root AND least(rest, p.rest) >= {_OWED.format('f', 'p.f')} AND {_may(forest.how, 'p.{}', '{}')}"
        met = known.join(few.select("y", "few"), "y").select("c", F.explode(F.expr(f"filter(few, p -> {owes})")).alias("p"))
        pairs = spool(met.select(F.least("p.c", "c").alias("a"), F.greatest("p.c", "c").alias("b")).distinct())
        forest.link(pairs)
        left = spool(going.join(few.select("y", "upto"), "y").where("root = main OR c > upto").select("y", "c", "f", "rest"))
        discard(going, few, pairs)


def roots(keyed: DataFrame, how: Jaccard) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``keyed`` has k1, k2, doc_id, text; rows of equal k1, k2 are equal.

    Returns (k1, k2, doc_id, fingerprint) per row, (fingerprint, smallest, root) per class: its
    smallest doc_id and the class its links lead to, and the spooled tables to discard after both.
    """
    full = spool(_described(keyed, how))
    classes = spool(full.groupBy("c", "n", *SKETCH).agg(
        F.min("doc_id").alias("smallest"), F.min(F.struct("k1", "k2")).alias("k"), F.first("ys").alias("ys")))
    forest = _Forest(keyed, classes, how)
    entries = classes.select("c", F.explode("ys").alias("y"))
    with settings(keyed.sparkSession, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):  # sizes of exploded rows are not known
        pivots = entries.groupBy("y").agg(F.min("c").alias("p"), F.max("c").alias("last")).where("p < last").select("y", "p")
        met = spool(entries.join(pivots, "y").where("c <> p"))
        pairs = met.select(F.col("p").alias("a"), F.col("c").alias("b")).distinct()
        pairs = spool(pairs.join(_side(classes, "a"), "a").join(_side(classes, "b"), "b").where(_may(how)).select("a", "b"))
        forest.link(pairs)
        discard(pairs)
        _work_off(met, forest)
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    rooted = spool(forest.placed(classes.select("c", "smallest"), "c", "root").select(
        hexed("c").alias("fingerprint"), "smallest", hexed("root").alias("root")))
    discard(classes, *([] if forest.led is None else [forest.led]))
    return full.select("k1", "k2", "doc_id", hexed("c").alias("fingerprint")), rooted, [full, rooted]
