"""Repeated passages, found from difference-cover anchors.

Positions modulo ``PERIOD`` that lie in the difference cover are anchors: for any two positions
some shift below the period brings both onto the cover.  A match of ``window`` words therefore
contains, at equal depth on both sides, an anchor of ``window - PERIOD + 1`` words.  Only anchors
(three positions in seven) are grouped; an anchor of two documents is live.  A live anchor extends
to the windows around it: those are grouped in turn, and a window that starts in a smaller doc_id
too marks its words.  Groups are reduced to their smallest and largest document before the shuffle,
so a passage of a third of all documents costs one row per task, and no pairs are formed.

Sequences of words are told apart by 64-bit hashes: of each word by XXH3, of a sequence by a mixed
sum of its word hashes times random odd constants, one per place.  Among 10^12 different windows
the chance of taking one for another is 5e-8 for each.

Defined results: null and empty texts have no words and keep the empty text; texts shorter than a
window lose nothing; rows with a null doc_id keep all their words and remove nothing elsewhere;
repeated rows (equal doc_id) count as one document and get equal results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadquarry.session import discard, spool

PERIOD = 7
COVER = (0, 1, 3)  # every difference modulo 7 is a difference of two of these
PLACES = np.array([random.Random(i).getrandbits(64) | 1 for i in range(256)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Batch:
    """The texts of an Arrow column as one run of words."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = [(t.as_py() or "").encode().split() for t in texts]  # bytes split at ASCII white space alone
        self.sizes = np.array([len(ws) for ws in self.words], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.window, self.n = window, int(self.sizes.sum())
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(self.words)), np.uint64, self.n)
        self.row = np.repeat(np.arange(len(self.words)), self.sizes)
        self.place = np.arange(self.n) - self.first[self.row]
        self.after = self.sizes[self.row] - self.place  # words from here to the end of the text

    def sequences(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the sequences of ``length`` words that start at the positions."""
        total = np.zeros(len(at), np.uint64)
        for j in range(length):
            total += self.hashes[at + j] * PLACES[j]
        return _mix(total + PLACES[255:] * np.uint64(length))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors of texts as long as a window."""
        size = self.window - PERIOD + 1
        on_cover = np.isin(np.arange(PERIOD), COVER)[self.place % PERIOD]
        at = np.flatnonzero(on_cover & (self.after >= size) & (self.sizes[self.row] >= self.window))
        return at, self.sequences(at, size)

    def windows(self, live: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the windows around the anchors that are live for their text."""
        at, made = self.anchors()
        at = at[_within(self.row[at], made, live)]
        near = np.zeros(self.n + PERIOD, bool)
        for j in range(PERIOD):  # windows that begin up to a period earlier in the same text
            start = at - j
            near[start[self.place[at] >= j]] = True
        start = np.flatnonzero(near[:self.n] & (self.after >= self.window))
        return start, self.sequences(start, self.window)


def _within(rows: np.ndarray, hashes: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each hash is in its row's list."""
    lists = lists if lists.null_count == 0 else lists.fill_null([])
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    salt = lambda r: _mix((r.astype(np.uint64) + np.uint64(1)) * PLACES[254])
    return np.isin(hashes ^ salt(rows), flat ^ salt(owner))


def _pairs(ids: pa.Array, rows: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids.to_numpy()[rows])], ["h", "doc_id"])


def _shared(rows: DataFrame) -> DataFrame:
    """(h, low) of the hashes that occur in two documents."""
    return rows.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "low")


def remove_repeats(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words no smaller document has in a window of that length."""
    if not PERIOD <= window < 254:
        raise ValueError(f"window must be {PERIOD} to 253 words")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(batch.column(1), window)
            at, made = b.anchors()
            yield _pairs(batch.column(0), b.row[at], made)

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(batch.column(1), window)
            at, made = b.windows(batch.column(2))
            yield _pairs(batch.column(0), b.row[at], made)

    def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(batch.column(1), window)
            at, made = b.windows(batch.column(2))
            at = at[_within(b.row[at], made, batch.column(3))]
            covered = np.zeros(b.n + window, np.int64)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + window, -1)
            keep = np.cumsum(covered)[:b.n] == 0
            removed = np.bincount(b.row[~keep], minlength=len(b.sizes))
            kept = []
            for ws, start, gone in zip(b.words, b.first.tolist(), removed.tolist()):
                if gone:
                    ws = [w for w, k in zip(ws, keep[start:start + len(ws)].tolist()) if k]
                kept.append(b" ".join(ws).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(b.sizes), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])

    named = source.where("doc_id IS NOT NULL")
    anchors = named.mapInArrow(anchor_rows, "h long, doc_id long")
    live = spool(_shared(anchors).select("h"))
    of_doc = spool(anchors.join(live, "h").groupBy("doc_id").agg(F.collect_set("h").alias("live")))
    discard(live)
    windows = spool(named.join(of_doc, "doc_id").select("doc_id", "text", "live").mapInArrow(window_rows, "h long, doc_id long"))
    shared = spool(_shared(windows))
    repeated = spool(windows.join(shared, "h").where("low < doc_id").groupBy("doc_id").agg(F.collect_set("h").alias("repeated")))
    discard(windows, shared)
    marked = of_doc.join(repeated, "doc_id")
    out = spool(source.join(marked, "doc_id", "left").select("doc_id", "text", "live", "repeated").mapInArrow(
        kept_rows, "doc_id long, n_words long, n_removed long, kept string"))
    discard(of_doc, repeated)
    return out
