"""Ranked lexical search without an index of the documents: one Aho-Corasick scan counts every term of every item.

The terms of all items are the keys of one automaton, each with a boundary before and after it, so that
running a text through the automaton counts whole terms only.  The automaton is broadcast; a document is
read once, whatever the number of items, and leaves its length and the terms it holds with their counts.
Document frequencies and the corpus length are sums over these rows.  A second pass over them maps the
counted terms to items, adds up the scores and keeps the best ``k`` of every item inside each task; the
best of all tasks are merged.

Items are dealt into blocks whose automata stay within ``LETTERS`` letters (an item of more is a block of
its own), each with a scan of its own, so neither the broadcast nor what the driver holds grows with the
number of items.

Defined results: a null or empty text has no terms, and documents without terms count nowhere; an item is
an ``item_id``: rows that share one are one item with the terms of all, null is an id like any other; items
without terms return nothing; every document row is ranked, rows that repeat an id too; equal scores ascend
by doc_id, a null doc_id last; very long texts and very long terms are taken whole; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadquarry.operators.rank import prefix_sums, row_numbers
from leadquarry.session import discard, spool

#: What lies between terms.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of one automaton, boundaries included: about 100 MB.
LETTERS = 1_000_000
#: Cells of (document, item) scores, or of (term, item) places, that a task adds up at a time.
CELLS = 2_000_000

_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def automaton_of(terms: list[str]) -> ahocorasick.Automaton:
    """Keys are terms between two boundaries; the value is the term's place in the list."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, term in enumerate(terms):
        out.add_word(f" {term} ", i)
    out.make_automaton()
    return out


def _items(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, list[DataFrame]]:
    """q, item, term, block: one row per item and different term; q numbers the items."""
    term = F.explode(F.array_distinct(F.split(F.translate(F.col(text), UPPER, LOWER), GAP)))
    terms = spool(items.select(F.col(item_id).alias("item"), term.alias("term")).where("term <> ''").distinct())
    sizes = terms.groupBy("item").agg(F.sum(F.length("term") + 2).alias("letters"))
    numbered = row_numbers(sizes, [F.asc_nulls_first("item")], "q").withColumn("g", F.lit(0))
    blocks = spool(prefix_sums(numbered, "g", [F.asc("q")], ["letters"]).select(
        "q", F.col("item").alias("of"), F.expr(f"letters_before DIV {LETTERS}").cast("int").alias("block")))
    return terms.join(blocks, F.col("item").eqNullSafe(F.col("of"))).select("q", "item", "term", "block"), [terms, blocks]


def _counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n, ids, tfs: of every document with terms, the length and the counted terms."""
    told = docs.sparkSession.sparkContext.broadcast(automaton_of(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, second = told.value.iter, itemgetter(1)
        for batch in batches:
            kept, sizes, ids, tfs, ends = [], [], [], [], [0]
            for row, text in enumerate(batch.column(1)):
                plain = (text.as_py() or "").encode().translate(_LOWERED)
                n = len(plain.split())
                if not n:
                    continue
                found = Counter(map(second, find(f" {plain.decode()} ")))
                kept.append(row)
                sizes.append(n)
                ids += found.keys()
                tfs += found.values()
                ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], ["doc_id", "n", "ids", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<bigint>")


class _Best:
    """The best ``k`` documents of every item among the scores seen so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.rows: list[np.ndarray] = []  # item, score, no id, id
        self.held = 0

    def add(self, scores: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.floor)
        self.rows.append(np.stack([item, scores[doc, item], unnamed[doc], ids[doc]]))
        self.held += len(doc)
        if self.held > 4 * self.k * len(self.floor):
            self.trim()

    def trim(self) -> np.ndarray:
        rows = np.concatenate(self.rows, 1) if self.rows else np.empty((4, 0), np.int64)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], rows[0])
        rows = rows[:, np.arange(rows.shape[1]) - first < self.k]
        full = np.bincount(rows[0], minlength=len(self.floor)) == self.k
        last = np.searchsorted(rows[0], np.arange(len(self.floor)), "right") - 1
        self.floor[full] = rows[1, last[full]]  # equal scores may still win by their id
        self.rows, self.held = [rows], rows.shape[1]
        return rows


def _ranked(counted: DataFrame, weights: np.ndarray, starts: np.ndarray, places: np.ndarray, items: np.ndarray,
            n_docs: int, total: int, k: int) -> DataFrame:
    """q, doc_id, score: the best of each task.  Term t belongs to the items ``places[starts[t]:starts[t + 1]]``."""
    told = counted.sparkSession.sparkContext.broadcast((weights, starts, places, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, starts, places, items = told.value
        width, best = len(items), _Best(len(items), k)
        for batch in batches:
            ids, unnamed = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            m = 100 - 90 + (90 * batch.column(1).to_numpy() * n_docs) // total
            lists = batch.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            term, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            doc = np.repeat(np.arange(len(ids)), np.diff(ends))
            value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            n_places = starts[term + 1] - starts[term]
            work = np.concatenate(([0], np.cumsum(n_places)))[ends]  # item places before each document
            at = 0
            while at < len(ids):
                to = int(np.searchsorted(work, work[at] + CELLS, "right")) - 1
                to = max(at + 1, min(to, at + max(1, CELLS // width), len(ids)))
                a, b = ends[at], ends[to]
                # The items of each term, laid end to end.
                count = n_places[a:b]
                offset = np.repeat(starts[term[a:b]] - np.cumsum(count) + count, count) + np.arange(count.sum())
                cell = np.repeat((doc[a:b] - at) * width, count) + places[offset]
                scores = np.zeros((to - at) * width, np.int64)
                np.add.at(scores, cell, np.repeat(value[a:b], count))
                best.add(scores.reshape(to - at, width), unnamed[at:to], ids[at:to])
                at = to
        item, score, none, doc_id = best.trim()
        yield pa.RecordBatch.from_arrays(
            [pa.array(items[item]), pa.array(doc_id, mask=none.astype(bool)), pa.array(score)], ["q", "doc_id", "score"])

    return counted.mapInArrow(run, "q long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item, scores above 0."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    terms, held = _items(items, item_id, item_text)
    terms = spool(terms)
    discard(*held)
    found = []
    for b in [r.block for r in terms.select("block").distinct().orderBy("block").collect()]:
        pairs = terms.where(F.col("block") == b).select("q", "term").collect()  # at most LETTERS letters, or one item
        words = sorted({r.term for r in pairs})
        number = {w: i for i, w in enumerate(words)}
        numbers = np.array(sorted({r.q for r in pairs}), np.int64)
        term = np.array([number[r.term] for r in pairs], np.int64)
        place = np.searchsorted(numbers, np.array([r.q for r in pairs], np.int64))
        order = np.lexsort((place, term))
        starts = np.searchsorted(term[order], np.arange(len(words) + 1))
        counted = spool(_counted(rows, words))
        n_docs, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n_docs:
            df = np.zeros(len(words), np.int64)
            for r in counted.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
                df[r.t] = r.df
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
            found.append(spool(_ranked(counted, weights, starts, place[order], numbers, n_docs, total, k)))
        discard(counted)
    names = spool(terms.select("q", "item").distinct())
    discard(terms)
    if not found:
        return names.where("false").select(F.col("item").alias("item_id"), F.lit(0).alias("rank"),
                                           F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(names, "q").select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
