"""Scoring by a hashed maximum-entropy language model with a class-factored softmax.

The probability of a token is that of its class given the tokens before it, times that of the
token within its class.  Classes are few: the end of a text, the most frequent words, and the
other words by a hash of their endings.  Class weights are rows of a table indexed by hashed
features: the previous token, the token before that (a skip), and both together; a softmax over
the classes turns their sum into probabilities.  The table is trained by distributed gradient
updates: in each round every task starts from the table sent to it, takes AdaGrad steps over
batches of its own documents, and returns what it changed, which is averaged by the number of
tokens behind each change.  Within a class a token has its count plus one over the class's total,
open classes keep one share for unknown words, so the whole is a probability distribution.

Counts cover every training token: they are summed per batch, then by token.  A bounded number of
frequent tokens is sent to the scoring tasks; the counts of all others are joined by shuffle.

Defined results: null and empty texts are a single end token; with an empty training side every
token is unknown; rows with a null id are training rows and scored like any other; repeated rows
are scored alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadquarry.session import discard, spool

END = b""  # no word is empty
CLASSES = 32
WORD_CLASSES = 12  # the end, and the most frequent words: one token each
ROWS = 1 << 13  # table rows of each kind of feature
KINDS = 3
FREQUENT = 1 << 16
ROUNDS = 2
BATCH = 4096  # tokens per gradient step
RATE = 0.15
CACHED = 1 << 18  # token codes that a task remembers


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]  # ASCII rules alone


class Codes(dict):
    """token -> place among the frequent tokens (from 1), hash and class in one integer, made once per token."""

    def __init__(self, own: dict[bytes, int], frequent: list[bytes] = ()):  # type: ignore[assignment]
        super().__init__()
        self.known = {t: i + 1 << 32 | self.ending(t) for i, t in enumerate(frequent)}
        self.known |= {t: self.known.get(t, 0) >> 32 << 32 | c for t, c in own.items()}

    @staticmethod
    def ending(token: bytes) -> int:
        """The class of a token that is none by itself."""
        return WORD_CLASSES + crc32(token[-3:]) % (CLASSES - WORD_CLASSES)

    def __missing__(self, token: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        code = self.known.get(token)
        if code is None:
            code = WORD_CLASSES + crc32(token[-3:]) % (CLASSES - WORD_CLASSES)
        code = self[token] = code | (crc32(token) & 0x3FFFFFF) << 6
        return code


def features(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows (tokens x kinds) and classes; ``first`` marks the first token of each text."""
    h = codes >> 6 & 0x3FFFFFF
    one = np.concatenate(([0], h[:-1]))
    one[first] = 0
    two = np.concatenate(([0], one[:-1]))
    two[first] = 0
    both = (one * 0x9E3779B1 + two * 0x85EBCA6B + 1) & 0xFFFFFFFF
    rows = np.stack([one % ROWS, ROWS + (two * 31 + 7) % ROWS, 2 * ROWS + (both >> 7) % ROWS], 1)
    return rows.astype(np.uint16), codes & 63


def _exponentials(table: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the classes less their largest, and the exponentials of that."""
    z = table.take(rows[:, 0], axis=0)
    z += table.take(rows[:, 1], axis=0)
    z += table.take(rows[:, 2], axis=0)
    z -= z.max(1, keepdims=True)
    return z, np.exp(z)


def log_probability(table: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural logarithm of each class's softmax."""
    z, e = _exponentials(table, rows)
    return z[np.arange(len(z)), classes] - np.log(e @ np.ones(CLASSES, e.dtype))


def _coded(texts: pa.Array, codes: Codes) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The tokens of each text, all codes end to end, and where texts begin."""
    each = [tokens(t.as_py()) for t in texts]
    flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(each)), np.int64)
    return each, flat, np.cumsum([0] + [len(ws) for ws in each])[:-1]


@dataclass
class Model:
    own: dict[bytes, int]  # tokens that are a class by themselves
    table: np.ndarray
    log_size: np.ndarray  # per class: log10 of its total count and shares
    frequent: list[bytes]
    logs: np.ndarray  # log10(count + 1) of the frequent tokens


def count_tokens(rows: DataFrame) -> DataFrame:
    """(token binary, c) over all texts of the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column(0):
                seen.update(tokens(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])

    return rows.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _frequent(counts: DataFrame) -> dict[bytes, int]:
    """The tokens above a count that at most FREQUENT reach: a histogram over count sizes finds it."""
    grade = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(counts.groupBy(grade.alias("g")).count().collect(), key=lambda r: -r.g)  # under 512 rows
    least, total = None, 0
    for r in sizes:
        total += r["count"]
        if total > FREQUENT:
            break
        least = r.g
    if least is None:
        return {}
    return {bytes(r.token): r.c for r in counts.where(grade >= least).collect()}


def _updates(table: np.ndarray, own: dict[bytes, int]):
    """A task's AdaGrad steps over its texts; returns the changed rows, their changes and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, codes = table.copy(), Codes(own)
        squares, touched = np.full(w.shape, 1e-2, np.float32), np.zeros(len(w), np.int64)
        place = np.empty(ROWS, np.intp)
        for batch in batches:
            _, flat, first = _coded(batch.column(0), codes)
            if not len(flat):
                continue
            rows, y = features(flat, first)
            for at in range(0, len(flat), BATCH):
                r, target = rows[at:at + BATCH], y[at:at + BATCH]
                _, g = _exponentials(w, r)
                g /= (g @ np.ones(CLASSES, g.dtype))[:, None]
                g[np.arange(len(r)), target] -= 1
                by_class = np.ascontiguousarray(g.T, float)
                for k in range(KINDS):  # kinds have rows of their own, so each token counts once a kind
                    at_rows = r[:, k].astype(np.intp) - k * ROWS
                    n = np.bincount(at_rows, minlength=ROWS)
                    changed = np.flatnonzero(n)
                    place[changed] = np.arange(len(changed))
                    at_rows = place[at_rows]
                    step = np.empty((CLASSES, len(changed)), np.float32)
                    for c in range(CLASSES):
                        step[c] = np.bincount(at_rows, by_class[c], len(changed))
                    step = np.ascontiguousarray(step.T)
                    touched[k * ROWS:(k + 1) * ROWS] += n
                    changed += k * ROWS
                    grown = squares.take(changed, axis=0) + step * step
                    squares[changed] = grown
                    w[changed] -= RATE * step / np.sqrt(grown)
        rows = np.flatnonzero(touched)
        change = (w - table)[rows] * touched[rows, None]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(touched[rows]), *[pa.array(c.astype(float)) for c in change.T]],
                                         ["row", "n", *[f"d{i}" for i in range(CLASSES)]])

    return run


def train(rows: DataFrame, counts: DataFrame) -> Model:
    """``rows`` has the training column ``text``; ``counts`` its token counts."""
    known = _frequent(counts)
    named = sorted((t for t in known if t != END), key=lambda t: (-known[t], t))[:WORD_CLASSES - 1]
    own = {END: 0} | {t: i + 1 for i, t in enumerate(named)}

    def class_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(own)
        for batch in batches:
            which = np.fromiter((codes[t.as_py()] & 63 for t in batch.column(0)), np.int64)
            c = batch.column(1).to_numpy()
            total, kinds = np.bincount(which, c, CLASSES).astype(np.int64), np.bincount(which, minlength=CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total), pa.array(kinds)], ["class", "n", "v"])

    shares = np.ones(CLASSES)  # one share for an unknown word
    shares[:WORD_CLASSES] = 0
    shares[len(own):WORD_CLASSES] = 1  # classes without a word never occur
    for r in counts.mapInArrow(class_sizes, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        shares[r["class"]] += r.n + r.v
    shares[0] = max(shares[0], 1)
    table = np.zeros((KINDS * ROWS, CLASSES), np.float32)
    for i in range(ROUNDS):
        part = rows.where(F.pmod(F.xxhash64("text", F.lit("round")), F.lit(ROUNDS)) == i).select("text")
        schema = "row long, n long, " + ", ".join(f"d{j} double" for j in range(CLASSES))
        summed = spool(part.mapInArrow(_updates(table, own), schema).groupBy("row").agg(
            F.sum("n").alias("n"), *[F.sum(f"d{j}").alias(f"d{j}") for j in range(CLASSES)]))
        change = summed.toPandas()  # one row per table row at most
        discard(summed)
        table[change.row.to_numpy()] += (change.filter(regex="^d").to_numpy() / change.n.to_numpy()[:, None]).astype(np.float32)
    frequent = sorted(known)
    return Model(own, table, np.log10(shares), frequent, np.log10(np.array([known[t] for t in frequent], float) + 1))


def _score_rows(model: Model):
    """Per text one row with its sums over frequent tokens, and one row per other token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, logs = Codes(model.own, model.frequent), np.concatenate(([0.0], model.logs))
        for batch in batches:
            each, flat, first = _coded(batch.column(2), codes)
            if not len(each):
                continue
            r, y = features(flat, first)
            classes = np.empty(len(flat))
            for at in range(0, len(flat), BATCH):  # tokens of neighbouring texts in one array operation
                own = y[at:at + BATCH]
                classes[at:at + BATCH] = log_probability(model.table, r[at:at + BATCH], own) / np.log(10) - model.log_size[own]
            place = flat >> 32
            sums, known, some = (np.add.reduceat(x, first).tolist() for x in (classes, (place > 0).astype(np.int64), logs[place]))
            rare_at = np.flatnonzero(place == 0)
            cuts = np.searchsorted(rare_at, np.append(first, len(flat))).tolist()
            words = list(chain.from_iterable(each))
            rare_words = [words[i] for i in rare_at.tolist()]
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for j, (i, d) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                rare = Counter(rare_words[cuts[j]:cuts[j + 1]])
                for column, v in zip(out, ([i] * (len(rare) + 1), [d] + [None] * len(rare), [None, *rare], [len(each[j]), *rare.values()],
                                           [known[j]] + [0] * len(rare), [some[j]] + [0.0] * len(rare), [sums[j]] + [0.0] * len(rare))):
                    column.extend(v)
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             ["row_id", "doc_id", "token", "n", "known", "logs", "classes"])

    return run


def score(docs: DataFrame, trained: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; ``trained`` marks the training rows."""
    rows = docs.select(F.col(text).alias("text"), trained.alias("trained")).where("trained").select("text")
    counts = spool(count_tokens(rows))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = train(rows, counts)
    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "row_id long, doc_id long, token binary, n long, known long, logs double, classes double"
    parts = spool(numbered.mapInArrow(_score_rows(model), schema))
    rare = parts.where("token IS NOT NULL").select("row_id", "token", "n").join(counts, "token").groupBy("row_id").agg(
        F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    out = parts.where("token IS NULL").join(rare, "row_id", "left").select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n") * F.log10(F.lit(float(total + kinds + 1)))).alias("base_score"),
        (logs + F.col("classes")).alias("score"))
    out = spool(out)
    discard(counts, parts)
    return out
