"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words, longer ones for long texts so that no bag has more
than 64, and every word lies in one.  Each passage is described by shares of kinds of characters,
of word shapes and of repeated word triples, and encoded by a learned layer.  Gated attention,
learned from document labels alone, weighs the encoded passages; the score is a logistic function
of their weighted sum.  Learned by Adam on minibatches of a bounded sample of labelled documents.

Defined results: null, empty and blank texts are one empty passage; without labelled rows of both
classes every score is the base rate (0.5 without any label); repeated rows are scored alike; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadquarry.llm.labelled import training_texts
from leadquarry.session import discard, spool

#: Labelled rows that the model is fitted on, at most.
TRAINING_ROWS = 16_000
PASSAGE, PASSAGES = 64, 64
CHUNK_BYTES = 4_000_000
HIDDEN, GATE = 16, 8
EPOCHS, BATCH, RATE = 30, 256, 0.01
SPACE, UPPER, LOWER, DIGIT, HIGH, BREAK = range(6)
SIGNS = 10  # ASCII punctuation marks fall into this many classes
FEATURES = 6 + SIGNS + 7


def _byte_classes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kinds[b] = HIGH
        elif c in "\n\r":
            kinds[b] = BREAK
        elif b <= 32 or b == 127:
            kinds[b] = SPACE
        elif c.isdigit():
            kinds[b] = DIGIT
        elif c.isalpha():
            kinds[b] = UPPER if c.isupper() else LOWER
        else:
            kinds[b] = 6 + signs.index(b) % SIGNS
    return kinds


KINDS = _byte_classes()
IS_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages per text)."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" " * 9, np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    text_end = np.cumsum(lengths + 1)
    space = IS_SPACE[data]
    begin = np.flatnonzero(~space[1:] & space[:-1]) + 1
    stop = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    doc = np.searchsorted(text_end, begin, side="left")
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    size = np.maximum(PASSAGE, -(-n_words // PASSAGES))
    count = np.maximum(1, -(-n_words // size))
    base = np.cumsum(count) - count
    out = np.zeros((int(count.sum()), FEATURES), np.float32)
    if not len(begin):
        return out, count
    of = base[doc] + (np.arange(len(begin)) - first[doc]) // size[doc]
    lead = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    which, at = of[lead], begin[lead]
    kinds = KINDS[data]
    upto = np.minimum(np.append(at[1:], len(data)), text_end[doc[lead]])
    total, spans = (upto - at).astype(np.float32), np.stack([at, upto], 1).ravel()
    for k in range(6 + SIGNS):
        out[which, k] = np.add.reduceat(kinds == k, spans, dtype=np.int64)[::2] / total
    words = np.diff(np.append(lead, len(begin))).astype(np.float32)
    again = np.concatenate(([False], (data[1:] == data[:-1]) & (kinds[1:] >= 6)))
    out[which, 16] = np.add.reduceat(again, spans, dtype=np.int64)[::2] / total
    out[which, 17] = np.log1p(words) / 5
    out[which, 18] = np.add.reduceat(stop - begin, lead) / words / 10
    out[which, 19] = np.add.reduceat(kinds[begin] == UPPER, lead, dtype=np.int64) / words
    out[which, 20] = np.add.reduceat(kinds[stop - 1] >= 6, lead, dtype=np.int64) / words
    head = np.zeros(len(begin), np.uint64)  # a word's first eight bytes
    for j in range(8):
        inside = begin + j < stop
        head = head * np.uint64(257) + np.where(inside, data[np.minimum(begin + j, len(data) - 1)], 0).astype(np.uint64)
    salt = np.uint64(0x9E3779B97F4A7C15)
    out[which, 21] = np.add.reduceat(_repeated((head + of.astype(np.uint64)) * salt ^ (head >> np.uint64(29))), lead, dtype=np.int64) / words
    triple = head * salt
    triple[:-1] += head[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    triple[:-2] += head[2:] * np.uint64(0x165667B19E3779F9)
    out[which, 22] = np.add.reduceat(_repeated(triple + doc.astype(np.uint64) * np.uint64(0x27D4EB2F165667C5)), lead, dtype=np.int64) / words
    return out, count


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Marks all but the first row of each key."""
    marks = np.ones(len(keys), bool)
    marks[np.unique(keys, return_index=True)[1]] = False
    return marks


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of a few megabytes."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return _forward((x - self.mean) / self.spread, count, self.weights)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(x: np.ndarray, count: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    first, doc = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
    h = np.tanh(x @ w["encode"] + w["encode0"])
    t, s = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
    a = (t * s) @ w["attend"]
    a = np.exp(a - np.maximum.reduceat(a, first)[doc])
    a /= np.add.reduceat(a, first)[doc]
    z = np.add.reduceat(a[:, None] * h, first)
    return {"first": first, "doc": doc, "h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["out"] + w["out0"])}


def _gradients(x: np.ndarray, count: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    f = _forward(x, count, w)
    h, t, s, a, doc = f["h"], f["t"], f["s"], f["a"], f["doc"]
    error = (f["p"] - y) / len(y)
    to_bag = (error[:, None] * w["out"])[doc]
    share = (to_bag * h).sum(1)
    to_a = a * (share - np.add.reduceat(a * share, f["first"])[doc])
    both = to_a[:, None] * w["attend"]
    to_t, to_s = both * s * (1 - t * t), both * t * s * (1 - s)
    to_h = (a[:, None] * to_bag + to_t @ w["tanh"].T + to_s @ w["gate"].T) * (1 - h * h)
    return {"encode": x.T @ to_h, "encode0": to_h.sum(0), "tanh": h.T @ to_t, "gate": h.T @ to_s,
            "attend": (t * s).T @ to_a, "out": f["z"].T @ error, "out0": error.sum(keepdims=True)}


def fit(x: np.ndarray, count: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / spread).astype(np.float64)
    shapes = {"encode": (FEATURES, HIDDEN), "tanh": (HIDDEN, GATE), "gate": (HIDDEN, GATE), "attend": (GATE,), "out": (HIDDEN,)}
    w = {k: rng.normal(0, 1 / np.sqrt(v[0]), v) for k, v in shapes.items()}
    w |= {"encode0": np.zeros(HIDDEN), "out0": np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])}
    m, v, steps = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    first = np.cumsum(count) - count
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            docs = order[at:at + BATCH]
            n = count[docs]
            rows = np.repeat(first[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            steps += 1
            for k, g in _gradients(x[rows], n, y[docs], w).items():
                g = g + 1e-4 * w[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                w[k] -= rate * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.999**steps)) + 1e-8)
    return Model(mean, spread, w)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, y, bytes of the passage features)."""
    for batch in batches:
        made = []
        for part in _chunks([(t.as_py() or "").encode() for t in batch.column(1)]):
            x, count = passages(part)
            made += [p.tobytes() for p in np.split(x, np.cumsum(count)[:-1])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], ["doc_id", "y", "x"])


def learn(docs: DataFrame, labels: DataFrame, trained: Column, label: str = "quality",
          doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model fitted on the labelled rows that ``trained`` admits."""
    rows = training_texts(docs, labels, label, trained, TRAINING_ROWS, doc_id, text)
    bags = spool(rows.select("doc_id", "text", "y").mapInArrow(_bags, "doc_id long, y int, x binary"))
    # At most TRAINING_ROWS bags of at most PASSAGES passages.
    found = bags.orderBy("doc_id", "x").toArrow()
    discard(bags)
    y = found["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        w = {"encode": np.zeros((FEATURES, HIDDEN)), "encode0": np.zeros(HIDDEN), "tanh": np.zeros((HIDDEN, GATE)),
             "gate": np.zeros((HIDDEN, GATE)), "attend": np.zeros(GATE), "out": np.zeros(HIDDEN),
             "out0": np.array([3.0 * (2 * y[0] - 1) if len(y) else 0.0])}
        return Model(np.zeros(FEATURES), np.ones(FEATURES), w)
    x = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in found["x"].to_pylist()]
    return fit(np.concatenate(x), np.array([len(p) for p in x]), y)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_passages): one row per row of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts = [np.empty(0)], [np.empty(0, np.int64)]
            for part in _chunks([(t.as_py() or "").encode() for t in batch.column(1)]):
                x, count = passages(part)
                scores.append(model.score(x, count))
                counts.append(count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores)), pa.array(np.concatenate(counts))],
                                             ["doc_id", "score", "n_passages"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_passages long")
