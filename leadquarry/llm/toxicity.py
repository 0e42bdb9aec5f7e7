"""Toxicity from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, accents and look-alike letters of other scripts become plain
Latin letters, digits and signs inside words become the letters they stand in for.  The lexicon is
learned from labelled documents: whole words, and word beginnings of several lengths so that unseen
endings are caught, each with the lower confidence bound of its log odds as weight.  Words and
two-word phrases around a match that clean documents use more than toxic ones are exceptions; they
take the match away.  A document's evidence is the summed weight of its matches, also per hundred
words, and a logistic curve fitted on the training rows turns it into a score.

Defined results: null and empty texts have no evidence and get the score of a text without any;
without labelled rows of both classes the lexicon is empty and every score is the base rate (0.5
without any label); repeated rows are scored alike; other columns of the input are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadquarry.llm.labelled import training_texts
from leadquarry.session import discard, spool

#: Labelled rows that the model is fitted on, at most.
TRAINING_ROWS = 40_000
#: Lexicon entries and exceptions kept, by weight times support.
ENTRIES = 20_000
SHORTEST, LONGEST = 4, 8  # lengths of word beginnings
SUPPORT = 5  # documents that hold an entry, at least
LEAST_WEIGHT = 1.5

# Letters of other scripts that look like Latin ones, and digits or signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухкіјѕԁһԛԝвнмтг", "aeopcyxkijsdhqwbhmtr")) | dict(zip("αεορτυνικχηω", "aeoptuvikxnw")) | dict(
    zip("ßøđłı", "sodli"))
STAND_INS = dict(zip("0134578@$!|", "oieastbasil"))
TOKEN = re.compile(r"[@$]?[^\W_]+(?:[@$!|]+[^\W_]+)*")


def _plain() -> dict[int, str]:
    """Accented Latin letters to their bases, and the look-alikes."""
    bases = {}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha():
            bases[code] = base.lower()
    return bases | {ord(k): v for k, v in LOOKALIKES.items()}


PLAIN = _plain()
LETTERS = str.maketrans(STAND_INS)


def folded(text: str | None) -> list[str]:
    """The folded words of a text; numbers stay as they are."""
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(PLAIN)
    found = TOKEN.findall(text)
    return [w if w.isalpha() or w.isdigit() else w.translate(LETTERS) for w in found]


def _bound(toxic, clean, all_toxic: int, all_clean: int, sign: int):
    """Log odds ratio of holding an entry, moved towards zero by 1.64 standard errors."""
    odds = F.log((toxic + 0.5) / (all_toxic + 1.0)) - F.log((clean + 0.5) / (all_clean + 1.0))
    return odds - sign * 1.64 * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


@dataclass
class Lexicon:
    weights: dict[str, float]  # " word " or " beginning"
    exceptions: set[str]  # " word " or " word word "
    curve: np.ndarray  # logistic coefficients of evidence(), constant last

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for entry in self.exceptions:
            a.add_word(entry, (len(entry), None))
        for entry, w in self.weights.items():
            if entry not in self.exceptions:
                a.add_word(entry, (len(entry), w))
        if len(a):
            a.make_automaton()
        return a


def matches(automaton: ahocorasick.Automaton, words: list[str]) -> list[tuple[int, float]]:
    """(position of the word's leading space, weight) of each word that an entry matches and no exception covers."""
    if not len(automaton) or not words:
        return []
    line, best, covered = f" {' '.join(words)} ", {}, []
    for end, (size, weight) in automaton.iter(line):
        start = end - size + 1
        if weight is None:
            covered.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    return [(s, w) for s, w in best.items() if not any(a <= s < b for a, b in covered)]


def evidence(weights: list[float], n_words: int) -> list[float]:
    total = sum(weights)
    return [np.log1p(total), max(weights, default=0.0), 100.0 * total / (n_words + 100.0), min(len(weights), 3)]


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(x.shape[1]), np.diag([0.1] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, trained: Column, label: str = "toxic",
          doc_id: str = "doc_id", text: str = "text") -> Lexicon:
    """Lexicon, exceptions and curve from the labelled rows that ``trained`` admits."""
    rows = spool(training_texts(docs, labels, label, trained, TRAINING_ROWS, doc_id, text))
    count = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    all_clean, all_toxic = count.get(0, 0), count.get(1, 0)
    if not all_clean or not all_toxic:
        rate = min(max(all_toxic / max(1, all_toxic + all_clean), 1e-3), 1 - 1e-3) if count else 0.5
        discard(rows)
        return Lexicon({}, set(), np.array([0.0, 0.0, 0.0, 0.0, np.log(rate / (1 - rate))]))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(batch.column(1), batch.column(2).to_pylist()):
                words = set(folded(t.as_py()))
                seen[y].update(f" {w} " for w in words)
                seen[y].update({f" {w[:n]}" for w in words for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1)})
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *[pa.array([seen[y][k] for k in keys], pa.int64()) for y in (1, 0)]],
                ["unit", "toxic", "clean"])

    def kept(stats: DataFrame) -> tuple[dict[str, float], set[str]]:
        t, c = F.col("toxic"), F.col("clean")
        stats = stats.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(t + c >= SUPPORT)
        stats = stats.select("unit", "toxic", "clean", _bound(t, c, all_toxic, all_clean, 1).alias("low"),
                             _bound(t, c, all_toxic, all_clean, -1).alias("high"))
        strong = stats.where(F.col("low") >= LEAST_WEIGHT).orderBy(F.desc(F.col("low") * t), "unit").limit(ENTRIES).collect()
        return {r.unit: r.low for r in strong}, stats

    counted = spool(rows.mapInArrow(units, "unit string, toxic long, clean long"))
    weights, stats = kept(counted)
    # Whole words that begin like an entry but are at home in clean documents.
    stems = [w for w in weights if not w.endswith(" ")]
    begins = F.lit(False)
    sizes = sorted({len(s) for s in stems})
    for n in sizes:
        begins = begins | F.substring("unit", 1, n).isin([s for s in stems if len(s) == n])
    harmless = stats.where(F.col("unit").endswith(" ") & begins & (F.col("high") < 0)).orderBy(F.desc("clean"), "unit").limit(ENTRIES)
    exceptions = {r.unit for r in harmless.select("unit").collect()}
    draft = Lexicon(weights, exceptions, np.zeros(5))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = draft.automaton()
        for batch in batches:
            keys, toxic = [], []
            for t, y in zip(batch.column(1), batch.column(2).to_pylist()):
                words, around = folded(t.as_py()), set()
                starts = {s for s, _ in matches(automaton, words)}
                at = 0
                for i, w in enumerate(words):
                    if at in starts:
                        around |= {f" {words[i - 1]} {w} "} if i else set()
                        around |= {f" {w} {words[i + 1]} "} if i + 1 < len(words) else set()
                    at += len(w) + 1
                keys += around
                toxic += [y] * len(around)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(toxic, pa.int64()),
                                              pa.array([1 - y for y in toxic], pa.int64())], ["unit", "toxic", "clean"])

    _, spoken = kept(rows.mapInArrow(phrases, "unit string, toxic long, clean long"))
    found = spoken.where(F.col("high") < 0).orderBy(F.desc("clean"), "unit").limit(ENTRIES).select("unit").collect()
    draft.exceptions |= {r.unit for r in found}

    # One row of four numbers per training row: bounded by TRAINING_ROWS.
    facts = rows.select("y", _evidence_of(draft)("text").alias("e")).select("y", "e.*").toPandas()
    draft.curve = _fit_curve(facts[["a", "b", "c", "d"]].to_numpy(), facts.y.to_numpy(float))
    discard(rows, counted)
    return draft


def _evidence_of(lexicon: Lexicon):
    @F.pandas_udf("a double, b double, c double, d double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for texts in batches:
            made = []
            for t in texts:
                words = folded(t)
                made.append(evidence([w for _, w in matches(automaton, words)], len(words)))
            yield pd.DataFrame(np.array(made, float).reshape(-1, 4), columns=["a", "b", "c", "d"])

    return run


def with_score(docs: DataFrame, lexicon: Lexicon, name: str = "score", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its score (0 to 1) in a further column."""
    *slopes, constant = [float(b) for b in lexicon.curve]
    e = "_evidence"
    z = F.lit(constant)
    for fact, b in zip("abcd", slopes):
        z = z + F.col(f"{e}.{fact}") * b
    return docs.withColumn(e, _evidence_of(lexicon)(docs[text])).withColumn(name, 1 / (1 + F.exp(-z))).drop(e)
