"""Best-two fuzzy name join as Spark joins: equal to scoring every pair, with few pairs scored.

The result holds the second-best score of every query however low, so no blocking key is complete.
Instead every query gets a *bar*, the second-best score among the names that hold its rarest words, and
names and queries are dealt into blocks of which every two meet in one task.  There a pair is bounded first:

* Two sorted word texts of lengths a and b cannot score above ``200 * o / (a + b)``, where o adds up
  the smaller counts of each letter class, read off bit marks.
* With ``token_set_ratio`` the words that a pair shares are found by an index of the block's words; they
  leave both texts before the bound is taken, and what they score alone is added exactly.
* A word set inside the other scores 100 and is found by the rarest word, before any block.

Pairs are scored from the highest bound down, until the bound falls below the bar or below the second-best
score found on the way.  A block hands on two names per query at most, so what is stored grows with
queries and blocks, however low the bar and however many names tie.

Names with equal word sets score alike and are one row with their two lowest ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadquarry.functions.similarity import indel_ratio, set_ratio
from leadquarry.session import discard, settings, spool

#: Letter classes of the pair bound; folding code points keeps the bound true.
CLASSES = 32
#: Names that set the bar: so many of each of so many of the rarest words of a query.
SAMPLE_NAMES, SAMPLE_WORDS = 16, 3
#: Rows of a block, and characters, padding included, of the names that are laid side by side in it.
NAMES_PER_BLOCK, QUERIES_PER_BLOCK, BAND_CELLS = 1 << 16, 1 << 12, 1 << 22
#: Pairs of a query scored at a time: few while the bar may rise, then more.
FIRST_CHUNK, CHUNK = 64, 2048
#: Bounds and scores are worked out along different ways.
SLACK = 1e-6
#: Two rows of a score that no pair has.
NO_BAR = -1.0


def distinct_names(businesses: DataFrame, norm: str = "norm") -> DataFrame:
    """One row per normalised name with its two lowest ids: all a best-two join can need.

    The row-number filter becomes a group limit below the shuffle, so a name shared by a third of
    the rows sends two rows per map task.
    """
    rows = businesses.where(F.col(norm) != "").select(F.col(norm).alias("norm"), "biz_id")
    place = F.row_number().over(Window.partitionBy("norm").orderBy("biz_id"))
    first_two = rows.withColumn("place", place).where(F.col("place") <= 2)
    return first_two.groupBy("norm").agg(
        F.min("biz_id").alias("id1"), F.min(F.when(F.col("place") == 2, F.col("biz_id"))).alias("id2"))


def _words(as_set: bool) -> Column:
    words = F.split("norm", " ")
    return F.array_sort(F.array_distinct(words) if as_set else words)


def _described(df: DataFrame, as_set: bool, side: str) -> DataFrame:
    """``df`` with <side>words, <side>text and its length <side>l."""
    out = df.withColumn(f"{side}words", _words(as_set)).withColumn(f"{side}text", F.array_join(f"{side}words", " "))
    return out.withColumn(f"{side}l", F.length(f"{side}text"))


def contained_matches(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (q, n) of word sets that contain one another.

    Each set is keyed by its rarest word only: a contained set must hand its rarest word to the other
    side.  Sets that consist of frequent words alone are few once sets are distinct.
    """
    n_words = names.select("n", "nwords", F.explode("nwords").alias("word"))
    q_words = queries.select("q", "qwords", F.explode("qwords").alias("word"))
    wanted = q_words.select("word").distinct()
    freq = spool(n_words.join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("df")))

    def keyed(parts: DataFrame, key: str, words: str) -> DataFrame:
        # sets with a word unknown to the other side cannot be contained in it
        rare = parts.join(freq, "word").groupBy(key).agg(
            F.min(F.struct("df", "word")).alias("r"), F.count("*").alias("known"), F.first(words).alias(words))
        return rare.where(F.col("known") == F.size(words)).select(key, words, F.col("r.word").alias("word"))

    inside = keyed(n_words, "n", "nwords").join(q_words, "word").where(F.size(F.array_except("nwords", "qwords")) == 0)
    # equal sets were found above; leaving them out keeps pairs unique without a distinct
    around = n_words.join(keyed(q_words, "q", "qwords"), "word").where(
        (F.size("nwords") > F.size("qwords")) & (F.size(F.array_except("qwords", "nwords")) == 0))
    return inside.select("q", "n").unionByName(around.select("q", "n"))


def _best_two(rows: DataFrame) -> DataFrame:
    """Rank 1 and 2 per query; the filter on the row number prunes before the shuffle."""
    w = Window.partitionBy("norm").orderBy(F.desc("score"), F.asc("biz_id"))
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 2")


def _scored(pairs: DataFrame, queries: DataFrame, names: DataFrame, as_set: bool) -> DataFrame:
    """q, score and ids of distinct pairs (q, n)."""
    both = pairs.join(queries.select("q", "qwords", "qtext"), "q").join(names.select("n", "nwords", "ntext", "ids"), "n")
    score = set_ratio(F.col("qwords"), F.col("nwords")) if as_set else indel_ratio("qtext", "ntext")
    return both.select("q", score.alias("score"), "ids")


def _rows(scored: DataFrame) -> DataFrame:
    return scored.select("q", "score", F.explode("ids").alias("i")).select("q", "score", "i.biz_id", "i.match_norm")


def _word_lists(names: DataFrame) -> DataFrame:
    """word, n, nl: one row per word of a name."""
    return names.select(F.explode("nwords").alias("word"), "n", "nl")


def _rare_words(queries: DataFrame, names: DataFrame) -> DataFrame:
    """A few names (q, n) that hold the rarest words of a query: they set a first bar and decide nothing else."""
    some = F.row_number().over(Window.partitionBy("word").orderBy("nl", "n"))
    lists = _word_lists(names).withColumn("nth", some).where(F.col("nth") <= SAMPLE_NAMES)
    df = _word_lists(names).groupBy("word").agg(F.count("*").alias("df"))
    rare = queries.select("q", F.explode("qwords").alias("word")).join(df, "word").withColumn(
        "place", F.row_number().over(Window.partitionBy("q").orderBy("df", "word"))).where(F.col("place") <= SAMPLE_WORDS)
    return rare.select("q", "word").join(lists, "word").select("q", "n").distinct()


def _score(distance: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 100.0 - 100.0 * distance / np.maximum(total, 1), 100.0)


def _marks(chars: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Counts of the letters of each row (zeros are none) as marks: as many low bits of a class's eight as the count,
    and what is beyond eight."""
    out, beyond = [np.zeros(len(chars), np.uint64) for _ in range(CLASSES // 8)], np.zeros(len(chars), np.int64)
    classes = np.where(chars > 0, chars % CLASSES, CLASSES).astype(np.uint8)
    for k in range(CLASSES):
        counts = np.count_nonzero(classes == k, axis=1)
        beyond += np.maximum(counts - 8, 0)
        bits = (np.uint64(1) << np.minimum(counts, 8).astype(np.uint64)) - np.uint64(1)
        out[k // 8] |= bits << np.uint64(8 * (k % 8))
    return out, beyond


def _chars(texts: list[str]) -> np.ndarray:
    """Code points side by side, zeros behind the shorter texts."""
    out = np.zeros((len(texts), max(map(len, texts))), np.uint32)
    for i, t in enumerate(texts):
        out[i, :len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return out


class _Band:
    """Names of like length side by side: characters, marks, lengths, and where their words stand.

    A text is taken with a blank behind each word, so words can be left out without moving the others;
    the last blanks of two texts always match."""

    def __init__(self, names: pd.DataFrame, as_set: bool):
        self.n, self.first = names["n"].to_numpy(), names["first"].to_numpy()
        self.l = names["nl"].to_numpy(np.int64)
        chars = _chars([t + " " for t in names["ntext"]])
        self.marks, self.o = _marks(chars)
        alphabet = np.unique(chars)
        self.alphabet = {int(c): i + 1 for i, c in enumerate(alphabet[alphabet > 0])}
        self.codes = (np.searchsorted(alphabet, chars) + (alphabet[0] > 0)).astype(np.min_scalar_type(len(alphabet)))
        self.by_length: dict[int, tuple] = {}
        places: dict[str, list] = {}
        for i, words in enumerate(names["nwords"] if as_set else ()):
            at = 0
            for word in words:
                places.setdefault(word, []).append((i, at))
                at += len(word) + 1
        self.places = {word: np.array(p).T for word, p in places.items()}

    def lcs(self, rows: np.ndarray, table: np.ndarray, keep: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """Longest common subsequences of ``rows`` and the query: one bit per character of the query.

        ``keep`` has the bits of the query's words that a row does not share, ``gone`` the row's characters that are left out."""
        codes = np.where(gone, 0, self.codes[rows]) if gone is not None else self.codes[rows]
        codes = np.ascontiguousarray(codes[:, :int(self.l[rows].max()) + 1].T)
        state = np.full(keep.shape, np.uint64(0xFFFFFFFFFFFFFFFF))
        for code in codes:
            carry = np.zeros(len(rows), np.uint64)
            for w in range(len(state)):
                s = state[w]
                hit = s & table[w][code] & keep[w]
                total = s + hit
                over = total < s
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
                state[w] = total | (s - hit)
        return np.bitwise_count(~state).sum(0, dtype=np.int64)

    def bounds(self, query, shared: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """What no name scores above: by the letters of both texts, or without the words that they share."""
        if query.ql not in self.by_length:
            self.by_length[query.ql] = np.minimum(self.l, query.ql) + 1, 200.0 / np.maximum(self.l + query.ql, 1)
        most, share = self.by_length[query.ql]
        overlap = np.minimum(self.o, query.beyond)
        for mine, its in zip(self.marks, query.marks):
            if its:
                overlap += np.bitwise_count(mine & its)
        np.minimum(overlap, most, out=overlap)  # last blanks included
        bound = (overlap - 1) * share
        if len(rows):
            ra, rb, sh, total, alone = self.parts(query, shared, rows)
            rest = np.clip(overlap[rows] - 1 - shared[rows], 0, np.minimum(ra, rb))
            bound[rows] = np.maximum(alone, _score(ra + rb - 2 * rest, total))
        return bound

    def parts(self, query, shared: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Lengths without the shared words and of those, without last blanks; their total; what the shared words score alone."""
        shared = shared[rows]
        ra, rb, sh = np.maximum(query.ql - shared, 0), np.maximum(self.l[rows] - shared, 0), np.maximum(shared - 1, 0)
        alone = np.where(sh > 0, np.maximum(_score(1 + ra, 2 * sh + 1 + ra), _score(1 + rb, 2 * sh + 1 + rb)), 0.0)
        alone[(sh > 0) & ((ra == 0) | (rb == 0))] = 100.0
        return ra, rb, sh, 2 * (sh + (sh > 0)) + ra + rb, alone

    def best(self, query, as_set: bool, known: list[tuple]) -> list[tuple]:
        """The best two of ``known`` and this band's names by (-score, lowest id, n), those below the bar left out."""
        shared, hits, at = np.zeros(len(self.n), np.int64), [], 0
        for word in query.qwords if as_set else ():
            if word in self.places:
                rows, starts = self.places[word]
                shared[rows] += len(word) + 1
                hits.append((at, len(word) + 1, rows, starts))
            at += len(word) + 1
        bar = max(query.bar, -known[1][0]) if len(known) == 2 else query.bar
        bound = self.bounds(query, shared, np.flatnonzero(shared) if hits else np.empty(0, np.int64))
        open_ = np.flatnonzero(bound >= bar - SLACK)
        if not len(open_):
            return known
        table = np.zeros((-(-(query.ql + 1) // 64), len(self.alphabet) + 1), np.uint64)
        for i, ch in enumerate(query.qtext + " "):
            if ord(ch) in self.alphabet:
                table[i >> 6, self.alphabet[ord(ch)]] |= np.uint64(1 << (i & 63))
        if len(open_) > FIRST_CHUNK:  # the highest bounds may raise the bar
            split = np.argpartition(-bound[open_], FIRST_CHUNK)
            known = self.scored(query, open_[split[:FIRST_CHUNK]], shared, hits, table, known)
            open_ = open_[split[FIRST_CHUNK:]]
        bar = max(bar, -known[1][0]) if len(known) == 2 else bar
        open_ = open_[bound[open_] >= bar - SLACK]
        open_ = open_[np.argsort(-bound[open_], kind="stable")]
        for done in range(0, len(open_), CHUNK):
            bar = max(bar, -known[1][0]) if len(known) == 2 else bar
            rows = open_[done:done + CHUNK]
            rows = rows[bound[rows] >= bar - SLACK]
            if not len(rows):
                break
            known = self.scored(query, rows, shared, hits, table, known)
        return [k for k in known if -k[0] >= query.bar - SLACK]

    def scored(self, query, rows: np.ndarray, shared: np.ndarray, hits: list, table: np.ndarray, known: list[tuple]) -> list[tuple]:
        """``known`` with ``rows`` scored as ``set_ratio`` and ``indel_ratio`` score them."""
        keep, gone = np.full((len(table), len(rows)), np.uint64(0xFFFFFFFFFFFFFFFF)), None
        if hits and shared[rows].any():
            gone, place = np.zeros((len(rows), self.codes.shape[1]), bool), np.full(len(self.n), -1)
            place[rows] = np.arange(len(rows))
            for start, length, held, starts in hits:
                here = place[held]
                mine, of = here[here >= 0], starts[here >= 0]
                gone[mine[:, None], of[:, None] + np.arange(length)] = True
                bits = ((1 << length) - 1) << start
                for w in range(len(table)):
                    keep[w, mine] &= ~np.uint64((bits >> (64 * w)) & 0xFFFFFFFFFFFFFFFF)
        ra, rb, _, total, alone = self.parts(query, shared, rows)
        # the last blanks match unless a side has no word left
        left = (shared[rows] <= query.ql) & (shared[rows] <= self.l[rows])
        score = np.maximum(alone, _score(ra + rb - 2 * (self.lcs(rows, table, keep, gone) - left), total))
        top = np.lexsort((self.first[rows], -score))[:2]
        return sorted([*known, *((-float(score[i]), int(self.first[rows[i]]), int(self.n[rows[i]])) for i in top)])[:2]


def _best_of_block(as_set: bool):
    """The best two names of a block per query of a block."""
    def run(queries: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        bands, found = [], []
        names = names.sort_values("nl", kind="stable").reset_index(drop=True)
        at = 0
        while at < len(names) and len(queries):
            # as many names as fit beside the longest of them
            cells = (names["nl"].to_numpy(np.int64)[at:] + 1) * np.arange(1, len(names) - at + 1)
            upto = at + max(1, int(np.searchsorted(cells, BAND_CELLS, side="right")))
            bands.append(_Band(names.iloc[at:upto], as_set))
            at = upto
        for at in range(0, len(queries) if bands else 0, FIRST_CHUNK):
            part = queries.iloc[at:at + FIRST_CHUNK]
            marks, beyond = _marks(_chars([t + " " for t in part["qtext"]]))
            for query in part.assign(marks=list(zip(*marks)), beyond=beyond).itertuples(index=False):
                known: list[tuple] = []
                for band in bands:
                    known = band.best(query, as_set, known)
                found += [(query.q, k[2]) for k in known]
        return pd.DataFrame(found, columns=["q", "n"], dtype=np.int64)
    return run


def _by_blocks(queries: DataFrame, names: DataFrame, as_set: bool) -> DataFrame:
    """Pairs (q, n): per block of names the best two of every query, if they reach its bar."""
    spark = queries.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nq, nn = queries.count(), names.count()
    nbs = max(1, -(-nn // NAMES_PER_BLOCK))
    qbs = max(1, -(-nq // QUERIES_PER_BLOCK), min(-(-nq // 64), -(-tasks // nbs)))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.pmod("q", F.lit(qbs)).cast("int").alias("qb"), all_of(nbs).alias("nb"),
                       "q", "ql", "bar", "qwords", "qtext")
    n = names.select(F.pmod("n", F.lit(nbs)).cast("int").alias("nb"), all_of(qbs).alias("qb"),
                     "n", "nl", "nwords", "ntext", F.col("ids")[0]["biz_id"].alias("first"))
    pairs = q.groupBy("qb", "nb").cogroup(n.groupBy("qb", "nb")).applyInPandas(_best_of_block(as_set), "q long, n long")
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):  # few bytes, much work
        return spool(pairs)


def _barred(queries: DataFrame, seen: DataFrame, least: float) -> DataFrame:
    """``queries`` with the bar that the scored rows (q, score, biz_id) set."""
    second = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "biz_id"))
    bars = seen.withColumn("place", second).where("place <= 2").groupBy("q").agg(
        F.when((F.count("*") == 2) & (F.min("score") > 1), F.min("score")).otherwise(NO_BAR).alias("bar"))
    return spool(queries.drop("bar").join(bars, "q", "left").withColumn(
        "bar", F.greatest(F.coalesce("bar", F.lit(NO_BAR)), F.lit(least))))


def candidates(queries: DataFrame, names: DataFrame, as_set: bool, score_floor: float = NO_BAR) -> DataFrame:
    """Distinct pairs (q, n) among which are the best two of every query; both sides as ``prepared`` makes them."""
    first = spool(_rows(_scored(_rare_words(queries, names), queries, names, as_set)))
    barred = _barred(queries, first, score_floor)
    out = _by_blocks(barred, names, as_set)
    discard(first, barred)
    return out


def prepared(queries: DataFrame, names: DataFrame, as_set: bool) -> tuple[DataFrame, DataFrame]:
    """Queries by number q, and names by word set n with their two lowest ids."""
    queries = spool(_described(queries.select("norm"), as_set, "q").withColumn("q", F.xxhash64("norm")))
    rows = names.withColumn("words", F.array_join(_words(as_set), " ")).select(
        "words", "norm", F.explode(F.filter(F.array("id1", "id2"), lambda i: i.isNotNull())).alias("biz_id"))
    place = F.row_number().over(Window.partitionBy("words").orderBy("biz_id"))
    first_two = rows.withColumn("place", place).where(F.col("place") <= 2)
    sets = first_two.groupBy(F.col("words").alias("norm")).agg(
        F.sort_array(F.collect_list(F.struct("biz_id", F.col("norm").alias("match_norm")))).alias("ids"))
    return queries, spool(_described(sets, as_set, "n").withColumn("n", F.xxhash64("norm")).drop("norm"))


def fuzzy_top2(queries: DataFrame, names: DataFrame, scorer: str = "token_set_ratio",
               score_floor: float = NO_BAR) -> DataFrame:
    """Best two business rows per query name: ``norm, place, score, biz_id, match_norm``.

    ``queries`` has one ``norm`` column of distinct non-empty names; ``names`` comes from
    :func:`distinct_names`.  ``score_floor`` lets callers that ignore low scores prune harder; the
    default keeps every result.
    """
    as_set = scorer == "token_set_ratio"
    queries, names = prepared(queries, names, as_set)
    open_, settled = queries, None
    if as_set:
        hits = contained_matches(queries, names).join(names.select("n", "ids"), "n").select("q", F.lit(100.0).alias("score"), "ids")
        settled = spool(_best_two(_rows(hits).withColumnRenamed("q", "norm")))
        open_ = spool(queries.join(settled.where("place = 2").select(F.col("norm").alias("q")), "q", "left_anti"))
    pairs = candidates(open_, names, as_set, score_floor)
    scored = spool(_rows(_scored(pairs, open_, names, as_set)).where(F.col("score") > score_floor))
    discard(pairs)
    best = _best_two(scored.withColumnRenamed("q", "norm"))
    if settled is not None:
        done = settled.where("place = 2").select("norm")
        best = best.unionByName(settled.join(done, "norm", "left_semi"))
    return best.withColumnRenamed("norm", "q").join(queries.select("q", "norm"), "q").select(
        "norm", "place", "score", "biz_id", "match_norm")
