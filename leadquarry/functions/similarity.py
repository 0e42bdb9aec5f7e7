"""String similarity on Arrow batches: Indel, token-sort and token-set ratios (0..100).

Only the longest-common-subsequence length has no Spark built-in; it runs bit-parallel over
whole batches of pairs in numpy.  Splitting, sorting and comparing words stays in the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


#: Characters, padding included, that one band of pairs may span.
BAND_CELLS = 4_000_000


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """LCS length of each pair, worked out in bands of pairs of like length.

    A band's arrays are as wide as its longest string, so one very long string costs its own
    length only and not that of every pair of the batch."""
    longest = np.fromiter((max(len(a), len(b)) for a, b in zip(left, right)), dtype=np.int64, count=len(left))
    order, out, at = np.argsort(longest, kind="stable"), np.zeros(len(left), dtype=np.int64), 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and longest[order[upto]] * (upto + 1 - at) <= BAND_CELLS:
            upto += 1
        band = order[at:upto]
        out[band] = _band_lcs([left[i] for i in band], [right[i] for i in band])
        at = upto
    return out


def _band_lcs(left: list[str], right: list[str]) -> np.ndarray:
    """One bit per character of ``left``, one step per character of ``right``; all pairs advance together."""
    n = len(left)
    uniq, inverse = np.unique(np.asarray(left, dtype=object), return_inverse=True)
    alphabet: dict[str, int] = {}
    for s in uniq:
        for ch in s:
            alphabet.setdefault(ch, len(alphabet) + 1)
    words = max(1, -(-max(len(s) for s in uniq) // 64))
    match = np.zeros((len(uniq), len(alphabet) + 1, words), dtype=np.uint64)
    for i, s in enumerate(uniq):
        for pos, ch in enumerate(s):
            match[i, alphabet[ch], pos >> 6] |= np.uint64(1 << (pos & 63))
    # longest right strings first, so finished pairs drop off the tail
    r_len = np.fromiter((len(s) for s in right), dtype=np.int64, count=n)
    order = np.argsort(-r_len, kind="stable")
    width = int(r_len[order[0]])
    codes = np.zeros((n, width), dtype=np.int32)
    for row, i in enumerate(order):
        codes[row, : r_len[i]] = [alphabet.get(ch, 0) for ch in right[i]]
    li = inverse[order]
    alive = np.searchsorted(-r_len[order], -np.arange(width), side="left")
    state = np.full((n, words), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(width):
        m = int(alive[j])
        s = state[:m]
        hit = s & match[li[:m], codes[:m, j]]
        total = np.empty_like(s)
        carry = np.zeros(m, dtype=np.uint64)
        for w in range(words):
            t = s[:, w] + hit[:, w]
            over = t < s[:, w]
            t2 = t + carry
            carry = (over | (t2 < t)).astype(np.uint64)
            total[:, w] = t2
        state[:m] = total | (s - hit)
    out = np.empty(n, dtype=np.int64)
    out[order] = np.bitwise_count(~state).sum(axis=1)
    return out


@F.pandas_udf(LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two strings; null if either is."""
    null = a.isna() | b.isna()
    return pd.Series(lcs_lengths(a.fillna("").tolist(), b.fillna("").tolist()), dtype="Int64").mask(null)


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _score(distance: Column, total: Column) -> Column:
    """100 minus the normalised distance; two empty strings are equal."""
    return F.when(total > 0, 100.0 - 100.0 * distance / total).otherwise(100.0)


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """Normalised Indel similarity of two strings; null if either is."""
    a, b = _column(a), _column(b)
    total = F.length(a) + F.length(b)
    return F.when(a.isNotNull() & b.isNotNull(), _score(total - 2 * lcs_length(a, b), total))


def words(text: Column) -> Column:
    """The words of a text between white space."""
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    """Indel similarity of the alphabetically sorted words; null if either string is."""
    return indel_ratio(*[F.array_join(F.array_sort(words(_column(x))), " ") for x in (a, b)])


def token_set_ratio(a: Column | str, b: Column | str) -> Column:
    """``set_ratio`` of the words of two strings; null if either is."""
    return set_ratio(words(_column(a)), words(_column(b)))


def set_ratio(a: Column, b: Column) -> Column:
    """Best of: rest against rest, shared words against each full side; 100 for containment, 0 beside no words."""
    joined = lambda w: F.array_join(F.array_sort(w), " ")
    rest_a, rest_b = joined(F.array_except(a, b)), joined(F.array_except(b, a))
    la, lb, shared = F.length(rest_a), F.length(rest_b), F.length(joined(F.array_intersect(a, b)))
    gap = F.when(shared > 0, 1).otherwise(0)
    rest = _score(la + lb - 2 * lcs_length(rest_a, rest_b), 2 * (shared + gap) + la + lb)
    alone = [_score(gap + x, shared + shared + gap + x) for x in (la, lb)]
    score = F.when(shared == 0, rest).when((la == 0) | (lb == 0), 100.0).otherwise(F.greatest(rest, *alone))
    return F.when(a.isNotNull() & b.isNotNull(), F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(score))
