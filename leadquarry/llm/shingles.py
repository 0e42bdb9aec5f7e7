"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of the ASCII-lower-cased text, repeats included."""
    found = (text or "").encode().lower().split()  # bytes split and lower by ASCII rules alone
    if not found:
        return np.empty(0, np.uint64)
    line, size = b" ".join(found), min(shingle, len(found))
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], seed) for s, e in
                        zip(starts[:len(found) - size + 1].tolist(), ends[size - 1:].tolist())), np.uint64)
