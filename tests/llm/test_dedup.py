"""Components, SimHash near-duplicates and repeated passages against brute force."""

import random

import numpy as np
import pytest
import xxhash

from leadquarry.llm import near_dedup, set_links, substring_dedup
from leadquarry.llm.graph import components


def closed(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(150)],
    [(i, (i * 7919 + 13) % 151) for i in range(90)],
    [(0, i) for i in range(1, 100)] + [(120, 130), (130, 125)],
])
def test_components(spark, links):
    names = [f"{(i * 37) % 151:03d}" for i in range(151)]
    got = {r.node: r.root for r in components(spark.createDataFrame([(names[a], names[b]) for a, b in links], "a string, b string")).collect()}
    parent = closed(151, links)
    groups = {}
    for i, p in enumerate(parent):
        groups.setdefault(p, []).append(names[i])
    want = {n: min(g) for g in groups.values() if len(g) > 1 for n in g}
    assert {k: v for k, v in got.items() if k in want} == want


def plain_print(text, shingle, seed):
    words = (text or "").encode().lower().split()
    made = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def wanted(rows, how):
    prints = [tuple(plain_print(t, how.shingle, how.seed + i) for i in range(how.words)) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j])) <= how.radius]
    group = closed(len(rows), links)
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted([(d, "".join(f"{p:016x}" for p in prints[i]), least.get(group[i])) for i, (d, _) in enumerate(rows)], key=repr)


def near_copies(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = rng.choice(rows)[1].split(" ")
            base[rng.randrange(len(base))] = rng.choice(words)
        else:
            base = [rng.choice(words) for _ in range(rng.choice([3, 40, 200]))]
        rows.append((i * 3, " ".join(base)))
    return rows


@pytest.mark.parametrize("how", [near_dedup.SimHash(), near_dedup.SimHash(shingle=5, words=2, radius=15, segment_bits=16)])
def test_near_duplicates_equal_all_pairs(spark, make, how):
    rows = near_copies(150)
    got = near_dedup.near_duplicates(make([(i, t, "a") for i, t in rows]), how).collect()
    assert sorted([tuple(r) for r in got], key=repr) == wanted(rows, how)


def test_hot_buckets_are_split(spark):
    """A bucket limit of two sends nearly everything through the deeper variants."""
    how, rng = near_dedup.SimHash(), random.Random(5)
    prints = {0, 1, 3, 7, 1 << 63}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            x ^= sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))})
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    links = near_dedup.class_links(spark.createDataFrame([(s,) for s in signed], "f0 long"), how, bucket=2).collect()
    at = {s: i for i, s in enumerate(signed)}
    assert all((prints[at[r.a0]] ^ prints[at[r.b0]]).bit_count() <= 3 for r in links)
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert closed(len(prints), [(at[r.a0], at[r.b0]) for r in links]) == closed(len(prints), near)


def test_near_duplicates_odd_rows(spark, odd, odd_rows, empty):
    how = near_dedup.SimHash()
    got = sorted([tuple(r) for r in near_dedup.near_duplicates(odd).collect()], key=repr)
    assert got == wanted([(d, t) for d, t, _ in odd_rows], how)
    assert near_dedup.near_duplicates(empty).collect() == []


def test_deduplicate_keeps_one_row_each(spark, odd, empty):
    kept = near_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 3, 6, 7, 8, 9]  # 2 and a null id copy 1; 4, 5 and a null id are empty like 3
    assert near_dedup.deduplicate(empty).collect() == []


def plain_repeats(rows, window):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, ws in texts:
        if d is not None:
            for i in range(len(ws) - window + 1):
                k = tuple(ws[i:i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, ws in texts:
        gone = set()
        if d is not None:
            for i in range(len(ws) - window + 1):
                if first[tuple(ws[i:i + window])] < d:
                    gone |= set(range(i, i + window))
        out.append((d, len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [7, 13, 20])
def test_repeats_equal_brute_force(spark, make, window):
    rng = random.Random(window)
    parts = [[rng.choice("abc") + str(rng.randrange(9)) for _ in range(rng.randrange(5, 40))] for _ in range(30)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(1, 6)) for w in rng.choice(parts))) for i in range(80)]
    got = substring_dedup.remove_repeats(make([(i, t, "a") for i, t in rows]), window).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain_repeats(rows, window)


def test_repeats_odd_rows(spark, odd, odd_rows, empty):
    got = sorted([tuple(r) for r in substring_dedup.remove_repeats(odd).collect()], key=repr)
    assert got == plain_repeats([(d, t) for d, t, _ in odd_rows], 13)
    assert substring_dedup.remove_repeats(empty).collect() == []


def test_difference_cover():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


def shingles_of(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def by_jaccard(rows, similarity=0.8):
    sets = [shingles_of(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    return {d: rows[g][0] for (d, _), g in zip(rows, closed(len(rows), links))}


@pytest.mark.parametrize("pivots", [256, 2])
def test_near_texts_equal_exact_jaccard(spark, make, monkeypatch, pivots):
    """Inner words changed so that similarities lie on both sides of 0.8; pivots=2 takes several rounds a bucket."""
    monkeypatch.setattr(set_links, "PIVOTS", pivots)
    rng, rows = random.Random(11), []
    passage = [f"common{i}" for i in range(30)]
    for g in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 60, 150, 300]))] + passage * (g % 2)
        for k in range(6):
            text = list(base)
            for at in rng.sample(range(len(text)), max(1, round(len(text) * 0.006 * k))):
                text[at] = f"new{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(text)))
    want = by_jaccard(rows)
    assert 25 < len(set(want.values())) < 130
    docs = make([(i, t, "a") for i, t in rows])
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, near_dedup.NEAR_TEXTS).collect()} == want
    assert {r.doc_id for r in near_dedup.deduplicate(docs).collect()} == set(want.values())
