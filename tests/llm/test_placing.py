"""Mixing, sharding and top-k search against brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadquarry.llm import mixing, sharding, topk
from leadquarry.llm.queries import QUERIES


def test_mixing_meets_targets(spark, odd, odd_rows, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(odd.repartition(5)).collect()), key=repr)
    sizes = {}
    for _, t, s in odd_rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    order = sorted(k for k in sizes if k is not None) + [None]
    weights, goal, open_, left = dict(zip(order, [3, 1, 2, 3])), {}, list(order), 1.5 * sum(sizes.values())
    while True:  # deal out, cap, deal the excess out again
        rate = left / sum(weights[k] for k in open_)
        over = [k for k in open_ if rate * weights[k] > 2 * sizes[k]]
        if not over:
            goal |= {k: rate * weights[k] for k in open_}
            break
        for k in over:
            goal[k], left = 2.0 * sizes[k], left - 2 * sizes[k]
            open_.remove(k)
    for s in order:
        rows = [r for r in got if r.source == s]
        assert rows[0].target == pytest.approx(goal[s]) and rows[0].source_size == sizes[s]
        taken = sum(r.taken for r in rows)
        assert abs(taken - goal[s]) <= max(r.size for r in rows) / 2 + 1e-6 or len({r.doc_id for r in rows}) < len(rows)
    assert all(0 <= r.copies <= 2 and r.taken == r.size * r.copies for r in got)
    assert mixing.mix(empty).collect() == []


def test_mixing_keeps_rows(spark, odd):
    rows = mixing.mix(odd, keep=True).select("row.*")
    assert rows.columns == odd.columns and sorted(map(tuple, rows.collect()), key=repr) == sorted(map(tuple, odd.collect()), key=repr)


def test_sharding(spark, odd, odd_rows, empty):
    got = sharding.shard_documents(odd, sharding.grid(7), sharding.grid(8)).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted(
        (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in odd_rows)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.shard_documents(empty, sharding.grid(4)).collect() == []


def test_movement_is_confined(spark):
    rows = spark.range(20_000)
    place = lambda tree: {r.id: r.shard for r in sharding.place(rows, rows.id, tree).collect()}
    for n in (1, 40, 41, 59):
        before, after = place(sharding.grid(n)), place(sharding.grid(n + 1))
        assert {after[i] for i in before if after[i] != before[i]} <= {n}
    before = place(sharding.grid(40))
    counts = np.bincount(list(before.values()), minlength=40)
    assert counts.min() > 380 and counts.max() < 620
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 17 else 1.0) for x in sharding.grid(40)]
    after = place(heavier)
    assert {after[i] for i in before if after[i] != before[i]} == {17}
    assert list(after.values()).count(17) == pytest.approx(20_000 * 3 / 42, rel=0.15)


def test_sharding_query(spark, sf):
    got = QUERIES["op10_hash_tree_sharding"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40 for r in got)


def plain_top(rows, k, is_query):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        q = [int(np.floor(64 * float(np.float32(x)))) for x in v]
        ok[i] = min(ok.get(i, q), q)
    out = []
    for i, q in ok.items():
        if is_query(i):
            found = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok.items() if j != i and len(c) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def test_top_k_with_ties_nulls_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(250)]
    rows += [(int(i), [0.25] * 6) for i in range(250, 300)]  # many ties
    rows += [(300, None), (320, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (340, [float("nan")] * 6), (360, [float("inf")] * 6), (None, [0.5] * 6),
             (380, [1.0] * 5), (400, [2.0] * 5), (20, rows[20][1]), (420, [])]
    df = spark.createDataFrame([(i, v, 7, 8) for i, v in rows], "vec_id long, embedding array<float>, v int, cb int")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect()))
    assert got == plain_top(rows, 5, lambda i: i % 20 == 0)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
