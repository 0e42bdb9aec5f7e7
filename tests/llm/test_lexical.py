"""Ranked search against scoring every document for every item."""

import math
import re
from collections import Counter

from leadquarry.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    big_n, big_l = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted, out = {}, []
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    for item, found in wanted.items():
        scores = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in found if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def check(spark, make, docs, items, k=10):
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, lexical.search(make([(i, t, "s") for i, t in docs]).repartition(4), items_df, k).collect()), key=repr)
    assert got == brute(docs, items, k)
    return got


def test_awkward_rows(spark, make, odd_rows, monkeypatch):
    docs = [(i, t) for i, t, _ in odd_rows] + [(20, "Été ÉTÉ été-b B.b"), (21, "a,a;a"), (21, "a b"), (22, "A" * 50), (23, "x\x00y 汉字 汉字。")]
    items = [(1, "a b c"), (1, "été passage3 passage59"), (None, "w1 W2 z"), (2, None), (3, " ... "), (4, "word word WORD"), (5, "z" * 200_000),
             (6, "汉字 y"), (7, "aa" * 25), (8, "ab"), (9, "É")]
    whole = check(spark, make, docs, items)
    assert {r[0] for r in whole} >= {None, 1, 4, 5, 6, 7} and not {2, 3, 8} & {r[0] for r in whole}
    monkeypatch.setattr(lexical, "LETTERS", 20)  # many blocks, same rows
    assert check(spark, make, docs, items) == whole
    assert check(spark, make, docs, []) == [] and check(spark, make, [], items) == [] and check(spark, make, [(1, None), (2, "")], items) == []


def test_ties_and_many_documents(spark, make):
    docs = [(i, f"common t{i % 7} " + "pad " * (i % 5)) for i in range(3000)]
    items = [(j, f"common t{j % 7} absent pad pad") for j in range(300)]
    got = check(spark, make, docs, items, k=4)
    assert len(got) == 1200
