"""The block join of the fuzzy names: what it stores, and long, repeated and unlike names."""

import random

import pytest
from test_properties import plain_lcs, set_ratio

from leadquarry.operators import fuzzy


def ask(spark, rows, asked, scorer):
    names = fuzzy.distinct_names(spark.createDataFrame(rows, "biz_id long, norm string"))
    return names, spark.createDataFrame([(q,) for q in asked], "norm string")


@pytest.mark.parametrize("as_set", [True, False])
def test_ties_do_not_grow_the_stored_pairs(spark, as_set):
    """Queries that share no letter with any name tie with all of them; two names a query are stored."""
    rows = [(i, f"{'bcdf'[i % 4]}{'aeio'[i // 4 % 4]} {'gh'[i % 2]}{'u' * (i % 40)}{'k' * (i // 40)}") for i in range(1200)]
    names, queries = ask(spark, rows, ["wwww", "xyx yx", "zzz"], as_set)
    queries, sets = fuzzy.prepared(queries, names, as_set)
    assert fuzzy.candidates(queries, sets, as_set).count() <= 2 * 3


@pytest.mark.parametrize("scorer", ["token_set_ratio", "token_sort_ratio"])
def test_long_and_repeated_words(spark, scorer):
    """Texts of several machine words, accents and signs beyond 16 bits, words that come twice."""
    rng = random.Random(11)
    stock = ["ab", "ba", "grand", "hotel", "été", "x\U0001F600y", "a" * 30, "tunisia" * 6, "palmier"]
    text = lambda: " ".join(rng.choice(stock) + rng.choice(["", "", "q", "zz"]) for _ in range(rng.randint(1, 7)))
    rows, asked = [(i, text()) for i in range(90)], sorted({text() for _ in range(25)})

    def sort_ratio(a, b):
        a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        return 100 - 100 * (len(a) + len(b) - 2 * plain_lcs(a, b)) / (len(a) + len(b))
    score = set_ratio if scorer == "token_set_ratio" else sort_ratio
    names, queries = ask(spark, rows, asked, scorer)
    got = {}
    for r in fuzzy.fuzzy_top2(queries, names, scorer).collect():
        got.setdefault(r.norm, {})[r.place] = (round(r.score, 9), r.biz_id)
    want = {q: sorted(((round(score(q, n), 9), i) for i, n in rows), key=lambda x: (-x[0], x[1]))[:2] for q in asked}
    assert {q: [v[1], v[2]] for q, v in got.items()} == want
