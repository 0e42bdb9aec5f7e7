"""Many texts that share most of a passage, but are not similar enough, are not compared pair by pair."""

import numpy as np

from leadquarry.llm import near_dedup, set_links


def crowd(n, seed=3):
    """Copies of one passage with many or few words replaced, and some twins."""
    rng = np.random.default_rng(seed)
    base, out = [f"w{i}" for i in range(150)], []
    for i in range(n):
        words = list(base)
        for at in rng.choice(150, 2 if i % 5 == 0 else rng.integers(4, 9), replace=False):
            words[at] = f"x{rng.integers(10**9)}"
        out.append(" ".join(words))
        if i % 40 == 7:
            out.append(" ".join([*words[:-1], "end"]))
    return out


def brute_force(texts, how):
    sets, root = [set(set_links.shingle_set(t, how).tolist()) for t in texts], list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(sets)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o >= how.similarity * (len(sets[a]) + len(sets[b]) - o) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(a) for a in range(len(sets))]


def test_a_crowd_costs_no_square(spark, monkeypatch):
    texts, compared, link = crowd(600), [], set_links._Forest.link

    def counted(self, pairs):
        compared.append(pairs.count())
        link(self, pairs)
    monkeypatch.setattr(set_links._Forest, "link", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, near_dedup.NEAR_TEXTS).collect()}
    assert got == dict(enumerate(brute_force(texts, near_dedup.NEAR_TEXTS)))
    assert sum(compared) < 60 * len(texts), compared


def test_edits_of_one_text_meet_by_what_they_changed(spark, monkeypatch):
    texts, compared, link = crowd(500, seed=5), [], set_links._Forest.link

    def counted(self, pairs):
        compared.append(pairs.count())
        link(self, pairs)
    monkeypatch.setattr(set_links._Forest, "link", counted)
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, near_dedup.NEAR_TEXTS).collect()}
    assert got == {**dict(enumerate(brute_force(texts, near_dedup.NEAR_TEXTS))), len(texts): len(texts)}
    assert sum(compared[1:]) < 4 * len(texts), compared
