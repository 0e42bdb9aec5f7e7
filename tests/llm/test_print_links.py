"""The pipeline's near-duplicate stage links by op3's fingerprints as well as by shingle sets."""

import random

import corpus_pipeline
from leadquarry.llm import near_dedup
from leadquarry.llm.shingles import shingle_hashes
from test_dedup import shingles_of


def test_fingerprints_and_sets_both_link(spark, make):
    """1 and 2 have fingerprints within 3 bits and unlike sets, 2 and 3 like sets; 4 is by itself."""
    rng = random.Random(5)
    line = "one two three four five six seven " * 150
    own = lambda: [f"w{rng.randrange(10 ** 6)}" for _ in range(12)]
    second = own()
    third = [*second, *line.split()[:1]]
    rows = [(1, line + " ".join(own())), (2, line + " ".join(second)), (3, line + " ".join(third)), (4, " ".join(own() * 4)), (5, None), (6, "")]
    prints = [near_dedup.fingerprint(shingle_hashes(t, 3, 42)) for _, t in rows[:3]]
    assert (prints[0] ^ prints[1]).bit_count() <= 3
    sets = [shingles_of(t) for _, t in rows[:3]]
    assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    assert len(sets[1] & sets[2]) >= 0.8 * len(sets[1] | sets[2])
    docs = make([(i, t, "a") for i, t in rows])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    by_sets = near_dedup.deduplicate(docs)
    assert sorted(r.doc_id for r in by_sets.collect()) == [1, 2, 4, 5]
