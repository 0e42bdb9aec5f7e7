"""The Merkle manifest against a tree built in one place."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from leadquarry.llm import merkle


def digest(*values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return sha256("".join(parts).encode()).hexdigest()


def join(nodes):
    return sha256("".join(nodes).encode()).hexdigest()


def tree(leaves):
    """Subroot, and per leaf the (siblings, place) of every level."""
    proofs, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, p in enumerate(proofs):
            run = nodes[at[i] // 8 * 8:][:8]
            p.append(("".join(run[:at[i] % 8] + run[at[i] % 8 + 1:]), at[i] % 8))
        nodes, at = [join(nodes[k:k + 8]) for k in range(0, len(nodes), 8)], [a // 8 for a in at]
    return nodes[0], proofs


def brute(rows):
    """Rows of (doc_id, lang, text, shown): (doc_id, leaf, subroot, root, joined proof, folded root)."""
    groups = {}
    for doc_id, lang, text in rows:
        shown = text
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text:
            shown = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(lang, []).append((doc_id, digest(doc_id, lang, text), digest(doc_id, lang, shown)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        made[g] = tree([r[1] for r in groups[g]])
    root, above = tree([made[g][0] for g in order]) if order else (None, [])
    out = []
    for g, top in zip(order, above):
        for (doc_id, leaf, shown), proof in zip(groups[g], made[g][1]):
            folded = merkle.fold(shown, [s for s, _ in proof + top], [p for _, p in proof + top])
            out.append((doc_id, leaf, made[g][0], root, "".join(s for s, _ in proof + top), folded))
    return sorted(out, key=repr)


def run(docs):
    leaf = lambda text: merkle.leaf_of(F.col("doc_id"), F.col("lang"), text)
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    got = merkle.manifest(docs, leaf(F.col("text")), F.col("lang"), F.col("doc_id"), shown).collect()
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    assert all(merkle.fold(r.leaf, r.proof, r.places) == r.root for r in got)
    return sorted([(r.ord, r.leaf, r.subroot, r.root, "".join(r.proof), r.folded_root) for r in got], key=repr)


def test_awkward_rows(spark, odd, odd_rows, empty):
    assert run(odd) == brute([(i, "en", t) for i, t, _ in odd_rows])
    assert run(empty) == []


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, None: 9, "É": 64, "z": 65}, {"hot": 5000, "b": 512, "c": 513, None: 3}])
def test_any_size(spark, sizes):
    rows = [(i, g, f"Text {i} {g}") for g, n in sizes.items() for i in range(n)]
    rows += [(7, "a", "Same")] * 9 + [(None, "a", "Same")] * 2  # repeated rows and rows without an id
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    want = brute(rows)
    assert run(docs) == want
    changed = sum(r[5] != r[3] for r in want)
    assert 0 < changed < len(rows) or len(rows) < 20  # tampered rows, and only those, lead elsewhere
