"""Learned operators: held-out accuracy, exact parts against brute force, odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadquarry.llm import decontaminate, language_model, pii, quality, toxicity
from leadquarry.llm.labelled import fold
from leadquarry.llm.queries import QUERIES

SF_LEARN = "/root/testdata/sf0.01"


def auc(y, p):
    rank = np.argsort(np.argsort(p, kind="stable"), kind="stable") + 1
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("name,label,least", [("op4_quality_attention", "quality", 0.9), ("op8_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    got = QUERIES[name](spark, SF_LEARN).toPandas()
    assert len(got) == spark.read.parquet(f"{SF_LEARN}/documents.parquet").count() and got.score.between(0, 1).all()
    labels = spark.read.parquet(f"{SF_LEARN}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert auc(held[label].to_numpy(), held.score.to_numpy()) > least


def test_fold_is_crc32(spark):
    rows = spark.range(50).select("id", fold(F.col("id"), 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in rows)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, 1), (1, 0, 0), (None, 1, 1), (2, None, None), (6, 0, 0), (8, 0, 0)]])
def test_learned_scores_odd_rows(spark, odd, odd_rows, empty, labels):
    lab, all_rows = labels_of(spark, labels), F.lit(True)
    got = quality.score(odd, quality.learn(odd, lab, all_rows)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, quality.learn(empty, lab, all_rows)).collect() == []
    scored = toxicity.with_score(odd, toxicity.learn(odd, lab, all_rows), "_s")
    assert scored.drop("_s").columns == odd.columns
    got = scored.collect()
    assert len(got) == len(odd_rows) and all(0 <= r["_s"] <= 1 for r in got)
    assert toxicity.with_score(empty, toxicity.learn(empty, lab, all_rows)).collect() == []


def test_folding():
    assert toxicity.folded("You 1D10T, ѕtupіd!!! mörôn$$$ $cum 2024 b@d") == ["you", "idiot", "stupid", "moron", "scum", "2024", "bad"]
    assert toxicity.folded(None) == []


def test_lexicon_stems_and_exceptions(spark, make):
    plain = "the quick brown fox walks over a green field and rests"
    rows, labels = [], []
    for i in range(60):
        rows.append((i, f"{plain} zorgword{i} and {'gruff trash' if i % 2 else 'zorgword'}", "a"))
        labels.append((i, 1, 1))
    for i in range(60, 300):
        rows.append((i, f"{plain} {'trash can' if i % 2 else 'zorgfield'} number{i}", "a"))
        labels.append((i, 1, 0))
    docs = make(rows)
    lexicon = toxicity.learn(docs, labels_of(spark, labels), F.lit(True))
    test = make([(1000, "zorgword999 here", "a"), (1001, "a trash can here", "a"), (1002, "zorgfield here", "a"), (1003, plain, "a"), (1004, "Z0RGWORD77!", "a")])
    s = {r.doc_id: r["_s"] for r in toxicity.with_score(test, lexicon, "_s").collect()}
    assert s[1000] > 0.5 and s[1004] > 0.5 and max(s[1001], s[1002], s[1003]) < 0.5


def test_passages_cover_whole_texts():
    texts = [b"", b" \n ", b"one", b" ".join(b"w%d" % i for i in range(64)), b" ".join(b"w%d" % i for i in range(65)), b"x " * 100_000]
    x, count = quality.passages(texts)
    assert count.tolist() == [1, 1, 1, 1, 2, 64] and len(x) == count.sum() and np.isfinite(x).all()
    alone = [quality.passages([t]) for t in texts]
    assert np.allclose(x, np.concatenate([a for a, _ in alone]), atol=1e-6)


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, count, y = rng.normal(size=(9, quality.FEATURES)), np.array([4, 2, 3]), np.array([1.0, 0, 1])
    shapes = {"encode": (quality.FEATURES, 16), "encode0": (16,), "tanh": (16, 8), "gate": (16, 8), "attend": (8,), "out": (16,), "out0": (1,)}
    w = {k: rng.normal(0, 0.3, v) for k, v in shapes.items()}

    def loss():
        p = quality._forward(x, count, w)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    g = quality._gradients(x, count, y, w)
    for k in w:
        at = tuple(rng.integers(0, n) for n in w[k].shape)
        w[k][at] += 1e-5
        up = loss()
        w[k][at] -= 2e-5
        down = loss()
        w[k][at] += 1e-5
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_base_score_is_exact(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op9_language_model"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = collections.Counter(w for r in docs if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    for r in docs:
        g, t = got[r.doc_id], tokens(r.text)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum(w in c for w in t), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in got.values()) > sum(g.base_score for g in got.values()) and held


def test_language_model_is_a_distribution(spark, make):
    rows = make([(i, f"a b c d{i % 5} e f{i % 3}", "a") for i in range(40)]).select("text")
    counts = language_model.count_tokens(rows)
    model = language_model.train(rows, counts)
    codes, mass = language_model.Codes(model.own), np.zeros(language_model.CLASSES)
    for r in counts.collect():
        mass[codes[bytes(r.token)] & 63] += r.c + 1
    open_ = np.arange(language_model.CLASSES) >= language_model.WORD_CLASSES
    assert np.all(mass[open_] + 1 == pytest.approx(10 ** model.log_size[open_]))  # one share for unknown words
    used = sorted(model.own.values())
    assert mass[used] == pytest.approx(10 ** model.log_size[used])
    one = np.repeat([[0, language_model.ROWS, 2 * language_model.ROWS]], language_model.CLASSES, 0)
    assert np.exp(language_model.log_probability(model.table, one, np.arange(language_model.CLASSES))).sum() == pytest.approx(1, rel=1e-5)


def test_language_model_odd_rows(spark, odd, odd_rows, empty):
    got = language_model.score(odd, F.lit(True)).collect()
    assert len(got) == len(odd_rows) and all(np.isfinite(r.score) and r.n_known == r.n_tokens for r in got)
    unseen = language_model.score(odd, F.lit(False)).collect()
    assert len(unseen) == len(odd_rows) and all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in unseen)
    assert language_model.score(empty, F.lit(True)).collect() == []


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            small = lambda: all(int(p) <= 255 for p in m.group().split("."))  # noqa: E731, B023
            if kind == "email" or {"ip": small, "card": lambda: 16 <= len(d) <= 19 and luhn, "phone": lambda: 8 <= len(d) <= 15}[kind]():  # noqa: B023
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = ["a@b.c_d@e.f x@y", "é😀 joe@x.org.", "1.2.3.4.5.6.7.8", "300.1.1.1 0001.2.3.004", "4111 1111-1111 1111 x 4111111111111112",
          "+1 (017) 555-7713 +1-------- +123", "+49 30 1234567. +4930123456789012345", "9" * 5000 + " " + "a." * 3000, "@" * 50, "1 2 3 4 5 6 7 8",
          "4111111111111111 4111111111111111", "joe (at) x (dot) org, tel 030 555 7713", None, ""]


def test_base_spans_are_exact(spark, make, odd, odd_rows, empty):
    for rows, df in ((list(enumerate(TRICKY)), make([(i, t, "a") for i, t in enumerate(TRICKY)])), ([(d, t) for d, t, _ in odd_rows], odd)):
        got = sorted([(r.doc_id, [tuple(s) for s in r.base]) for r in pii.find(df).collect()], key=repr)
        assert got == sorted([(d, plain_spans(t or "")) for d, t in rows], key=repr)
    assert pii.find(empty).collect() == []


def test_personal_data_query(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op7_personal_data"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = [":".join(map(str, s)) for s in plain_spans(r.text or "")]
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, g.spans.split(",")))
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.KIND_NAMES]


def test_trees_add_what_looks_like_base_spans(spark, make):
    rows = [(i, f"write a mail to user{i}@host{i}.org now" if i % 2 else f"version {i}.{i}.{i} and build {1000000 + i} end", "a") for i in range(400)]
    rows += [(1000 + i, f"write a mail to user{i} (at) host{i} (dot) org now", "a") for i in range(20)]
    rows += [(2000 + i, f"please call tel +49 {300 + i} {5550000 + 37 * i} today", "a") for i in range(200)]
    rows += [(3000 + i, f"please call tel 030 {300 + i} {5550000 + 41 * i} today", "a") for i in range(20)]
    rows += [(4000 + i, f"nobody was at home{i}. Then order {7000000 + 13 * i} was shipped", "a") for i in range(200)]
    got = {r.doc_id: r for r in pii.find(make(rows)).collect()}
    assert all(len(got[i].spans) == len(got[i].base) == i % 2 for i in range(400))
    assert all(len(got[i].spans) == len(got[i].base) == (i < 4000) for i in [*range(2000, 2200), *range(4000, 4200)])
    for i, text in [(i, t) for i, t, _ in rows if 1000 <= i < 2000 or 3000 <= i < 4000]:
        (kind, start, end), = got[i].spans
        assert got[i].base == [] and (kind, text[start:end]) == (
            ("email", text[len("write a mail to "):-len(" now")]) if i < 2000 else ("phone", text[len("please call tel "):-len(" today")]))


def test_touching_a_long_directory(spark, make):
    """Twenty thousand base spans in one text: proposals are held against them without pairing."""
    text = " ".join(f"tel +49 30 {1000000 + i}; host{i} x@y{i}.org" for i in range(10000))
    got = pii.find(make([(1, text, "a")])).collect()[0]
    assert len(got.base) == 20000 and [tuple(s) for s in got.spans[:len(got.base)]] == [tuple(s) for s in got.base]


def wjaccard(a, b, w):
    return sum(w.get(s, 1) for s in a & b) / sum(w.get(s, 1) for s in a | b)


def test_leaks_are_found(spark, make, odd, empty):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(30)) + (" shared tail of all the items here" if i % 2 else "")) for i in range(20)]
    bench = spark.createDataFrame([*items, (99, None), (None, "x " * 20), (98, "too short")], "item_id long, text string")
    noise = lambda i, n: " ".join(f"n{i}x{j}" for j in range(n))
    docs = []
    for i, t in items:
        words = t.split()
        docs += [(i, f"{noise(i, 50)} {t.upper()}, {noise(i + 100, 9)}", "a"), (100 + i, f"{t}", "a"),
                 (200 + i, f"{noise(i, 5)} {' '.join(words[:-1])} end", "a"),  # last word changed
                 (300 + i, f"{' '.join(words[:12])} {noise(i, 40)}", "a"), (400 + i, noise(i, 60), "a")]
    docs += [(500, " ".join(t for _, t in items[:4]), "a"), (None, items[0][1], "a"), (501, None, "a"), (501, items[2][1], "a"), (501, items[2][1], "a")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(make(docs), bench).collect()}
    hold = collections.Counter()
    cut = lambda t: {tuple(t.lower().split()[k:k + 5]) for k in range(len(t.split()) - 4)}
    for _, t in items:
        hold.update(cut(t))
    w = {s: 1 / n for s, n in hold.items()}
    want = {(i + d, i) for i, _ in items for d in (0, 100)} | {(500, i) for i in range(4)} | {(501, 2)}
    want |= {(200 + i, i) for i, t in items if wjaccard(cut(t), cut(" ".join(t.split()[:-1]) + " end"), w) >= 0.8}
    assert set(got) == want
    assert got[0, 0].start_word == 50 and got[0, 0].similarity == 1 and got[0, 0].n_words == 30
    assert decontaminate.contaminated(empty, bench).collect() == [] == decontaminate.contaminated(odd, bench.limit(0)).collect()
    assert decontaminate.contaminated(odd, bench).collect() == []


def test_inner_edits_at_the_threshold_are_found(spark, make):
    """One inner word changed in items of 49 to 59 words: similarities from 0.80 to 0.83."""
    rng = random.Random(8)
    texts = [[f"i{i}w{j}" for j in range(49 + i % 11)] for i in range(220)]
    docs = []
    for i, ws in enumerate(texts):
        at = rng.randrange(4, len(ws) - 4)
        docs.append((i, " ".join(["before", *ws[:at], "edited", *ws[at + 1:], "after"]), "a"))
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(texts)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(make(docs), bench).collect()}
    assert set(got) == {(i, i) for i in range(len(texts))}
    assert all(got[i, i] == pytest.approx((len(ws) - 9) / (len(ws) + 1)) for i, ws in enumerate(texts))


def test_repeated_items_shared_ids_and_missing_ids(spark, make):
    words = [f"w{j}" for j in range(50)]
    bench = spark.createDataFrame([(i, " ".join(words)) for i in range(4)], "item_id long, text string")  # one item under four ids
    edited = " ".join([*words[:20], "edited", *words[21:]])
    other = " ".join([f"x{j}" for j in range(50)] + words[:12])
    rows = [(1, edited, "a"), (2, " ".join(words), "a"), (2, other, "a"), (2, " ".join(words[38:] + words[:12]), "a"), (None, " ".join(words), "b"), (3, other, "a")]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(make(rows), bench).collect()}
    assert got == {(1, i): pytest.approx(41 / 51) for i in range(4)} | {(2, i): 1.0 for i in range(4)}
    kept = decontaminate.clean(make(rows), bench)
    assert kept.columns == make(rows).columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted((d, t) for d, t, _ in (rows[2], rows[3], rows[5]))


def test_gradient_steps_take_4096_tokens(monkeypatch):
    """A text of 3 * 4096 tokens is three steps, however the batches of rows are cut."""
    sizes, plain = [], language_model._exponentials
    monkeypatch.setattr(language_model, "_exponentials", lambda w, r: sizes.append(len(r)) or plain(w, r))
    table = np.zeros((language_model.KINDS * language_model.ROWS, language_model.CLASSES), np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(["word"] * (3 * 4096 - 1))])], ["text"])
    list(language_model._updates(table, {language_model.END: 0})(iter([batch])))
    assert sizes == [4096] * 3
