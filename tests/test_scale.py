"""Many categories, hot values, missing keys, long strings and odd file layouts."""

import pytest
from pyspark.sql import functions as F

from leadquarry.functions import similarity
from leadquarry.operators import features, learners, rank, skew, spatial
from leadquarry.sources import tables


@pytest.fixture(scope="module")
def wide(spark):
    """A third of the rows on one value, 150 categories, some nulls."""
    return spark.range(3000).select(
        F.col("id").alias("biz_id"), (F.xxhash64("id") % 1000 / 7.0).alias("x"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("c"), (F.col("id") % 149).cast("string"))).alias("kind"))


def test_quantiles_do_not_depend_on_partitions(spark):
    df = spark.range(30_000).select((F.xxhash64("id") / 1e15).alias("v"), (F.col("id") % 7).cast("double").alias("w"))
    found = {repr(rank.exact_quantiles_by_column(df.repartition(n), ["v", "w"], [0.1, 0.5, 0.9], discrete=d)) for n in (1, 7, 32) for d in (True,)}
    assert len(found) == 1
    values = sorted(r.v for r in df.collect())
    got = rank.exact_quantiles_by_column(df, ["v"], [0.1, 0.5], discrete=True)["v"]
    assert got == [values[2999], values[14_999]]
    assert rank.exact_quantiles_by_column(df.where("1 = 0"), ["v"], [0.5]) == {"v": [None]}


def test_scorecard_keeps_every_category_and_both_ways_agree(spark, wide, monkeypatch):
    labels = wide.select("biz_id", (F.col("kind") == "c5").cast("int").alias("y"), F.lit(1.0).alias("w")).fillna(0)
    negatives = labels.where("y = 0").select("biz_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("round")).where(
        F.pmod(F.xxhash64("biz_id", "round"), F.lit(3)) == 0)

    def scores():
        p = learners.Scorecard().prepare(wide, ["x", "kind"])
        assert p.sizes[1] == 151
        one = {r.biz_id: r.score for r in p.fit_score(labels).collect()}
        many = {r.biz_id: (r.score, r.n_rounds) for r in p.fit_score_rounds(labels.where("y = 1"), negatives, 3, [1.0])[0].collect()}
        return one, many
    sent = scores()
    monkeypatch.setattr(learners, "BROADCAST_WEIGHTS", 0)
    monkeypatch.setattr(learners, "BROADCAST_CODES", 0)
    joined = scores()
    for a, b in zip(sent, joined):
        assert a.keys() == b.keys() and len(a) == 3000
        assert all(a[i] == pytest.approx(b[i]) for i in a)
    kinds = {r.biz_id: r.kind for r in wide.collect()}
    five = [sent[0][i] for i, k in kinds.items() if k == "c5"]
    assert min(five) > max(s for i, s in sent[0].items() if kinds[i] != "c5")


def test_group_sizes_both_ways(spark, wide, monkeypatch):
    want = {r.biz_id: r.n for r in features.group_sizes(wide, {"kind": "n"}).collect()}
    monkeypatch.setattr(features, "BROADCAST_GROUPS", 0)
    assert {r.biz_id: r.n for r in features.group_sizes(wide, {"kind": "n"}).collect()} == want
    assert want[0] == 1000 and want[1] is None and len(want) == 3000


def test_grouped_ranks_both_ways(spark, wide, monkeypatch):
    ranks = lambda: {r.biz_id: r["rank"] for r in rank.grouped_row_numbers(wide, "kind", [F.asc("biz_id")]).collect()}
    want = ranks()
    monkeypatch.setattr(rank, "BROADCAST_GROUPS", 0)
    assert ranks() == want and want[0] == 1 and want[2997] == 1000


def test_missing_scores_take_no_rank(spark):
    rows = [(1, "a", 0.1), (2, "a", 0.9), (3, "a", None), (1, "b", None), (2, "b", 0.3), (3, "b", None)]
    got = {r.biz_id: r.score for r in rank.ensemble(spark.createDataFrame(rows, "biz_id long, method string, score double")).collect()}
    assert got == {1: 0.5, 2: 1.0, 3: None}


def test_rows_without_coordinates_stay(spark):
    df = spark.createDataFrame([(1, 36.0, 10.0, "a"), (2, 36.001, 10.0, "a"), (3, None, None, "a"), (4, 36.0, None, "a"), (5, 36.0, 10.0, None)],
                               "biz_id long, latitude double, longitude double, search_category string")
    got = {r.biz_id: r.competitor_density for r in spatial.competitor_density(df).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def test_similarity_takes_nulls_and_long_names(spark):
    rows = [("abc def", "def abc"), (None, "x"), ("x", None), (None, None), ("q" * 5000, "q" * 4900), ("a", "b")] + [("name one", "name two")] * 500
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    for f in (similarity.indel_ratio, similarity.token_sort_ratio, similarity.token_set_ratio):
        got = [r.s for r in df.select(f("a", "b").alias("s")).collect()]
        assert got[1:4] == [None, None, None] and got[4] == pytest.approx(100 - 100 * 100 / 9900) and got[5] == 0


def test_ids_follow_files_and_lines(spark, tmp_path):
    n = 0
    for i, rows in enumerate((400, 90, 3)):  # sizes fall, so large files are packed first
        lines = ["name,address"] + [f"b{n + j},\"street {j}\"" for j in range(rows)]
        n += rows
        (tmp_path / f"part{i}.csv").write_text("\n".join(lines))
    (tmp_path / "all.csv").mkdir()
    for p in tmp_path.glob("part*.csv"):
        p.rename(tmp_path / "all.csv" / p.name)
    for multi in (True, False):
        got = tables.read_businesses(spark, f"{tmp_path}/all.csv", multi_line=multi).collect()
        assert sorted((r.biz_id, r.name) for r in got) == [(i, f"b{i}") for i in range(n)]


def test_held_out_distribution(spark):
    from leadquarry.operators.evaluate import held_out_distribution
    scores = spark.range(500).select(F.col("id").alias("biz_id"), (F.col("id") / 500).alias("score"))
    train = spark.range(500).select(F.col("id").alias("biz_id"), (F.col("id") % 10 == 0).alias("is_holdout"), (F.col("id") % 10 == 1).cast("int").alias("y_train"))
    got = held_out_distribution(scores, train, 120, 42, bins=8).groupBy("part").agg(F.sum("n").alias("n")).collect()
    assert {r.part: r.n for r in got} == {"held_out": 50, "unlabelled": 120}


def test_lookup_join_keeps_hot_keys_apart(spark):
    """A third of the rows on one key and a third on null: the same rows as a plain join, and the hot key in no shuffle."""
    rows = spark.range(60_000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("k"))
    table = rows.where("k IS NOT NULL").groupBy("k").agg(F.sum("id").alias("total")).where("k <> 'k10'")
    got = skew.lookup_join(rows, table, ["k"])
    want = rows.join(F.broadcast(table), "k", "left").select("id", "k", "total")
    assert got.columns == ["id", "k", "total"] and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    few = skew.lookup_join(rows.limit(900), table, ["k"])
    assert few.count() == 900
    cold = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in cold and "rightHint=(strategy=broadcast)" in cold


def test_a_site_that_a_third_of_the_rows_share(spark):
    df = spark.range(6000).select(
        F.col("id").alias("biz_id"), (F.col("id") % 3).cast("string").alias("search_category"), (F.col("id") % 700 == 0).cast("int").alias("is_customer"),
        F.when(F.col("id") % 3 == 0, 36.8).otherwise(36.0 + F.col("id") % 500 / 500).alias("latitude"),
        F.when(F.col("id") % 3 == 0, 10.1).otherwise(10.0 + F.col("id") % 311 / 311).alias("longitude"))
    one = {r.biz_id: r.competitor_density for r in spatial.competitor_density(df).collect()}
    assert len(one) == 6000 and {one[i] for i in range(0, 6000, 3)} == {1999}
    near = spatial.customer_proximity(df).collect()
    assert len(near) == 6000 and len({r.customers_within_5km + r.is_customer for r in near if r.biz_id % 3 == 0}) == 1
