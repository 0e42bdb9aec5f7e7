"""Readers, fallback chain, bundles and checkpoint settings."""

import pytest
from pyspark.sql import functions as F

from leadquarry.operators import learners, pu
from leadquarry.operators import linkage as L
from leadquarry.sources import tables


def test_header_discovery(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text('Title\n\nexport 1\nRNE,account_contact_name\n1,"A, B"\n2,N/A\n')
    rows = tables.read_below_titles(spark, str(f), "account_contact_name").collect()
    assert [(r.RNE, r.account_contact_name) for r in rows] == [("1", "A, B"), ("2", "N/A")]
    with pytest.raises(ValueError):
        tables.read_below_titles(spark, str(f), "absent")


def test_plain_header(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("account_contact_name,x\nA,1\n")
    assert [r.x for r in tables.read_below_titles(spark, str(f), "account_contact_name").collect()] == ["1"]


def test_businesses_csv(spark, tmp_path):
    f = tmp_path / "b.csv"
    f.write_text('name,rating,extra\n"Two\nlines",4.5,e\nB,bad,\n')
    rows = tables.read_businesses(spark, str(f)).collect()
    assert [(r.name, r.rating, r.extra) for r in rows] == [("Two\nlines", 4.5, "e"), ("B", None, None)]
    g = tmp_path / "c.csv"
    g.write_text("title\nx\n")
    with pytest.raises(ValueError):
        tables.read_businesses(spark, str(g))


def test_fallback_chain(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "v2"))
    assert tables.first_existing(spark, [str(tmp_path / "v3"), str(tmp_path / "v2")]).endswith("v2")
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, [str(tmp_path / "none")])


def test_json_summary(spark, tmp_path):
    tables.write_json(spark, {"best": "x", "sizes": {"train": 3}}, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().sizes.train == 3


def test_missing_axes_switch_off(spark):
    p = spark.createDataFrame([(1, "Ets Foo Bar", "file_1"), (2, "Zed", "file_1")], "purchase_id long, account_contact_name string, source_file string")
    b = spark.createDataFrame([(10, "FOO BAR sarl"), (11, "foo bar")], "biz_id long, name string")
    options = L.LinkageOptions()
    assert list(options.usable_axes(p.withColumn("norm", F.lit("")), b)) == ["exact_name"]
    r = {x.purchase_id: x for x in L.link(p, b, options).review.collect()}
    assert (r[1].bucket, r[1].biz_id, r[1].score) == ("exact", 10, 100.0)
    assert r[2].match_reason.startswith("fuzzy_name(")


def test_no_businesses_with_a_name_gives_no_match(spark):
    p = spark.createDataFrame([(1, "Foo", "file_1")], "purchase_id long, account_contact_name string, source_file string")
    b = spark.createDataFrame([(10, "12")], "biz_id long, name string")
    r = L.link(p, b).review.first()
    assert (r.bucket, r.biz_id, r.score) == ("no_match", None, 0.0)


def test_out_of_bag_skips_the_rounds_of_a_negative(spark):
    df = spark.range(200).select(F.col("id").alias("biz_id"), (F.col("id") % 10 == 0).cast("int").alias("y_train"),
                                 (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, "u").alias("b"))
    prepared = learners.Scorecard().prepare(df, ["a", "b"])
    neg = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (11, 1)], "biz_id long, round int")
    got = {r.biz_id: r for r in pu.bagging(prepared, df, rounds=2, negatives=neg)[0].collect()}
    assert got[1].n_rounds == 0 and got[1].score is None
    assert got[3].n_rounds == 1 and got[5].n_rounds == 2
