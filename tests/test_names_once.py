"""A name is cleaned once, however often its words are looked at."""

from pyspark.sql import functions as F

from leadquarry.functions import text as T


def test_tokens_are_worked_out_once(spark):
    """The blanks between words are looked for once per name."""
    df = spark.createDataFrame([("Société Été & Cie 12",)], "name string").select(T.normalized_name(F.col("name")).alias("norm"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_same_words(spark):
    rows = [(None, ""), ("", ""), ("S A", ""), ("A B C", "abc"), ("S.A.R.L Café́ Œuf", "cafe oeuf"), ("Ets 12 Müller 3b", "muller"), ("plain name", "plain name")]
    df = spark.createDataFrame(rows, "name string, want string")
    assert [r.got == r.want or r for r in df.select(T.normalized_name(F.col("name")).alias("got"), "want").collect()] == [True] * len(rows)
