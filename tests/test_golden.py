"""Golden rows of the scalar rules."""

from pyspark.sql import functions as F

from leadquarry.functions import features as X
from leadquarry.functions import text as T
from leadquarry.operators import linkage as L
from leadquarry.operators import pu
from leadquarry.operators.prior import Prior, prior_from_c, robust_prior


def apply(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_names(spark):
    cases = {"COTES 1482105VAM000 SARL": ("cotes", True), "Société  Générale & Cie.": ("generale", True),
             "M.W.S": ("mws", False), "S.A.R.L": ("", False), None: ("", False), "": ("", False), "12 34": ("", False),
             "Café de l'Étoile": ("cafe de etoile", False), "Œuvre straße": ("oeuvre strasse", False),
             "snake_case Co": ("snake_case", True), "مقهى النور": ("مقهى النور", False)}
    assert apply(spark, cases, T.normalized_name) == [v[0] for v in cases.values()]
    assert apply(spark, cases, T.has_legal_form) == [v[1] for v in cases.values()]


def test_names_are_stable_under_renormalising(spark):
    names = ["Ets Café 77", "M.W.S", "Hôtel & Spa d'Étoile", "A b c", "Ünïcode Øre"]
    once = apply(spark, names, T.normalized_name)
    assert apply(spark, once, T.normalized_name) == once


def test_phones(spark):
    good = ["+216 93 472 427", "216-93-472-427", "93 472 427", "0021693472427"]
    assert apply(spark, good, T.normalized_phone) == ["93472427"] * 4
    assert apply(spark, ["0093472427", "61234567", "12345678", "9347242", None], T.normalized_phone) == [""] * 5
    assert apply(spark, ["0093472427"], lambda c: T.normalized_phone(c, strip_plain_00=True)) == ["93472427"]


def test_hosts_and_registry_ids(spark):
    cases = {"http://www.tunisair.com/": "tunisair.com", "https://facebook.com/somebrand": "facebook.com",
             "somebrand.tn": "somebrand.tn", " HTTPS://WWW.A.TN:8080?x=1 ": "a.tn:8080",
             "https://m.a.net/en#top": "m.a.net", "https://m.a.net#top": "m.a.net#top", None: "", "  ": ""}
    assert apply(spark, cases, T.normalized_host) == list(cases.values())
    assert apply(spark, [" Ab 12 ", None], T.normalized_registry_id) == ["ab12", ""]


def test_feature_scalars(spark):
    assert apply(spark, ["a;b; ", "", ";", None], X.email_count) == [2, 0, 0, 0]
    assert apply(spark, ["http://a.tn", "http://a.tn/x", "http://a.tnx", "A.TN"],
                 lambda c: X.matches(c, X.HOST_TN, False)) == [1, 1, 0, 0]
    assert apply(spark, ["ABC", "ABCD", "1234", "مقهى", None], X.is_upper) == [0, 1, 0, 1, 0]
    assert apply(spark, ["a  b", "", None, " x"], X.word_count) == [2, 0, 0, 1]
    assert apply(spark, ["1.5", "x", None, "nan"], X.number) == [1.5, None, None, None]
    assert apply(spark, ["exact", "borderline", "?", None], X.positive_weight) == [1.0, 0.5, 1.0, 1.0]


def test_score_rules(spark):
    rows = [(100.0, 0.0, True, "exact"), (96.0, 0.0, False, "high_confidence"), (88.0, 87.0, False, "ambiguous"),
            (90.0, 0.0, False, "high_confidence"), (89.9, 0.0, False, "borderline"), (78.0, 0.0, False, "borderline"),
            (77.9, 0.0, False, "weak"), (65.0, 0.0, False, "weak"), (64.9, 0.0, False, "no_match"),
            (44.0, 44.0, False, "ambiguous")]
    df = spark.createDataFrame(rows, "s1 double, s2 double, certain boolean, want string")
    got = df.select("want", L.bucket(F.col("s1"), F.col("certain"), L.is_ambiguous(F.col("s1"), F.col("s2")), "exact").alias("b"))
    assert all(r.want == r.b for r in got.collect())
    amb = spark.createDataFrame([(94.0, 92.0), (94.0, 91.0), (95.0, 95.0), (80.0, 0.0)], "a double, b double")
    assert [r.x for r in amb.select(L.is_ambiguous(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, False]
    floor = amb.select(L.is_ambiguous(F.col("a"), F.col("b"), 99).alias("x"))
    assert not any(r.x for r in floor.collect())


def test_robust_prior_and_conversion():
    p = robust_prior(Prior(.3498, .0497, .001), Prior(.99, .0056, .347))
    assert (p.pi_hat, round(p.c_hat, 5), p.threshold) == (.3498, .02765, .174)
    assert prior_from_c(0.0, 10, 100) == 0.1 / 0.9
    assert prior_from_c(0.01, 10, 100) == 0.99


def test_correction(spark):
    df = spark.createDataFrame([(0.2,), (0.9,)], "s double")
    assert [r.x for r in df.select(pu.corrected(F.col("s"), 0.4).alias("x")).collect()] == [0.5, 1.0]
    assert [r.x for r in df.select(pu.corrected(F.col("s"), 0.0).alias("x")).collect()] == [0.2, 0.9]
