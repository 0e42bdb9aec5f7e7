"""Feature scalars, frequencies, distance joins and whole feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadquarry import fixtures as fx
from leadquarry.checks import sqltext as S
from leadquarry.checks.linking import ALL_AXES, _sides
from leadquarry.checks.registry import query
from leadquarry.functions import features as X
from leadquarry.operators import features as FT
from leadquarry.operators import linkage as L
from leadquarry.operators import spatial as SP
from leadquarry.session import cut

_known: dict[tuple[str, str], object] = {}


def labeled(spark, sf):
    """Businesses with the customers found by the exact axes and a spread of confidences."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _known:
        p, b = _sides(spark, sf)
        hit = L.exact_matches(p, b, ALL_AXES).select("biz_id").distinct().withColumn("h", F.lit(1))
        conf = F.when(F.col("h").isNull(), "").when(F.col("biz_id") % 3 == 0, "borderline").when(
            F.col("biz_id") % 3 == 1, "exact").otherwise("high")
        _known[key] = cut(b.drop("norm").join(hit, "biz_id", "left").withColumn(
            "is_customer", F.coalesce("h", F.lit(0))).withColumn("match_confidence", conf).drop("h"))
    return _known[key]


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- SQL of the scalars ----------------------------------------------------------------

def _q(p: str) -> str:
    return p.replace("'", "''")


def _flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def _rx(e: str, p: str, opt: str = "i") -> str:
    return _flag(f"regexp_matches({e}, '{_q(p)}', '{opt}')")


def _words(e: str) -> str:
    return f"len(list_filter(string_split(regexp_replace(coalesce({e}, ''), '{S.BL}+', ' ', 'g'), ' '), lambda t: t <> ''))::INTEGER"


_TEXT = "concat(coalesce(name, ''), ' ', coalesce(category, ''), ' ', coalesce(search_category, ''))"
_SCALARS = {
    "latitude": "latitude", "longitude": "longitude", "rating": "rating",
    "rating_missing": _flag("rating IS NULL"), "reviews": "coalesce(reviews, 0)",
    "log_reviews": "ln(1 + coalesce(reviews, 0))", "has_reviews": _flag("coalesce(reviews, 0) > 0"),
    "rating_x_logreviews": "coalesce(rating, 0) * ln(1 + coalesce(reviews, 0))",
    **{f"has_{c}": _flag(f"coalesce({c}, '') <> ''") for c in ("phone", "website", "email")},
    "digital_presence_count": " + ".join(f"({_flag(f'''coalesce({c}, '') <> '' ''')})" for c in ("phone", "website", "email")),
    "phone_is_tn": _rx("coalesce(phone, '')", r"\+?216", "c"), "website_is_tn": _rx("coalesce(website, '')", r"\.tn(/|$)", "c"),
    "website_is_social": _rx("coalesce(website, '')", r"facebook\.com|instagram\.com|linkedin\.com"),
    "email_count": "len(list_filter(string_split(coalesce(email, ''), ';'), lambda e: trim(e) <> ''))::INTEGER",
    "is_legal_entity": _rx("coalesce(name, '')", "|".join(X.LEGAL_ENTITY_PATTERNS)),
    "name_has_arabic": _rx("coalesce(name, '')", r"[\x{0600}-\x{06ff}]", "c"),
    "name_has_digits": _rx("coalesce(name, '')", r"\p{Nd}", "c"),
    "name_is_upper": _flag("length(coalesce(name, '')) > 3 AND upper(name) = name AND regexp_matches(name, '\\p{L}')"),
    "name_length": "length(coalesce(name, ''))::INTEGER", "address_length": "length(coalesce(address, ''))::INTEGER",
    "name_word_count": _words("name"), "address_word_count": _words("address"),
    **{f"vert_{k}": _rx(_TEXT, p) for k, p in X.VERTICAL_PATTERNS.items()},
    **{f"addr_{k}": _rx("coalesce(address, '')", p) for k, p in X.ADDRESS_PATTERNS.items()},
    "positive_weight": "CASE WHEN match_confidence = 'borderline' THEN 0.5 ELSE 1.0 END",
}
_DOUBLES = {"latitude", "longitude", "rating", "reviews", "log_reviews", "rating_x_logreviews", "positive_weight",
            "customer_nearest_km", "log_customer_nearest_km"}


def _sel(cols) -> str:
    return ", ".join(f"round({_SCALARS[c]}, 6)::DOUBLE AS {c}" if c in _DOUBLES else f"{_SCALARS[c]} AS {c}" for c in cols)


_DIST = ("2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * "
         "cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))")

FEATURE_CTES = f"""{S.LABELED},
dens AS (SELECT x.biz_id, count(*) AS n FROM labeled x JOIN labeled y ON coalesce(x.search_category, 'Unknown') = coalesce(y.search_category, 'Unknown')
   AND x.biz_id <> y.biz_id AND {_DIST.format(a='x', b='y')} <= 2000 GROUP BY x.biz_id),
prox AS (SELECT x.biz_id, min({_DIST.format(a='x', b='y')}) / 1000 AS km, count(*) FILTER (WHERE {_DIST.format(a='x', b='y')} <= 5000) AS n5
   FROM labeled x JOIN labeled y ON y.is_customer = 1 AND x.biz_id <> y.biz_id AND x.latitude IS NOT NULL AND y.latitude IS NOT NULL GROUP BY x.biz_id),
feat0 AS (SELECT l.*, coalesce(governorate, 'Unknown') AS gov_f, coalesce(category, 'Unknown') AS cat_f, coalesce(search_category, 'Unknown') AS sc_f,
   coalesce(dens.n, 0) AS competitor_density, prox.km, coalesce(prox.n5, 0) AS customers_within_5km
   FROM labeled l LEFT JOIN dens USING (biz_id) LEFT JOIN prox USING (biz_id)),
feat1 AS (SELECT *, coalesce(km, (SELECT median(km) FROM feat0)) AS nearest_km,
   count(*) OVER (PARTITION BY gov_f) AS gov_size, count(*) OVER (PARTITION BY cat_f) AS category_size, count(*) OVER (PARTITION BY sc_f) AS search_category_size
   FROM feat0)"""

_COMPUTED = {
    "governorate": "gov_f AS governorate", "category": "cat_f AS category", "search_category": "sc_f AS search_category",
    "gov_size": "gov_size", "category_size": "category_size", "search_category_size": "search_category_size",
    "competitor_density": "competitor_density", "customers_within_5km": "customers_within_5km",
    "customer_nearest_km": "round(nearest_km, 6) AS customer_nearest_km",
    "log_customer_nearest_km": "round(ln(1 + nearest_km), 6) AS log_customer_nearest_km",
    "has_customer_within_5km": f"{_flag('customers_within_5km > 0')} AS has_customer_within_5km",
}


def feature_sql(columns) -> str:
    return ", ".join(_COMPUTED[c] if c in _COMPUTED else _sel([c]) for c in columns)


def _scalar_query(name, cols):
    @query(name, f"{S.LABELED} SELECT biz_id, {_sel(cols)} FROM labeled")
    def run(spark, sf):
        return rounded(FT.scalar_features(labeled(spark, sf)).select("biz_id", *cols))


_scalar_query("numeric_and_review_features", ["rating", "rating_missing", "reviews", "log_reviews", "has_reviews", "rating_x_logreviews"])
_scalar_query("presence_features", ["has_phone", "has_website", "has_email", "digital_presence_count", "phone_is_tn",
                                    "website_is_tn", "website_is_social", "email_count"])
_scalar_query("text_shape_features", ["name_length", "address_length", "name_word_count", "address_word_count"])
_scalar_query("legal_entity_and_character_features", ["is_legal_entity", "name_has_arabic", "name_has_digits", "name_is_upper"])
_scalar_query("vertical_flags", FT.VERTICAL_FLAGS)
_scalar_query("address_flags", FT.ADDRESS_FLAGS)
_scalar_query("confidence_weights", ["positive_weight"])


@query("document_text_shape", f"""SELECT doc_id, length(text)::INTEGER AS text_length, {_words('text')} AS words, {_rx('text', X.VERTICAL_PATTERNS['hotel'])} AS hotel,
  {_rx('text', X.VERTICAL_PATTERNS['services'])} AS services, {_rx('text', '[0-9]', 'c')} AS has_digits FROM documents""")
def document_shape(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", F.length("text").alias("text_length"), X.word_count(F.col("text")).alias("words"),
                    F.when(F.col("text").rlike("(?i)" + X.VERTICAL_PATTERNS["hotel"]), 1).otherwise(0).alias("hotel"),
                    X.matches(F.col("text"), X.VERTICAL_PATTERNS["services"]).alias("services"),
                    X.matches(F.col("text"), "[0-9]", False).alias("has_digits"))


@query("numeric_coercion", """SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS DOUBLE) AS value FROM orders""")
def coercion(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 7 == 0, "n/a").when(k % 11 == 0, F.lit(None)).otherwise(k.cast("string"))
    return fx.table(spark, sf, "orders").select("o_orderkey", X.number(text).alias("value"))


@query("group_frequencies", f"""{S.FIX} SELECT biz_id, count(*) OVER (PARTITION BY coalesce(governorate, 'Unknown')) AS gov_size,
  count(*) OVER (PARTITION BY coalesce(search_category, 'Unknown')) AS search_category_size FROM businesses""")
def frequencies(spark, sf):
    b = fx.businesses(spark, sf).na.fill("Unknown", ["governorate", "search_category"])
    b = FT.group_size(FT.group_size(b, "governorate", "gov_size"), "search_category", "search_category_size")
    return b.select("biz_id", "gov_size", "search_category_size")


@query("competitor_density", f"{FEATURE_CTES} SELECT biz_id, competitor_density FROM feat0")
def density(spark, sf):
    return SP.competitor_density(FT.scalar_features(labeled(spark, sf))).select("biz_id", "competitor_density")


@query("customer_proximity", f"{FEATURE_CTES} SELECT biz_id, round(km, 6) AS customer_nearest_km, customers_within_5km FROM feat0")
def proximity(spark, sf):
    return rounded(SP.customer_proximity(labeled(spark, sf)).select("biz_id", "customer_nearest_km", "customers_within_5km"))


@query("feature_table_v1", f"{FEATURE_CTES} SELECT biz_id, {feature_sql(FT.FEATURES_V1)}, is_customer FROM feat1")
def features_v1(spark, sf):
    return rounded(FT.build_features(labeled(spark, sf), "v1"))


@query("feature_table_v2", f"{FEATURE_CTES} SELECT biz_id, {feature_sql(FT.FEATURES_V2)}, {_sel(['positive_weight'])}, is_customer FROM feat1")
def features_v2(spark, sf):
    return rounded(FT.build_features(labeled(spark, sf), "v2"))


@query("base_rate", f"{S.LABELED} SELECT count(*) AS n, sum(is_customer)::BIGINT AS positives, round(avg(is_customer), 6) AS base_rate FROM labeled")
def base_rate(spark, sf):
    return rounded(FT.base_rate(labeled(spark, sf)))


@query("feature_summary", f"""{FEATURE_CTES} SELECT min(competitor_density) AS min_value, median(competitor_density)::DOUBLE AS median_value,
  max(competitor_density) AS max_value, round(avg({_SCALARS['rating_missing']}), 6) AS rating_missing_rate FROM feat1""")
def feature_summary(spark, sf):
    f = SP.competitor_density(FT.scalar_features(labeled(spark, sf)))
    return rounded(FT.summary_stats(f))


_MEAN_COLS = ["rating", "log_reviews", "digital_presence_count", "has_website", "is_legal_entity", "addr_zone_industrielle", "rating_x_logreviews"]
_MEANS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(v) FILTER (WHERE is_customer = 0), 3) AS mean_unlabeled, round(avg(v) FILTER (WHERE is_customer = 1), 3) AS mean_positive "
    f"FROM (SELECT is_customer, ({_SCALARS[c]})::DOUBLE AS v FROM labeled) x" for c in _MEAN_COLS)


@query("feature_means_by_target", f"{S.LABELED} {_MEANS}")
def means(spark, sf):
    return FT.means_by_target(FT.scalar_features(labeled(spark, sf)), _MEAN_COLS)
