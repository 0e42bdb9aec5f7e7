"""Feature tables (26 or 51 columns) from labelled businesses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadquarry.functions import features as X
from leadquarry.operators.skew import lookup_join
from leadquarry.operators.rank import exact_quantiles
from leadquarry.operators.spatial import competitor_density, customer_proximity
from leadquarry.session import cut

CATEGORICAL = ["category", "search_category", "governorate"]
VERTICAL_FLAGS = [f"vert_{v}" for v in X.VERTICAL_PATTERNS]
ADDRESS_FLAGS = [f"addr_{a}" for a in X.ADDRESS_PATTERNS]

# --- fixed values: column lists of the two feature tables ------------------------------
FEATURES_V1 = [
    "latitude", "longitude", "governorate", "category", "search_category",
    "gov_size", "category_size", "search_category_size", "competitor_density",
    "rating", "rating_missing", "reviews", "log_reviews", "has_reviews",
    "has_phone", "has_website", "has_email", "digital_presence_count",
    "phone_is_tn", "website_is_tn", "website_is_social", "email_count",
    "name_length", "address_length", "name_word_count", "address_word_count",
]
FEATURES_V2 = [
    "latitude", "longitude", "governorate", "category", "search_category",
    "gov_size", "category_size", "search_category_size", "competitor_density",
    "customer_nearest_km", "log_customer_nearest_km", "customers_within_5km", "has_customer_within_5km",
    "rating", "rating_missing", "reviews", "log_reviews", "has_reviews", "rating_x_logreviews",
    "has_phone", "has_website", "has_email", "digital_presence_count",
    "phone_is_tn", "website_is_tn", "website_is_social", "email_count",
    "is_legal_entity", "name_has_arabic", "name_has_digits", "name_is_upper",
    "name_length", "address_length", "name_word_count", "address_word_count",
    *VERTICAL_FLAGS, *ADDRESS_FLAGS,
]
MEANS_V1 = ["rating", "log_reviews", "digital_presence_count", "competitor_density", "has_website"]
MEANS_V2 = ["is_legal_entity", "customer_nearest_km", "customers_within_5km", "has_customer_within_5km",
            "vert_industrial", "vert_medical", "vert_it", "addr_zone_industrielle", "rating_x_logreviews"]
# ---------------------------------------------------------------------------------------


def scalar_features(df: DataFrame) -> DataFrame:
    """Every row-local feature in one projection; no shuffle."""
    name, address = X.filled(F.col("name")), X.filled(F.col("address"))
    text = F.concat_ws(" ", name, X.filled(F.col("category")), X.filled(F.col("search_category")))
    reviews = F.coalesce(X.number(F.col("reviews")), F.lit(0.0))
    rating = X.number(F.col("rating"))
    flags = {
        "has_phone": X.present(F.col("phone")), "has_website": X.present(F.col("website")),
        "has_email": X.present(F.col("email")),
    }
    cols = {
        "latitude": X.number(F.col("latitude")), "longitude": X.number(F.col("longitude")),
        "rating": rating, "rating_missing": X.flag(rating.isNull()),
        "reviews": reviews, "log_reviews": F.log1p(reviews), "has_reviews": X.flag(reviews > 0),
        "rating_x_logreviews": F.coalesce(rating, F.lit(0.0)) * F.log1p(reviews),
        **flags,
        "phone_is_tn": X.matches(F.col("phone"), X.PHONE_TN, False),
        "website_is_tn": X.matches(F.col("website"), X.HOST_TN, False),
        "website_is_social": X.matches(F.col("website"), X.HOST_SOCIAL),
        "email_count": X.email_count(F.col("email")),
        "digital_presence_count": flags["has_phone"] + flags["has_website"] + flags["has_email"],
        "is_legal_entity": X.matches(name, "|".join(X.LEGAL_ENTITY_PATTERNS)),
        "name_has_arabic": X.matches(name, r"[\x{600}-\x{6ff}]", False),
        "name_has_digits": X.matches(name, r"\d", False),
        "name_is_upper": X.is_upper(name),
        "name_length": F.length(name), "address_length": F.length(address),
        "name_word_count": X.word_count(name), "address_word_count": X.word_count(address),
        **{f"vert_{k}": X.matches(text, p) for k, p in X.VERTICAL_PATTERNS.items()},
        **{f"addr_{k}": X.matches(address, p) for k, p in X.ADDRESS_PATTERNS.items()},
        **{c: F.coalesce(F.col(c), F.lit("Unknown")) for c in CATEGORICAL},
    }
    if "is_customer" in df.columns:
        cols["is_customer"] = F.coalesce(X.number(F.col("is_customer")), F.lit(0.0)).cast("int")
    cols["positive_weight"] = (
        X.positive_weight(F.col("match_confidence")) if "match_confidence" in df.columns else F.lit(1.0))
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *[c.alias(n) for n, c in cols.items()])


#: Group tables up to this number of rows are sent to all tasks; larger ones are joined by shuffle.
BROADCAST_GROUPS = 200_000


def group_sizes(df: DataFrame, sizes: dict[str, str], id_col: str = "biz_id") -> DataFrame:
    """Frequencies of a row's values, for several columns (column -> name of its frequency) at once.

    All columns are counted in one pass with map-side combine.  A counted small table is sent to
    the rows; with more groups heavy values meet their rows by broadcast and only the others are
    joined by value.  A missing value has no frequency."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in sizes])).alias("x")).select("x.*")
    counts = cut(long.where(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count("*").alias("n")))
    few = counts.count() <= BROADCAST_GROUPS
    for c, out in sizes.items():
        own = counts.where(F.col("c") == c).select(F.col("v").alias("__k"), F.col("n").alias(out))
        df = df.withColumn("__k", F.col(c).cast("string"))
        if few:
            df = df.join(F.broadcast(own), "__k", "left")
        else:
            df = lookup_join(df, own, ["__k"], own.withColumnRenamed(out, "n"))
        df = df.drop("__k")
    return df


def group_size(df: DataFrame, key: str, out: str) -> DataFrame:
    """Frequency of a row's value of one column."""
    return group_sizes(df, {key: out})


def build_features(labeled: DataFrame, version: str = "v2", id_col: str = "biz_id",
                   exclude: DataFrame | None = None) -> DataFrame:
    """Feature table keyed by id: v1 = 26 columns + target, v2 = 51 + weight + target.

    Customer proximity uses every known customer, held-out ones included; pass ``exclude``
    (ids) to leave those out of the proximity features.
    """
    base = cut(scalar_features(labeled))
    df = group_sizes(base, {
        "governorate": "gov_size", "category": "category_size", "search_category": "search_category_size"}, id_col)
    df = competitor_density(df, source=base)
    if version == "v1":
        return df.select(id_col, *FEATURES_V1, "is_customer")
    if exclude is not None:
        marked = exclude.select(id_col, F.lit(1).alias("__out"))


        def known(t: DataFrame) -> DataFrame:
            return t.join(marked, id_col, "left").withColumn(
                "__known", F.when(F.col("__out").isNull(), F.col("is_customer")).otherwise(0))
        df = customer_proximity(known(df), label="__known", source=known(base)).drop("__out", "__known")
    else:
        df = customer_proximity(df, source=base)
    df = cut(df)
    median = exact_quantiles(df, "customer_nearest_km", [0.5])[0]
    df = df.withColumn("customer_nearest_km", F.coalesce("customer_nearest_km", F.lit(median).cast("double")))
    df = df.withColumn("log_customer_nearest_km", F.log1p("customer_nearest_km")).withColumn(
        "has_customer_within_5km", X.flag(F.col("customers_within_5km") > 0))
    return df.select(id_col, *FEATURES_V2, "positive_weight", "is_customer")


def model_matrix(features: DataFrame, id_col: str = "biz_id", label: str = "is_customer") -> DataFrame:
    """Features without id and target, with their weight; a missing weight column reads as 1."""
    if "positive_weight" not in features.columns:
        features = features.withColumn("positive_weight", F.lit(1.0))
    return features.drop(id_col, label)


def base_rate(features: DataFrame, label: str = "is_customer") -> DataFrame:
    return features.agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("positives"),
                        F.avg(label).alias("base_rate"))


def summary_stats(features: DataFrame, column: str = "competitor_density") -> DataFrame:
    """min / median / max of a column and the share of missing ratings.  The median comes from
    ranks, so no task holds the column."""
    median = exact_quantiles(features, column, [0.5])[0]
    return features.agg(
        F.min(column).alias("min_value"), F.lit(median).cast("double").alias("median_value"),
        F.max(column).alias("max_value"), F.avg("rating_missing").alias("rating_missing_rate"))


def means_by_target(features: DataFrame, columns: Sequence[str], label: str = "is_customer") -> DataFrame:
    """One row per feature: mean over unlabelled and over positive rows, 3 decimals."""
    agg = features.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])
    long = agg.unpivot([label], list(columns), "feature", "mean")
    return long.groupBy("feature").agg(
        F.round(F.max(F.when(F.col(label) == 0, F.col("mean"))), 3).alias("mean_unlabeled"),
        F.round(F.max(F.when(F.col(label) == 1, F.col("mean"))), 3).alias("mean_positive"))
