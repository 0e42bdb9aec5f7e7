"""Linking purchases to businesses on phone, host, registry id, exact and fuzzy name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadquarry.functions import text as T
from leadquarry.operators.fuzzy import distinct_names, fuzzy_top2
from leadquarry.session import cut

# --- fixed values: thresholds of the three linkage versions ----------------------------
HIGH, BORDERLINE, WEAK = 90, 78, 65
AMBIGUOUS_MARGIN, AMBIGUOUS_BELOW = 3, 95
LABEL_BORDERLINE = 82
V1_LABEL, V1_REVIEW_LOW, V1_REVIEW_HIGH = 85, 75, 92
# ---------------------------------------------------------------------------------------

# Axes in order of reliability: name, priority.
AXES = ("phone", "website", "rne", "exact_name")


# ---- loading ---------------------------------------------------------------------------

def union_sources(sources: Sequence[tuple[str, DataFrame]], name: str = "account_contact_name",
                  optional: Sequence[str] = ("phone", "website", "rne"),
                  id_col: str | None = None) -> DataFrame:
    """UNION ALL of purchase sources with lineage; absent optional columns become null."""
    out = None
    for label, df in sources:
        keep = [c for c in ([id_col] if id_col else []) + [name, *optional] if c in df.columns]
        part = df.select(*keep).withColumn("source_file", F.lit(label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def null_tokens_to_null(df: DataFrame) -> DataFrame:
    strings = {f for f, t in df.dtypes if t == "string"}
    return df.select(*[T.null_if_token(F.col(c)).alias(c) if c in strings else F.col(c) for c in df.columns])


def dedupe_keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per raw key by ``order``.  ``min`` of a struct combines before the shuffle,
    so one key holding a third of the rows is not sorted in one task."""
    rest = [c for c in df.columns if c != key and c not in order]
    first = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("__first"))
    return first.select(*[F.col(key) if c == key else F.col(f"__first.{c}").alias(c) for c in df.columns])


def clean_purchases(df: DataFrame, name: str = "account_contact_name",
                    order: Sequence[str] = ("source_file", "purchase_id")) -> DataFrame:
    """Null tokens read as null, blank names dropped, duplicates of a raw name dropped."""
    rows = null_tokens_to_null(df)
    return dedupe_keep_first(rows.where(~T.is_blank(F.col(name))), name, order)


def load_report(df: DataFrame, name: str = "account_contact_name") -> DataFrame:
    """Rows in, blank names, duplicates and unique names in one pass."""
    n = T.null_if_token(F.col(name))
    per_name = df.groupBy(F.when(~T.is_blank(n), n).alias("n")).agg(F.count("*").alias("c"))
    return per_name.agg(
        F.sum("c").alias("rows_in"),
        F.coalesce(F.sum(F.when(F.col("n").isNull(), F.col("c"))), F.lit(0)).alias("blank"),
        F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("c") - 1)), F.lit(0)).alias("duplicate"),
        F.count("n").alias("unique_names"),
    )


# ---- scores to buckets and labels ------------------------------------------------------

def is_ambiguous(s1: Column, s2: Column, floor: float | None = None) -> Column:
    """Two candidates too close to call.  ``floor`` optionally ignores hopeless scores."""
    out = (s2 > 0) & (s1 - s2 < AMBIGUOUS_MARGIN) & (s1 < AMBIGUOUS_BELOW)
    return out if floor is None else out & (s1 >= floor)


def bucket(score: Column, certain: Column, ambiguous: Column, certain_name: str) -> Column:
    return (
        F.when(certain, F.lit(certain_name)).when(ambiguous, F.lit("ambiguous"))
        .when(score >= HIGH, F.lit("high_confidence")).when(score >= BORDERLINE, F.lit("borderline"))
        .when(score >= WEAK, F.lit("weak")).otherwise(F.lit("no_match"))
    )


def labels_as_customer(bucket_name: Column, score: Column) -> Column:
    return (bucket_name == "high_confidence") | ((bucket_name == "borderline") & (score >= LABEL_BORDERLINE))


def review_needed(score: Column) -> Column:
    return score.between(V1_REVIEW_LOW, V1_REVIEW_HIGH)


def confidence_v2(score: Column) -> Column:
    """Any best score of 100, fuzzy ones included, counts as exact."""
    return F.when(score == 100, "exact").when(score >= HIGH, "high").otherwise("borderline")


def confidence_v3(score: Column, reason: Column) -> Column:
    return (
        F.when(reason.isin(*AXES), "exact").when(score >= HIGH, "high").otherwise("borderline")
    )


# ---- joins -----------------------------------------------------------------------------

def _axis_key(axis: str, c: str, build: bool) -> Column:
    if axis == "phone":
        return T.normalized_phone(F.col(c))
    if axis == "website":
        host = T.normalized_host(F.col(c))
        return F.when(~T.is_social_host(host), host).otherwise("") if build else host
    if axis == "rne":
        return T.normalized_registry_id(F.col(c))
    return F.col("norm")


def _axis_keys(df: DataFrame, columns: dict[str, str], build: bool, extra: Sequence[str]) -> DataFrame:
    """Long ``(priority, reason, key)`` rows, one per usable axis of each input row."""
    structs = [
        F.struct(F.lit(AXES.index(a) + 1).alias("priority"), F.lit(a).alias("reason"),
                 _axis_key(a, c, build).alias("key"))
        for a, c in columns.items()
    ]
    return (
        df.select(*extra, F.explode(F.array(*structs)).alias("x")).select(*extra, "x.*")
        .where(F.col("key") != "")
    )


def exact_matches(purchases: DataFrame, businesses: DataFrame, axes: dict[str, tuple[str, str]]) -> DataFrame:
    """First axis that hits, per purchase: ``purchase_id, biz_id, map_name, map_norm, reason``.

    All axes share one equi-join on ``(priority, key)``.  The business side is first reduced to
    its lowest id per key, so a key held by a third of the businesses is one row; blank keys
    never enter the join.
    """
    build = (
        _axis_keys(businesses, {a: b for a, (_, b) in axes.items()}, True, ["biz_id", "name", "norm"])
        .groupBy("priority", "key").agg(F.min(F.struct("biz_id", "name", "norm")).alias("b"))
    )
    probe = _axis_keys(purchases, {a: p for a, (p, _) in axes.items()}, False, ["purchase_id"])
    return (
        probe.join(build, ["priority", "key"])
        .groupBy("purchase_id").agg(F.min(F.struct("priority", "b", "reason")).alias("hit"))
        .select("purchase_id", F.col("hit.b.biz_id").alias("biz_id"), F.col("hit.b.name").alias("map_name"),
                F.col("hit.b.norm").alias("map_norm"), F.col("hit.reason").alias("reason"))
    )


@dataclass
class LinkageOptions:
    """One engine, three presets.  ``axes`` maps an axis to (purchase column, business column);
    an axis whose column is missing on either side is switched off."""

    version: str = "v3"
    name: str = "account_contact_name"
    scorer: str = "token_set_ratio"
    axes: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "phone": ("phone", "phone"), "website": ("website", "website"), "rne": ("rne", "rne")})
    ambiguous_floor: float | None = None

    def usable_axes(self, purchases: DataFrame, businesses: DataFrame) -> dict[str, tuple[str, str]]:
        used = {}
        if self.version == "v3":
            used = {a: pc for a, pc in self.axes.items()
                    if pc[0] in purchases.columns and pc[1] in businesses.columns}
        if self.version != "v1":
            used["exact_name"] = ("norm", "norm")
        return used


def match_purchases(purchases: DataFrame, businesses: DataFrame, options: LinkageOptions) -> DataFrame:
    """Best match of every cleaned purchase, all versions' columns included.

    Columns: purchase_id, source_file, purchase_name, purchase_norm, had_legal_form, map_name,
    map_norm, score, score2, biz_id, reason, certain.
    """
    axes = options.usable_axes(purchases, businesses)
    p = cut(
        purchases.withColumn("norm", T.normalized_name(F.col(options.name)))
        .withColumn("had_legal_form", T.has_legal_form(F.col(options.name)))
    )
    b = businesses.withColumn("norm", T.normalized_name(F.col("name")))
    head = p.select("purchase_id", "source_file", F.col(options.name).alias("purchase_name"),
                    F.col("norm").alias("purchase_norm"), "had_legal_form")
    if axes:
        exact = cut(exact_matches(p, b, axes).withColumn("score", F.lit(100.0))
                    .withColumn("score2", F.lit(0.0)).withColumn("certain", F.lit(True)))
        rest = p.join(exact, "purchase_id", "left_anti")
    else:
        exact, rest = None, p
    rest = rest.where("norm <> ''")
    top2 = fuzzy_top2(rest.select("norm").distinct(), distinct_names(b), options.scorer)
    best = top2.groupBy("norm").agg(
        F.max(F.when(F.col("place") == 1, F.struct("score", "biz_id", "match_norm"))).alias("m"),
        F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0)).alias("score2"),
    )
    fuzzy = (
        rest.select("purchase_id", "norm").join(best, "norm")
        .select("purchase_id", F.col("m.biz_id").alias("biz_id"), F.col("m.match_norm").alias("map_norm"),
                F.lit("fuzzy_name").alias("reason"), F.col("m.score").alias("score"), "score2",
                F.lit(False).alias("certain"))
    )
    # only matched ids need their display name: reduce to those before touching the wide table
    named = businesses.join(fuzzy.select("biz_id").distinct(), "biz_id", "left_semi").select(
        "biz_id", F.col("name").alias("map_name"))
    fuzzy = fuzzy.join(named, "biz_id")
    hits = fuzzy if exact is None else exact.unionByName(fuzzy)
    out = head.join(hits, "purchase_id", "left")
    return out.select(
        "purchase_id", "source_file", "purchase_name", "purchase_norm", "had_legal_form", "map_name",
        "map_norm", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("score2", F.lit(0.0)).alias("score2"), "biz_id",
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce("certain", F.lit(False)).alias("certain"),
    )


def review_table(matches: DataFrame, options: LinkageOptions) -> DataFrame:
    """The review file of a version (sort it by score at the sink)."""
    hit = F.col("biz_id").isNotNull()
    base = ["purchase_id", "purchase_name", "purchase_norm", "map_name"]
    if options.version == "v1":
        return matches.select(*base, "map_norm", "score", "biz_id",
                              review_needed(F.col("score")).alias("review_needed"))
    amb = ~F.col("certain") & is_ambiguous(F.col("score"), F.col("score2"), options.ambiguous_floor)
    if options.version == "v2":
        b = bucket(F.col("score"), F.col("certain"), amb, "exact")
        return matches.select(*base, "map_norm", "score", "score2", "biz_id",
                              F.when(hit, b).otherwise("no_match").alias("bucket"), "had_legal_form")
    name_exact = F.col("reason") == "exact_name"
    b = F.when(name_exact, "exact").otherwise(bucket(F.col("score"), F.col("certain"), amb, "strong_signal"))
    b = F.when(hit, b).otherwise("no_match")
    reason = F.when(F.col("reason") == "fuzzy_name", F.concat(F.lit("fuzzy_name("), b, F.lit(")")))
    return matches.select(*base, "score", "score2", "biz_id", b.alias("bucket"),
                          reason.otherwise(F.col("reason")).alias("match_reason"))


def best_per_business(matches: DataFrame, options: LinkageOptions) -> DataFrame:
    """Labelling matches reduced to one row per business: score and reason.

    Equal scores keep the purchase that comes first in input order.
    """
    score = F.col("score")
    if options.version == "v1":
        rows = matches.where(score >= V1_LABEL).withColumn("r", F.lit(""))
    else:
        amb = is_ambiguous(score, F.col("score2"), options.ambiguous_floor)
        b = bucket(score, F.lit(False), amb, "")
        rows = matches.where(F.col("certain") | labels_as_customer(b, score)).withColumn(
            "r", F.when(F.col("certain"), F.col("reason")).otherwise(F.concat(F.lit("fuzzy_"), b)))
    rows = rows.where(F.col("biz_id").isNotNull())
    best = rows.groupBy("biz_id").agg(
        F.min(F.struct((-score).alias("neg"), "source_file", "purchase_id", "r")).alias("m"))
    return best.select("biz_id", (-F.col("m.neg")).alias("best_score"), F.col("m.r").alias("best_reason"))


def write_back(businesses: DataFrame, best: DataFrame, options: LinkageOptions) -> DataFrame:
    """Businesses with ``is_customer`` and, by version, confidence and reason."""
    out = businesses.join(best, "biz_id", "left")
    hit = F.col("best_score").isNotNull()
    out = out.withColumn("is_customer", hit.cast("int"))
    if options.version != "v1":
        conf = (confidence_v2(F.col("best_score")) if options.version == "v2"
                else confidence_v3(F.col("best_score"), F.col("best_reason")))
        out = out.withColumn("match_confidence", F.when(hit, conf).otherwise(""))
    if options.version == "v3":
        out = out.withColumn("match_reason", F.coalesce("best_reason", F.lit("")))
    return out.drop("best_score", "best_reason")


@dataclass
class Linkage:
    matches: DataFrame
    review: DataFrame
    labeled: DataFrame


def link(purchases: DataFrame, businesses: DataFrame, options: LinkageOptions | None = None) -> Linkage:
    """The whole stage: cleaned purchases in, review table and labelled businesses out."""
    options = options or LinkageOptions()
    matches = cut(match_purchases(clean_purchases(purchases, options.name), businesses, options))
    return Linkage(
        matches=matches,
        review=review_table(matches, options),
        labeled=write_back(businesses, best_per_business(matches, options), options),
    )


# ---- summaries -------------------------------------------------------------------------

def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def summary_v1(review: DataFrame, labeled: DataFrame) -> DataFrame:
    """Matched purchases, review band, no-match counts and labelled businesses (one row)."""
    r = review.agg(
        F.count_if(F.col("score") >= V1_LABEL).alias("n_matched"),
        F.count_if(F.col("review_needed")).alias("n_review"),
        F.count_if(F.col("score") < V1_REVIEW_LOW).alias("n_nomatch"),
        F.lit(1).alias("one"),
    )
    pos = labeled.agg(F.sum("is_customer").alias("n_labeled"), F.lit(1).alias("one"))
    return r.join(pos, "one").drop("one")


def coverage_by(labeled: DataFrame, segment: str = "governorate") -> DataFrame:
    """Known customers and share per segment."""
    return labeled.groupBy(segment).agg(
        F.count("*").alias("n"), F.sum("is_customer").cast("long").alias("customers"),
        F.avg("is_customer").alias("share"))
