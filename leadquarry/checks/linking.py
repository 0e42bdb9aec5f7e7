"""Sources, normalisers and linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadquarry import fixtures as fx
from leadquarry.checks import sqltext as S
from leadquarry.checks.registry import query
from leadquarry.functions import similarity as sim
from leadquarry.functions import text as T
from leadquarry.operators import fuzzy, linkage as L

NAME = "account_contact_name"


# ---- sources ---------------------------------------------------------------------------

@query("source_union_lineage", f"""{S.FIX} SELECT source_file, account_contact_name, phone FROM (
  SELECT 'file_1' AS source_file, account_contact_name, phone FROM purchases WHERE source_file = 'file_1'
  UNION ALL SELECT 'file_2', account_contact_name, NULL FROM purchases WHERE source_file = 'file_2') u""")
def source_union(spark, sf):
    p = fx.purchases(spark, sf)
    one = p.where("source_file = 'file_1'").select(NAME, "phone")
    two = p.where("source_file = 'file_2'").select(NAME)
    return L.union_sources([("file_1", one), ("file_2", two)], optional=("phone",)).select("source_file", NAME, "phone")


@query("null_tokens", f"{S.FIX} SELECT purchase_id, {S.sql_null('account_contact_name')} AS name, {S.sql_null('rne')} AS rne FROM purchases")
def null_tokens(spark, sf):
    return L.null_tokens_to_null(fx.purchases(spark, sf)).select("purchase_id", F.col(NAME).alias("name"), "rne")


@query("clean_purchases", f"{S.NORMED} SELECT purchase_id, pname AS name, source_file FROM p_dedup")
def clean(spark, sf):
    return L.clean_purchases(fx.purchases(spark, sf)).select("purchase_id", F.col(NAME).alias("name"), "source_file")


@query("load_report", f"""{S.NORMED} SELECT count(*) AS rows_in,
  count(*) FILTER (WHERE pname IS NULL OR {S.sql_trim('pname')} = '') AS blank,
  count(*) FILTER (WHERE {S.sql_trim('pname')} <> '') - count(DISTINCT CASE WHEN {S.sql_trim('pname')} <> '' THEN pname END) AS duplicate,
  count(DISTINCT CASE WHEN {S.sql_trim('pname')} <> '' THEN pname END) AS unique_names FROM p_all""")
def load_report(spark, sf):
    return L.load_report(fx.purchases(spark, sf))


# ---- normalisers -----------------------------------------------------------------------

@query("normalize_business_names", f"{S.NORMED} SELECT biz_id, norm, {S.sql_had_legal_from_raw('raw')} AS had_legal FROM b")
def business_names(spark, sf):
    return fx.businesses(spark, sf).select(
        "biz_id", T.normalized_name(F.col("name")).alias("norm"), T.has_legal_form(F.col("name")).alias("had_legal"))


@query("normalize_document_text", f"""SELECT doc_id, {S.sql_norm_from_raw('raw')} AS norm, {S.sql_had_legal_from_raw('raw')} AS had_legal
  FROM (SELECT doc_id, {S.sql_raw_tokens('text')} AS raw FROM documents) x""")
def document_names(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", T.normalized_name(F.col("text")).alias("norm"), T.has_legal_form(F.col("text")).alias("had_legal"))


@query("tokenize_names", f"{S.FIX} SELECT biz_id, array_to_string({S.sql_raw_tokens('name')}, '|') AS tokens FROM businesses")
def tokenize(spark, sf):
    return fx.businesses(spark, sf).select("biz_id", F.array_join(T.raw_tokens(F.col("name")), "|").alias("tokens"))


@query("normalize_phones", f"{S.FIX} SELECT biz_id, {S.sql_phone('phone')} AS phone_key FROM businesses")
def phones(spark, sf):
    return fx.businesses(spark, sf).select("biz_id", T.normalized_phone(F.col("phone")).alias("phone_key"))


@query("normalize_hosts", f"SELECT page_id, {S.sql_host('url')} AS host FROM pages")
def hosts(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", T.normalized_host(F.col("url")).alias("host"))


@query("host_counts_without_social", f"""{S.FIX} SELECT host, count(*) AS n FROM (SELECT {S.sql_host('website')} AS host FROM businesses) x
  WHERE host <> '' AND host NOT IN ({S.SOCIAL}) GROUP BY host""")
def host_counts(spark, sf):
    h = fx.businesses(spark, sf).select(T.normalized_host(F.col("website")).alias("host"))
    return h.where((F.col("host") != "") & ~T.is_social_host(F.col("host"))).groupBy("host").agg(F.count("*").alias("n"))


@query("normalize_registry_ids", f"{S.FIX} SELECT biz_id, {S.sql_rne('rne')} AS rne_key FROM businesses")
def rnes(spark, sf):
    return fx.businesses(spark, sf).select("biz_id", T.normalized_registry_id(F.col("rne")).alias("rne_key"))


# ---- score rules -----------------------------------------------------------------------

_S1 = "(o_orderkey * 7919 % 1001) / 10.0::DOUBLE"
_S2 = "greatest(0.0::DOUBLE, (o_orderkey * 7919 % 1001) / 10.0::DOUBLE - (o_orderkey % 50) / 10.0::DOUBLE)"
_AMB = "s2 > 0 AND s1 - s2 < 3 AND s1 < 95"


def _bucket_sql(certain: str) -> str:
    return (f"CASE WHEN s1 = 100 THEN '{certain}' WHEN {_AMB} THEN 'ambiguous' WHEN s1 >= 90 THEN 'high_confidence' "
            "WHEN s1 >= 78 THEN 'borderline' WHEN s1 >= 65 THEN 'weak' ELSE 'no_match' END")


@query("score_rules", f"""SELECT o_orderkey, {_AMB} AS ambiguous, {_bucket_sql('exact')} AS bucket_v2, {_bucket_sql('strong_signal')} AS bucket_v3,
  s1 >= 90 AND NOT ({_AMB}) AND s1 < 100 OR (s1 >= 82 AND s1 < 90 AND NOT ({_AMB})) AS labels,
  s1 BETWEEN 75 AND 92 AS review_needed,
  CASE WHEN s1 = 100 THEN 'exact' WHEN s1 >= 90 THEN 'high' ELSE 'borderline' END AS confidence_v2,
  CASE WHEN o_orderkey % 3 = 0 THEN 'exact' WHEN s1 >= 90 THEN 'high' ELSE 'borderline' END AS confidence_v3
  FROM (SELECT o_orderkey, {_S1} AS s1, {_S2} AS s2 FROM orders) x""")
def score_rules(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 1001 / 10.0).alias("s1"))
    s1 = F.col("s1")
    s2 = F.greatest(F.lit(0.0), s1 - F.col("o_orderkey") % 50 / 10.0)
    amb = L.is_ambiguous(s1, s2)
    certain = s1 == 100
    b2 = L.bucket(s1, certain, amb, "exact")
    reason = F.when(F.col("o_orderkey") % 3 == 0, "phone").otherwise("fuzzy_name")
    return o.select(
        "o_orderkey", amb.alias("ambiguous"), b2.alias("bucket_v2"),
        L.bucket(s1, certain, amb, "strong_signal").alias("bucket_v3"),
        L.labels_as_customer(b2, s1).alias("labels"), L.review_needed(s1).alias("review_needed"),
        L.confidence_v2(s1).alias("confidence_v2"), L.confidence_v3(s1, reason).alias("confidence_v3"))


# ---- exact axes ------------------------------------------------------------------------

def _sides(spark, sf):
    p = L.clean_purchases(fx.purchases(spark, sf)).withColumn("norm", T.normalized_name(F.col(NAME)))
    b = fx.businesses(spark, sf).withColumn("norm", T.normalized_name(F.col("name")))
    return p, b


def _axis(axis: str, column: str):
    @query(f"join_on_{axis}", f"{S.NORMED} {S.sql_axis(axis)}")
    def run(spark, sf):
        p, b = _sides(spark, sf)
        return L.exact_matches(p, b, {axis: (column, column)}).select("purchase_id", "biz_id")


for _a, _c in (("phone", "phone"), ("website", "website"), ("rne", "rne"), ("exact_name", "norm")):
    _axis(_a, _c)

ALL_AXES = {"phone": ("phone", "phone"), "website": ("website", "website"), "rne": ("rne", "rne"), "exact_name": ("norm", "norm")}


@query("axis_cascade", f"{S.CASCADE} SELECT purchase_id, biz_id, reason FROM hit")
def cascade(spark, sf):
    p, b = _sides(spark, sf)
    return L.exact_matches(p, b, ALL_AXES).select("purchase_id", "biz_id", "reason")


# ---- fuzzy -----------------------------------------------------------------------------

_PAIRS = f"""{S.NORMED}, pairs AS (SELECT DISTINCT x.norm AS a, y.norm AS c FROM (SELECT norm, biz_id + unnest([1, 200]) AS other FROM b) x JOIN b y ON y.biz_id = x.other)"""


def _pairs(spark, sf):
    """Each name beside a neighbour's and beside one that shares words: two pairs per row."""
    _, b = _sides(spark, sf)
    left = b.select("biz_id", F.col("norm").alias("a"), F.explode(F.array(F.lit(1), F.lit(200))).alias("step"))
    left = left.withColumn("other", F.col("biz_id") + F.col("step"))
    return left.join(b.select(F.col("norm").alias("c"), F.col("biz_id").alias("other")), "other").select("a", "c").distinct()


@query("indel_ratio", f"""{_PAIRS} SELECT a, c, round(100.0::DOUBLE - 100.0::DOUBLE * (length(a) + length(c) - 2 * {S.sql_lcs('a', 'c')}) / (length(a) + length(c)), 6) AS score FROM pairs""")
def indel(spark, sf):
    return _pairs(spark, sf).select("a", "c", F.round(sim.indel_ratio("a", "c"), 6).alias("score"))


@query("token_sort_ratio", f"""{_PAIRS}, s AS (SELECT a, c, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(c, ' ')), ' ') AS sb FROM pairs)
  SELECT a, c, round(100.0::DOUBLE - 100.0::DOUBLE * (length(sa) + length(sb) - 2 * {S.sql_lcs('sa', 'sb')}) / (length(sa) + length(sb)), 6) AS score FROM s""")
def token_sort(spark, sf):
    return _pairs(spark, sf).select("a", "c", F.round(sim.token_sort_ratio("a", "c"), 6).alias("score"))


_REST = "array_to_string(list_sort(list_filter(list_distinct(string_split({0}, ' ')), lambda t: NOT list_contains(string_split({1}, ' '), t))), ' ')"


@query("token_set_ratio", f"""{_PAIRS}, s AS (SELECT a, c, {_REST.format('a', 'c')} AS ra, {_REST.format('c', 'a')} AS rb,
  length(array_to_string(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(c, ' '))), ' ')) AS sh FROM pairs)
  SELECT a, c, round({S.sql_set_score('length(ra)', 'length(rb)', 'sh', S.sql_lcs('ra', 'rb'))}, 6) AS score FROM s""")
def token_set(spark, sf):
    return _pairs(spark, sf).select("a", "c", F.round(sim.token_set_ratio("a", "c"), 6).alias("score"))


@query("fuzzy_top2", f"{S.NORMED}, {S.fuzzy_ctes('p')} SELECT qn AS norm, place, round(score, 6) AS score, biz_id, match_norm FROM top")
def fuzzy_two(spark, sf):
    p, b = _sides(spark, sf)
    top = fuzzy.fuzzy_top2(p.where("norm <> ''").select("norm").distinct(), fuzzy.distinct_names(b))
    return top.select("norm", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"), "biz_id", "match_norm")


_SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"


@query("fuzzy_top1_token_sort", f"""{S.NORMED}, q AS MATERIALIZED (SELECT DISTINCT norm AS qn, {_SORTED.format('norm')} AS sa FROM p WHERE norm <> ''),
  c AS MATERIALIZED (SELECT DISTINCT norm AS cn, {_SORTED.format('norm')} AS sb FROM b WHERE norm <> ''),
  sc AS (SELECT qn, cn, 100.0::DOUBLE - 100.0::DOUBLE * (length(sa) + length(sb) - 2 * {S.sql_lcs('sa', 'sb')}) / (length(sa) + length(sb)) AS score FROM q, c)
  SELECT qn AS norm, round(score, 6) AS score, b.biz_id FROM sc JOIN b ON b.norm = sc.cn
  QUALIFY row_number() OVER (PARTITION BY qn ORDER BY score DESC, b.biz_id) = 1""")
def fuzzy_sorted(spark, sf):
    p, b = _sides(spark, sf)
    top = fuzzy.fuzzy_top2(p.where("norm <> ''").select("norm").distinct(), fuzzy.distinct_names(b), "token_sort_ratio")
    return top.where("place = 1").select("norm", F.round("score", 6).alias("score"), "biz_id")


# ---- whole linkage ---------------------------------------------------------------------

_V1 = f"""{S.NORMED}, {S.fuzzy_ctes('p')},
m AS (SELECT p.purchase_id, p.source_file, p.pname, p.norm, coalesce(t.score, 0) AS score, t.biz_id, t.match_norm FROM p LEFT JOIN top t ON t.qn = p.norm AND t.place = 1)"""
_AMB_M = "score2 > 0 AND score - score2 < 3 AND score < 95"


def _match_sql(axes, version):
    exact = "'exact'" if version == "v2" else "CASE WHEN m.reason = 'exact_name' THEN 'exact' ELSE 'strong_signal' END"
    return f"""{S.NORMED}, {S.sql_cascade(axes)}, rest AS (SELECT * FROM p WHERE purchase_id NOT IN (SELECT purchase_id FROM hit)), {S.fuzzy_ctes('rest')},
m0 AS (SELECT p.purchase_id, p.source_file, p.pname, p.norm, p.had_legal,
   CASE WHEN h.biz_id IS NOT NULL THEN 100.0::DOUBLE ELSE coalesce(t1.score, 0) END AS score,
   CASE WHEN h.biz_id IS NOT NULL THEN 0.0::DOUBLE ELSE coalesce(t2.score, 0) END AS score2,
   coalesce(h.biz_id, t1.biz_id) AS biz_id, coalesce(h.reason, CASE WHEN t1.biz_id IS NOT NULL THEN 'fuzzy_name' ELSE '' END) AS reason
   FROM p LEFT JOIN hit h USING (purchase_id) LEFT JOIN top t1 ON t1.qn = p.norm AND t1.place = 1 AND h.biz_id IS NULL
   LEFT JOIN top t2 ON t2.qn = p.norm AND t2.place = 2 AND h.biz_id IS NULL),
m AS (SELECT m.*, CASE WHEN m.biz_id IS NULL THEN 'no_match' WHEN reason NOT IN ('fuzzy_name', '') THEN {exact} WHEN {_AMB_M} THEN 'ambiguous'
   WHEN score >= 90 THEN 'high_confidence' WHEN score >= 78 THEN 'borderline' WHEN score >= 65 THEN 'weak' ELSE 'no_match' END AS bucket FROM m0 m),
lab AS (SELECT * FROM m WHERE reason NOT IN ('fuzzy_name', '') OR bucket = 'high_confidence' OR (bucket = 'borderline' AND score >= 82)),
best AS (SELECT biz_id, score, CASE WHEN reason = 'fuzzy_name' THEN 'fuzzy_' || bucket ELSE reason END AS r FROM lab
   QUALIFY row_number() OVER (PARTITION BY biz_id ORDER BY score DESC, source_file, purchase_id) = 1)"""


_V2 = _match_sql(["exact_name"], "v2")
_V3 = _match_sql(["phone", "website", "rne", "exact_name"], "v3")


def _link(spark, sf, version):
    return L.link(fx.purchases(spark, sf), fx.businesses(spark, sf), L.LinkageOptions(version=version))


@query("link_v1_review", f"""{_V1} SELECT m.purchase_id, pname AS purchase_name, m.norm AS purchase_norm, b.name AS map_name, match_norm AS map_norm,
  round(score, 6) AS score, m.biz_id, score BETWEEN 75 AND 92 AS review_needed FROM m LEFT JOIN b ON b.biz_id = m.biz_id""")
def link_v1_review(spark, sf):
    return _link(spark, sf, "v1").review.withColumn("score", F.round("score", 6))


@query("link_v1_labels", f"{_V1} SELECT b.biz_id, CASE WHEN l.biz_id IS NULL THEN 0 ELSE 1 END AS is_customer FROM b LEFT JOIN (SELECT DISTINCT biz_id FROM m WHERE score >= 85) l ON l.biz_id = b.biz_id")
def link_v1_labels(spark, sf):
    return _link(spark, sf, "v1").labeled.select("biz_id", "is_customer")


@query("link_v1_summary", f"""{_V1} SELECT count(*) FILTER (WHERE score >= 85) AS n_matched, count(*) FILTER (WHERE score BETWEEN 75 AND 92) AS n_review,
  count(*) FILTER (WHERE score < 75) AS n_nomatch, count(DISTINCT biz_id) FILTER (WHERE score >= 85) AS n_labeled FROM m""")
def link_v1_summary(spark, sf):
    r = _link(spark, sf, "v1")
    return L.summary_v1(r.review, r.labeled)


@query("link_v2_review", f"""{_V2} SELECT m.purchase_id, pname AS purchase_name, m.norm AS purchase_norm, b.name AS map_name, b.norm AS map_norm,
  round(score, 6) AS score, round(score2, 6) AS score2, m.biz_id, bucket, had_legal AS had_legal_form FROM m LEFT JOIN b ON b.biz_id = m.biz_id""")
def link_v2_review(spark, sf):
    return _link(spark, sf, "v2").review.withColumns({c: F.round(c, 6) for c in ("score", "score2")})


@query("link_v2_labels", f"""{_V2} SELECT b.biz_id, CASE WHEN t.biz_id IS NULL THEN 0 ELSE 1 END AS is_customer,
  CASE WHEN t.biz_id IS NULL THEN '' WHEN t.score = 100 THEN 'exact' WHEN t.score >= 90 THEN 'high' ELSE 'borderline' END AS match_confidence
  FROM b LEFT JOIN best t ON t.biz_id = b.biz_id""")
def link_v2_labels(spark, sf):
    return _link(spark, sf, "v2").labeled.select("biz_id", "is_customer", "match_confidence")


@query("link_v3_review", f"""{_V3} SELECT m.purchase_id, pname AS purchase_name, m.norm AS purchase_norm, b.name AS map_name,
  round(score, 6) AS score, round(score2, 6) AS score2, m.biz_id, bucket,
  CASE WHEN reason = 'fuzzy_name' THEN 'fuzzy_name(' || bucket || ')' ELSE reason END AS match_reason FROM m LEFT JOIN b ON b.biz_id = m.biz_id""")
def link_v3_review(spark, sf):
    return _link(spark, sf, "v3").review.withColumns({c: F.round(c, 6) for c in ("score", "score2")})


_CONF3 = "CASE WHEN t.biz_id IS NULL THEN '' WHEN t.r IN ('phone', 'website', 'rne', 'exact_name') THEN 'exact' WHEN t.score >= 90 THEN 'high' ELSE 'borderline' END"


@query("link_v3_labels", f"""{_V3} SELECT b.biz_id, CASE WHEN t.biz_id IS NULL THEN 0 ELSE 1 END AS is_customer, {_CONF3} AS match_confidence,
  coalesce(t.r, '') AS match_reason FROM b LEFT JOIN best t ON t.biz_id = b.biz_id""")
def link_v3_labels(spark, sf):
    return _link(spark, sf, "v3").labeled.select("biz_id", "is_customer", "match_confidence", "match_reason")


@query("link_v3_best_per_business", f"{_V3} SELECT biz_id, round(score, 6) AS best_score, r AS best_reason FROM best")
def link_v3_best(spark, sf):
    r = _link(spark, sf, "v3")
    return L.best_per_business(r.matches, L.LinkageOptions()).withColumn("best_score", F.round("best_score", 6))


@query("link_v3_bucket_counts", f"{_V3} SELECT bucket, count(*) AS n FROM m GROUP BY bucket")
def link_v3_buckets(spark, sf):
    return L.value_counts(_link(spark, sf, "v3").review, "bucket")


@query("link_v3_reason_counts", f"{_V3} SELECT coalesce(t.r, '') AS match_reason, count(*) AS n FROM b LEFT JOIN best t ON t.biz_id = b.biz_id GROUP BY 1")
def link_v3_reasons(spark, sf):
    return L.value_counts(_link(spark, sf, "v3").labeled, "match_reason")


@query("coverage_by_governorate", f"""{_V3} SELECT governorate, count(*) AS n, count(t.biz_id) AS customers, round(count(t.biz_id) / count(*)::DOUBLE, 6) AS share
  FROM b LEFT JOIN best t ON t.biz_id = b.biz_id GROUP BY governorate""")
def coverage(spark, sf):
    return L.coverage_by(_link(spark, sf, "v3").labeled).withColumn("share", F.round("share", 6))
