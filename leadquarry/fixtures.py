"""Businesses and purchases derived from the given tables.

The SQL text is shared by Spark and by the SQL checks, so both sides start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

#: Customers that are worth a task of their own: names, hosts and keys of each are worked out in it.
ROWS_PER_TASK = 20_000

# {np}, {ng}: numbers of parts and pages, literals for Spark, scalar subqueries for the check.
B0 = """
  SELECT c.c_custkey AS k, c.c_nationkey AS nk, c.c_mktsegment AS seg, n.n_name AS gov, p.p_name AS pn, p.p_type AS pt,
         g.url AS url, o.cnt AS cnt,
         translate(substr(md5(CAST(c.c_custkey AS VARCHAR(20))), 1, 8), '0123456789abcdef', 'bacedifoguhalime') AS w,
         CAST(20000000 + (c.c_custkey * 611953) % 79999999 AS VARCHAR(20)) AS ph
  FROM customer c
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN part p ON p.p_partkey = c.c_custkey % {np} + 1
  JOIN pages g ON g.page_id = c.c_custkey % {ng}
  LEFT JOIN (SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
"""

BUSINESSES = """
  SELECT k AS biz_id,
    concat(CASE WHEN k % 4 = 0 THEN replace(pn, 'e', 'é') WHEN k % 11 = 3 THEN upper(pn) ELSE pn END, ' ', w,
           CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN ' SARL' WHEN 2 THEN ' S.A.' WHEN 3 THEN ' 1482X' WHEN 4 THEN ' & Cie' ELSE ' Établissements' END) AS name,
    pt AS category,
    CASE WHEN k % 31 = 0 THEN NULL ELSE seg END AS search_category,
    CASE WHEN k % 37 = 0 THEN NULL ELSE gov END AS governorate,
    CASE WHEN k % 13 = 0 THEN NULL ELSE 33e0 + nk * 1e-1 + ((k * 7919) % 1000) / 2e4 END AS latitude,
    CASE WHEN k % 13 = 0 THEN NULL ELSE 9e0 + nk * 1e-1 + ((k * 104729) % 1000) / 2e4 END AS longitude,
    CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('+216 ', substr(ph, 1, 2), ' ', substr(ph, 3, 3), ' ', substr(ph, 6, 3))
               WHEN 2 THEN concat('00216', ph) ELSE concat('216-', ph) END AS phone,
    CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('https://www.facebook.com/', w) WHEN 2 THEN url ELSE concat('http://www.', w, '.tn/contact?x=1') END AS website,
    CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN concat(w, '@x.tn') ELSE concat(w, '@x.tn;info@', w, '.com; ') END AS email,
    CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Zone industrielle 4' WHEN 2 THEN 'Av. 12, 3 etage' WHEN 3 THEN 'Immeuble B, rue 9' WHEN 4 THEN 'Route km 5' ELSE 'Parc d''activites' END AS address,
    CASE WHEN k % 7 = 0 THEN NULL ELSE 1e0 + ((k * 31) % 41) / 1e1 END AS rating,
    CAST(cnt AS DOUBLE) AS reviews,
    CASE WHEN k % 9 = 0 THEN concat(' ', upper(w), ' ') ELSE NULL END AS rne
  FROM {b0}
"""

# {nc} is the number of customers: a literal for Spark, a scalar subquery for the check.
PURCHASES = """
  SELECT sk AS purchase_id,
    CASE sk % 11 WHEN 0 THEN concat('Société ', pn, ' ', upper(w)) WHEN 1 THEN concat(pn, ' ', substr(w, 2, 7))
                 WHEN 2 THEN concat(w, ' ', pn) WHEN 3 THEN w WHEN 4 THEN concat('zq', substr(w, 3, 4), ' xyl')
                 WHEN 5 THEN CASE WHEN sk % 2 = 0 THEN '#N/A' ELSE '12 34' END WHEN 6 THEN concat(pn, ' SARL') WHEN 7 THEN concat(pn, ' ', substr(w, 1, 5), 'zqx')
                 WHEN 8 THEN concat(pn, ' ', substr(w, 1, 4), 'zqxv') WHEN 9 THEN concat(w, ' zzqqvvx')
                 ELSE concat('Ets ', pn, ' ', w, ' 77') END AS account_contact_name,
    CASE WHEN sk % 10 = 2 THEN concat('+216', ph) ELSE NULL END AS phone,
    CASE WHEN sk % 10 = 4 THEN concat('https://', w, '.tn') ELSE NULL END AS website,
    CASE WHEN sk % 10 = 6 THEN lower(w) ELSE NULL END AS rne,
    CASE WHEN sk % 2 = 0 THEN 'file_1' ELSE 'file_2' END AS source_file
  FROM (SELECT s.s_suppkey AS sk, b.k, b.w, b.ph, b.pn
        FROM supplier s JOIN {b0} b ON b.k = (s.s_suppkey * 13 + 1) % {nc}) p0
"""

SQL_B0 = B0.format(np="(SELECT count(*) FROM part)", ng="(SELECT count(*) FROM pages)")

# The SQL side as a chain of common table expressions.
SQL_FIXTURE = (
    f"WITH b0 AS ({SQL_B0}), businesses AS ({BUSINESSES.format(b0='b0')}), "
    f"purchases AS ({PURCHASES.format(b0='b0', nc='(SELECT count(*) FROM customer)')})"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as its rows are worth: a few megabytes of Parquet are read by one task,
    and all that is worked out from the rows before the next shuffle would stay there."""
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, df.count() // ROWS_PER_TASK)
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else df


def _views(spark: SparkSession, sf_dir: str) -> None:
    for name in ("customer", "nation", "part", "pages", "orders", "supplier"):
        rows = table(spark, sf_dir, name)
        (_dealt(rows) if name == "customer" else rows).createOrReplaceTempView(name)


def _b0(spark: SparkSession, sf_dir: str) -> str:
    return B0.format(np=table(spark, sf_dir, "part").count(), ng=table(spark, sf_dir, "pages").count())


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return spark.sql(BUSINESSES.format(b0=f"({_b0(spark, sf_dir)})"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    n_customers = table(spark, sf_dir, "customer").count()
    return spark.sql(PURCHASES.format(b0=f"({_b0(spark, sf_dir)})", nc=n_customers))
