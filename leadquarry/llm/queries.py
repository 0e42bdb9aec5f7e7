"""The registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadquarry.llm import decontaminate, language_model, lexical, merkle, mixing, near_dedup, pii, quality, sharding, substring_dedup, topk, toxicity, warc
from leadquarry.llm.common import table
from leadquarry.llm.labelled import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

N_SHARDS = 40


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# DuckDB: words of a text, as a list.
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op1_benchmark_decontamination")
def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_substring_dedup", rf"""
WITH w AS (SELECT doc_id, {SQL_WORDS} AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS s FROM p),
m AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN m USING (s) WHERE low < doc_id),
r AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
k AS (SELECT doc_id, words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN words ELSE
        list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]) END AS kept
      FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
""")
def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_simhash_near_dedup")
def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_source_mixing", rf"""
WITH d AS (SELECT doc_id, source, CAST(len({SQL_WORDS}) AS BIGINT) AS size,
                  CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w,
              2e0 * source_size AS cap, 1.5e0 * sum(source_size) OVER () AS budget FROM s0),
s2 AS (SELECT *, cap / w AS lim, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS nth FROM s1),
s3 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
              / sum(w) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM s2),
s4 AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(rate, nth) FROM s3 WHERE rate <= lim)) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM s4),
u AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM u),
x AS (SELECT c.source, c.h, CASE WHEN upto <= target - whole * source_size THEN 1
             WHEN upto - words <= target - whole * source_size
                  AND words - (target - whole * source_size - (upto - words)) < target - whole * source_size - (upto - words) THEN 1
             ELSE 0 END AS extra
      FROM c JOIN s5 ON c.source IS NOT DISTINCT FROM s5.source)
SELECT d.doc_id, d.size, s5.source_size, s5.target,
       CAST(d.size * (whole + CASE WHEN target > whole * source_size THEN extra ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source JOIN x ON x.source IS NOT DISTINCT FROM d.source AND x.h = d.h
""")
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_hash_tree_sharding")
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.grid(N_SHARDS), sharding.grid(N_SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


@query("op4_quality_attention")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages")


@query("op5_top_k_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64e0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def top_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_personal_data")
def personal_data_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[of(k) for k in pii.KIND_NAMES], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
                        pii.joined(F.col("spans")).alias("spans"))


@query("op8_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.with_score(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_language_model")
def language_model_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_model.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


LOWERED = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# DuckDB: unsigned CRC-32 of the decimal form of doc_id, bit by bit.
SQL_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, xor(c, b)),
    4294967295), 4294967295)"""


def _sql_leaf(text: str) -> str:
    part = "coalesce(concat(strlen(CAST({0} AS VARCHAR)), ':', CAST({0} AS VARCHAR)), '-')"
    return "sha256(concat(" + ", ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


def _sql_manifest(depth: int = 9) -> str:
    """Both trees level by level, ``depth`` levels each (8 ** 9 rows); a group with one node is carried on as it is."""
    steps = [f"""l AS (SELECT doc_id, lang, {_sql_leaf('text')} AS leaf,
       CASE WHEN crc % 3 = 0 THEN {_sql_leaf(f"translate(text, '{LOWERED[0]}', '{LOWERED[1]}')")} END AS shown
  FROM (SELECT *, CRC AS crc FROM documents)),
a0 AS (SELECT doc_id, lang AS g, leaf, coalesce(shown, leaf) AS f, '' AS proof, leaf AS node,
       row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l)"""]
    for tree, first in (("a", 0), ("b", 0)):
        for i in range(depth):
            at, nxt = f"{tree}{i}", f"{tree}{i + 1}"
            steps.append(f"""{at}n AS (SELECT DISTINCT g, pos, node, n FROM {at}),
{at}r AS (SELECT g, pos // 8 AS run, list(node ORDER BY pos) AS nodes, any_value(n) AS n FROM {at}n GROUP BY g, pos // 8),
{nxt} AS (SELECT * EXCLUDE (sib, nodes, k) REPLACE (CASE WHEN n = 1 THEN proof ELSE concat(proof, array_to_string(sib, '')) END AS proof,
              CASE WHEN n = 1 THEN f ELSE sha256(concat(array_to_string(sib[1:k], ''), f, array_to_string(sib[k + 1:], ''))) END AS f,
              CASE WHEN n = 1 THEN node ELSE sha256(array_to_string(nodes, '')) END AS node, pos // 8 AS pos, (n + 7) // 8 AS n)
          FROM (SELECT x.*, r.nodes, CAST(x.pos % 8 AS BIGINT) AS k, list_concat(r.nodes[1:x.pos % 8], r.nodes[x.pos % 8 + 2:]) AS sib
                FROM {at} x JOIN {at}r r ON r.g IS NOT DISTINCT FROM x.g AND r.run = x.pos // 8))""")
        if tree == "a":
            steps.append(f"""s AS (SELECT g, any_value(node) AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
      FROM a{depth} GROUP BY g),
b0 AS (SELECT a.doc_id, 0 AS g, a.leaf, a.f, a.proof, s.subroot AS node, s.pos, s.n, s.subroot
       FROM a{depth} a JOIN s ON s.g IS NOT DISTINCT FROM a.g)""")
    return "WITH " + ",\n".join(steps).replace("CRC AS crc", f"{SQL_CRC} AS crc") + f"""
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = node AS verified FROM b{depth}"""


@query("op11_merkle_manifest", _sql_manifest())
def manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = lambda text: merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, digest(F.translate("text", *LOWERED)))
    out = merkle.manifest(docs, digest(F.col("text")), F.col("lang"), F.col("doc_id"), lowered)
    return out.select(F.col("ord").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256"),
                      "folded_root", "verified")


TERM_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query("op12_lexical_search", rf"""
WITH dt AS (SELECT doc_id, r, unnest(regexp_extract_all(translate(text, '{LOWERED[0]}', '{LOWERED[1]}'), '{TERM_CLASS}')) AS term
            FROM (SELECT *, row_number() OVER () AS r FROM documents)),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{LOWERED[0]}', '{LOWERED[1]}'), '{TERM_CLASS}')) AS term FROM benchmark),
tf AS (SELECT doc_id, r, term, CAST(count(*) AS BIGINT) AS tf FROM dt GROUP BY ALL),
dl AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
c AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM dl),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, c GROUP BY term, big_n),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l))))) AS BIGINT) AS score
      FROM it JOIN tf USING (term) JOIN w USING (term) JOIN dl USING (r), c GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
""")
def lexical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("op13_warc_archive", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
""")
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = warc.write(pages)
    out = warc.resolved(warc.lookup(archive, pages, page_id="page_id"))
    archive.remove()  # read back by now
    return out
