"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, ngram_join, packing, pii, secrets, sharding, substrings, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chained_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of whole texts that a text with a smaller id has as well."""
    return substrings.repeats(_table(spark, sf_dir, "documents"))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of whole texts with benchmark items, substitutions tolerated."""
    return decontamination.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 under the law of equal row counts."""
    put = sharding.assign_shards(_table(spark, sf_dir, "documents"), 16)
    return put.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: fixed formats and the model's additions."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs)).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.KINDS[:4]],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


def op5_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic").alias("predicted"), "toxic_hits"
    )


def op6_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("payload", "url")


def op7_order_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of whole texts linked by 5-word shingles at a similarity of 0.8."""
    return ngram_join.classes(_table(spark, sf_dir, "documents"))


def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: fixed formats and the Markov models' additions."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs)).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
        count("markov").alias("n_markov"),
    )


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, by their number of words, in 16 buckets and batches of 16,384 words."""
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs.select("doc_id", packing.word_length().alias("length")))


def op10_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    table = _table(spark, sf_dir, "embeddings")
    index, centroids = ann.build_index(table, key="vec_id", vector="embedding")
    return ann.search(index, table.filter(F.col("vec_id") % 20 == 0), centroids, key="vec_id", vector="embedding")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_chained_seeds,
            op2_spaced_seeds,
            op3_ring_shards,
            op4_boosted_pii,
            op5_lexicon_toxicity,
            op6_zstd_warc,
            op7_order_filters,
            op8_markov_secrets,
            op9_length_buckets,
            op10_one_bit_codes,
        )
    }


_ORACLE_OP6 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31 AS BIGINT), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p
"""

_ORACLE_OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.reach)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.reach) AS component_id
FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY ALL
"""

# Exact neighbours: they equal the query's where its recall is 1.
_ORACLE_OP10 = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
u AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.v, b.v) AS score
  FROM u a JOIN u b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_zstd_warc": _ORACLE_OP6, "op7_order_filters": _ORACLE_OP7, "op10_one_bit_codes": _ORACLE_OP10}
