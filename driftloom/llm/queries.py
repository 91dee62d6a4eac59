"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftloom.llm.exact_dedup import exact_dedup
from driftloom.llm.minhash import near_duplicates
from driftloom.llm.packing import pack_documents
from driftloom.llm.quality import quality
from driftloom.llm.sentencepiece_codec import codec_round_trip
from driftloom.llm.sharding import shard_by_bytes
from driftloom.llm.suffix_dedup import repeated_spans
from driftloom.llm.token_output import token_round_trip
from driftloom.llm.toxicity import toxicity
from driftloom.llm.warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(_table(spark, sf_dir, "documents")).drop("starts", "ends", "sig")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_suffix_dedup, op3_sentencepiece, op4_sharding, op5_token_output, op6_quality, op7_exact_dedup, op8_toxicity, op9_warc, op10_minhash)}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7, "op9_warc": OP9, "op10_minhash": OP10}


OP7 = r"""
WITH base AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM base
"""

OP9 = r"""
WITH base AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
)
SELECT page_id,
       CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST((3 - i % 4) * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM base
"""

OP10 = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS w
  FROM documents
),
shingles AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
),
sets AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s FROM shingles),
class AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM sets WHERE n > 0),
items AS (SELECT doc_id, n, unnest(s) AS h FROM sets WHERE doc_id IN (SELECT rep FROM class)),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM items a JOIN items b ON a.h = b.h AND a.doc_id > b.doc_id GROUP BY 1, 2
),
link AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
edge AS (SELECT a AS x, b AS y FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT DISTINCT rep AS x, rep AS y FROM class
  UNION
  SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x
),
root AS (SELECT x, min(y) AS r FROM reach GROUP BY x)
SELECT sets.doc_id, sets.n AS n_shingles, coalesce(r, sets.doc_id) AS component_id, sets.doc_id = coalesce(r, sets.doc_id) AS kept
FROM sets LEFT JOIN class USING (doc_id) LEFT JOIN root ON class.rep = root.x
"""
