"""The text pipeline: quality rules, exact and near duplicates, repeated passages, packing.

Each stage works on all that its predecessor kept. Stages take (spark, docs, sf_dir); all but
the last return the columns of documents. Rows may repeat, ids may be null or name several
texts: of every group of copies exactly one row stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import SPACE, text_of, written
from driftloom.llm.exact_dedup import exact_dedup
from driftloom.llm.minhash import near_duplicates
from driftloom.llm.packing import pack_documents
from driftloom.llm.quality import VERDICT, judged
from driftloom.llm.suffix_dedup import without_repeats

#: Percent of shared 5-word shingles from which documents are near duplicates.
SIMILARITY = 80
#: Passages of so many words (over 50) that occur again are cut, however few bytes they have.
PASSAGE_WORDS = 51


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    out = judged(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.where(f"{VERDICT}.kept").select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the smallest id's, a null id's only where no other has the text."""
    own = F.sha2(F.regexp_replace(text_of("text"), SPACE, " "), 256)
    marks = written(exact_dedup(docs).where("group_size > 1").groupBy("doc_id", "text_sha256", "kept").count(), "copies_marked")
    marks = marks.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept", "count")
    signed = docs.withColumn("__own", own)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha"))
    once = signed.join(marks.where("not kept or count > 1").hint("merge"), same, "left_anti").select(docs.columns)
    repeated = marks.where("kept and count > 1")
    if repeated.isEmpty():  # the usual case, without moving the texts once more
        return once
    again = signed.join(repeated, same, "left_semi").groupBy("doc_id", "__own").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(again.select("row.*"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates one row stays: the smallest id's, a null id's only where there is no other.

    near_duplicates links ids. Where ids do not tell the rows apart (some are null or occur
    again), rows are numbered in the order of their ids, and the numbers are linked.
    """
    shared = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if shared.isEmpty():
        rows = docs.withColumn("__row", F.col("doc_id").cast("long"))
    else:
        order = F.col("doc_id").asc_nulls_last(), F.sha2(text_of("text"), 256)
        rows = written(docs.orderBy(*order).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    dropped = near_duplicates(rows, percent=SIMILARITY, id_col="__row").where("not kept").select("__row").hint("merge")
    return rows.join(dropped, "__row", "left_anti").select(docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words that occur again anywhere are cut out; every document stays."""
    return without_repeats(docs, length=PASSAGE_WORDS, words=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets a length bucket, a batch and a place."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]

#: The stages tokenise and segment in ways that SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
