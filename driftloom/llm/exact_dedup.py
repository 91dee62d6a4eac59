"""Exact deduplication by a 128-bit content hash, with the bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import SPACE, text_of, written

#: Members of a group that one copy of the representative's text is compared with.
GROUP_SLICE = 2000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mark the copies of every text, one row out per row in.

    Texts are equal when identical after replacing each run of white space by one space.
    Rows are grouped by the MD5 (128 bits) of the normalised text; only the hash, the smallest
    id and a count move for the grouping, combined before the shuffle. The texts of groups of
    two or more are then compared byte for byte with the representative's: a group is cut in
    slices of GROUP_SLICE members, each joined to its own copy of the representative, so that
    a group that holds a third of all rows is spread. Rows that differ (a collision) are
    grouped again by the text itself.

    Defined cases: a null text counts as empty, so null and empty texts are copies of each
    other. A null id is never the smallest while another id is there. A row repeated with the
    same id is the same document: both rows get the same result. An empty table gives none.
    Extra columns are ignored. Out: id, keep_id, group_size, kept, text_sha256.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(text_of(text_col), SPACE, " ").alias("norm"))
    signed = written(base.select("doc_id", F.md5("norm").alias("h"), F.sha2("norm", 256).alias("text_sha256")), "hashes")
    groups = signed.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # aggregates are written before they are joined, so that adaptive execution may split a hot group;
    # groups may be as many as rows, so they are never broadcast
    groups = written(groups, "groups")
    copied = groups.where("group_size > 1")
    texts = written(base.withColumn("h", F.md5("norm")).join(copied.hint("merge"), "h").select("h", "doc_id", "norm", "keep_id", "group_size"), "copies")
    slices = F.ceil(F.col("group_size") / F.lit(GROUP_SLICE)).cast("int")
    first = (
        texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("h", "group_size")
        .agg(F.min("norm").alias("first_norm"))
        .select("h", "first_norm", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    )
    # rows of one id (a null one, say) are dealt out as well
    member = texts.withColumn("slice", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), slices).cast("int"))
    collided = (
        member.join(first, ["h", "slice"])
        .where(F.col("norm") != F.col("first_norm"))
        .groupBy("h", "norm")
        .agg(F.min("doc_id").alias("own_keep"), F.count(F.lit(1)).alias("own_size"))
    )
    apart = written(collided.select("h", F.sha2("norm", 256).alias("text_sha256"), "own_keep", "own_size"), "collisions")
    keep = F.col("keep_id")
    if apart.isEmpty():  # no two different texts share a hash
        out = signed.join(groups.hint("merge"), "h")
    else:
        lost = apart.groupBy("h").agg(F.sum("own_size").alias("lost"))
        fixed = groups.join(lost, "h", "left").select("h", "keep_id", (F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("size"))
        out = signed.join(fixed, "h").join(apart, ["h", "text_sha256"], "left")
        out, keep = out.withColumn("group_size", F.coalesce("own_size", "size")), F.coalesce("own_keep", "keep_id")
    return out.select(
        F.col("doc_id").alias(id_col),
        keep.alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
