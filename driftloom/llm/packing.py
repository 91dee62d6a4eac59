"""Batches of a token budget inside length buckets that a dynamic program chooses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import SPACE, text_of, written

#: Buckets, tokens in a batch after padding, and the multiple that boundaries have.
BUCKETS, BUDGET, MULTIPLE = 16, 65_536, 8
#: Rows of a bucket that are ranked in one task, about.
CELL_ROWS = 8192


def word_count(text_col: str) -> Column:
    """Runs of characters that are no ASCII white space."""
    return F.size(F.filter(F.split(text_of(text_col), SPACE), lambda w: w != "")).cast("long")


def candidate(length: Column, multiple: int) -> Column:
    """The smallest multiple at or above a length, at least one."""
    return (F.ceil(F.greatest(length, F.lit(1)) / F.lit(multiple)) * multiple).cast("long")


def best_boundaries(bounds: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """The boundaries, at most `buckets`, for which the padding of all rows is least.

    bounds ascend; count and total are the rows and the tokens below each bound and above the
    one before. Padding of a bucket is its bound times its rows, less its tokens; tokens are the
    same for every choice, so the padded size is minimised. best[j] is the least padded size of
    the first j candidates. A last cut i costs best[i] - rows[i] * bound, a line in the bound, and
    bounds and rows ascend, so the least line is found on a hull of lines in one ascending pass:
    time is linear in buckets and candidates, and integers keep it exact.
    """
    n = len(bounds)
    bound, rows = bounds.tolist(), [0, *np.cumsum(count, dtype=np.int64).tolist()]
    best: list[int | None] = [0] + [None] * n
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = [0] + [None] * n, [0] * (n + 1)
        hull: list[int] = []
        first = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:  # the cut after j - 1 candidates may come last from here on
                i = j - 1
                while len(hull) - first > 1:
                    a, b = hull[-2], hull[-1]
                    # b is nowhere below both a and i
                    if (best[i] - best[a]) * (rows[b] - rows[a]) > (best[b] - best[a]) * (rows[i] - rows[a]):
                        break
                    hull.pop()
                hull.append(i)
            if len(hull) == first:
                continue
            x = bound[j - 1]
            while len(hull) - first > 1 and best[hull[first + 1]] - rows[hull[first + 1]] * x < best[hull[first]] - rows[hull[first]] * x:
                first += 1
            cut[j] = hull[first]
            new[j] = best[cut[j]] + x * (rows[j] - rows[cut[j]])
        cuts.append(cut)
        best = new
    chosen, j = [], n
    for cut in reversed(cuts):
        if not j:
            break
        chosen.append(bound[j - 1])
        j = cut[j]
    return chosen[::-1]


def pack(
    rows: DataFrame, id_col: str, length_col: str, buckets: int = BUCKETS, budget: int = BUDGET, multiple: int = MULTIPLE
) -> DataFrame:
    """Assign every row to a bucket, a batch and a place in it.

    One pass gives the global histogram of candidate boundaries, every multiple that a length
    rounds up to (k different ones need multiple * k * (k - 1) / 2 tokens, so 10**13 tokens have at
    most 1.6 million); a dynamic program on the driver picks the boundaries of
    least padding. A batch of a bucket has as many rows as fit the budget at the bucket's bound,
    and one where a row alone exceeds it. Rows are ranked in cells of about CELL_ROWS, dealt by
    the hash of the id, whatever the size of a bucket.

    Defined cases: a null length counts as 0 and a negative one too; length 0 stands in the
    first bucket; ids may repeat or be null; an empty table gives no rows.
    Out: id, length, bucket, bound, batch (in the bucket, from 0), place, padding.
    """
    spark = rows.sparkSession
    length = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0))
    base = written(
        rows.select(F.col(id_col).alias("id"), length.alias("length")).withColumn("bin", candidate(F.col("length"), multiple)), "lengths"
    )
    counted = base.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).orderBy("bin").collect()
    if not counted:
        kind = base.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"{id_col} {kind}, length long, bucket int, bound long, batch long, place long, padding long")
    bins, n, total = (np.array(x, dtype=np.int64) for x in zip(*counted, strict=True))
    bounds = best_boundaries(bins, n, total, buckets)
    size = [int(n[(bins <= b) & (bins > a)].sum()) for a, b in zip([-1, *bounds], bounds, strict=False)]
    bucket = sum(((F.col("bin") > F.lit(b)).cast("int") for b in bounds), F.lit(0))
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("bucket") + 1)
    placed = base.withColumn("bucket", bucket.cast("int"))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("id"), pick([-(-s // CELL_ROWS) for s in size], "int")).cast("int"))
    order = Window.partitionBy("bucket", "cell").orderBy("id", "length")
    ranked = placed.withColumn("own", F.row_number().over(order) - 1)
    cells = placed.groupBy("bucket", "cell").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("bucket", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.col("own") + F.col("before")
    per = pick([max(1, budget // b) for b in bounds], "long")
    bound = pick(bounds, "long")
    return ranked.join(cells, ["bucket", "cell"]).select(
        F.col("id").alias(id_col),
        "length",
        "bucket",
        bound.alias("bound"),
        F.floor(rank / per).cast("long").alias("batch"),
        (rank % per).cast("long").alias("place"),
        (bound - F.col("length")).alias("padding"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Pack documents by their words; a null text has none."""
    return pack(docs.select(F.col(id_col).alias(id_col), word_count(text_col).alias("length")), id_col, "length", **options)
