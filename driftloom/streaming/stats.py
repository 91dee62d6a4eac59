"""The mergeable statistics over a stream: windows with a watermark, and any method per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_levels(stream: DataFrame, time: str, columns: tuple[str, ...], window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window, column, value, n: counts of levels, from which frequencies and their ratios follow."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("value")) for c in columns])
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.select("__t", F.inline(pairs)).groupBy(F.window("__t", window).alias("window"), "column", "value").agg(F.count(F.lit(1)).alias("n"))


def windowed_moments(stream: DataFrame, time: str, group: str, column: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window, group, n, total, squares: enough for means, deviations and their shifts."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    v = F.col(column).cast("double")
    return timed.groupBy(F.window("__t", window).alias("window"), F.col(group).alias("group")).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares")
    )


def per_batch(stream: DataFrame, method: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply a method to each micro-batch and append; the batch id names the folder, so a replay overwrites its own."""

    def put(batch: DataFrame, number: int) -> None:
        method(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
