"""Running sums over a whole table, range-partitioned so that no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators.lineage import cut


def running(rows: DataFrame, by: list[str], order: str, sums: list[str]) -> DataFrame:
    """rows with before_<c> (the sum of c over lesser values) and all_<c> for each c, and next, the next greater value.

    rows has one row for each by and order. Rows move once, into ranges of (by, order); each range
    is summed, and the sums of the earlier ranges of its group are added. The table of ranges has
    a row for each range and group in it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, *by, order).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "__range").orderBy(order)
    ranges = ranged.groupBy(*by, "__range").agg(F.min(order).alias("__least"), *[F.sum(c).alias(f"__{c}") for c in sums])
    along = Window.partitionBy(*by).orderBy("__range")
    ranges = ranges.select(
        *by,
        "__range",
        F.lead("__least").over(along).alias("__next"),
        *[(F.sum(f"__{c}").over(along) - F.col(f"__{c}")).alias(f"__before_{c}") for c in sums],
        *[F.sum(f"__{c}").over(Window.partitionBy(*by)).alias(f"all_{c}") for c in sums],
    )
    out = ranged.withColumns({f"__own_{c}": F.sum(c).over(inside) - F.col(c) for c in sums} | {"__after": F.lead(order).over(inside)})
    out = out.join(ranges, [*by, "__range"])
    return out.select(
        *rows.columns,
        F.coalesce("__after", "__next").alias("next"),
        *[(F.col(f"__own_{c}") + F.col(f"__before_{c}")).alias(f"before_{c}") for c in sums],
        *[f"all_{c}" for c in sums],
    )
