"""Two-sample statistics as DataFrames, and the tails of their distributions as driver scalars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.frame import SPLIT, TRAIN, SplitFrame, melt_levels, melt_numbers
from driftloom.operators.running import running


def chi2_tail(spark: SparkSession, statistic: float, df: int) -> float:
    """P(X >= statistic) by the mathematics library that Spark ships."""
    if df < 1:
        return 1.0
    law = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(df))
    return 1.0 - law.cumulativeProbability(float(statistic))


def ks_tail(distance: float, n: int, m: int) -> float:
    """The asymptotic two-sided Kolmogorov tail, with the usual small-sample correction."""
    if min(n, m) < 2:
        return 1.0
    root = math.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * distance
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def chi2_statistic(counts: DataFrame) -> DataFrame:
    """column, statistic, df, n from n_train, n_test by level; corrected for continuity at one degree."""
    used = counts.where("n_train + n_test > 0")
    w = Window.partitionBy("column")
    total = used.withColumns({"a": F.sum("n_train").over(w), "b": F.sum("n_test").over(w), "k": F.count(F.lit(1)).over(w)})
    n = F.col("a") + F.col("b")
    both = F.col("n_train") + F.col("n_test")
    terms = []
    for seen, side in (("n_train", "a"), ("n_test", "b")):
        expected = F.col(side) * both / n
        gap = F.abs(F.col(seen) - expected)
        gap = F.when(F.col("k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        terms.append(F.coalesce(F.try_divide(gap * gap, expected), F.lit(0.0)))
    return total.withColumn("term", terms[0] + terms[1]).groupBy("column").agg(
        F.when(F.max("k") > 1, F.sum("term")).otherwise(0.0).alias("statistic"),
        (F.max("k") - 1).alias("df"),
        F.max(n).alias("n"),
    )


def split_counts(frame: SplitFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """column, value, n_train, n_test of the categoricals."""
    return melt_levels(frame, columns).groupBy("column", "value").agg(
        F.count(F.when(F.col(SPLIT) == TRAIN, 1)).alias("n_train"), F.count(F.when(F.col(SPLIT) != TRAIN, 1)).alias("n_test")
    )


def chi2_normalised(counts: DataFrame) -> DataFrame:
    """column, score: the uncorrected statistic per degree of freedom."""
    w = Window.partitionBy("column")
    total = counts.withColumns({"a": F.sum("n_train").over(w), "b": F.sum("n_test").over(w), "k": F.count(F.lit(1)).over(w)})
    both = F.col("n_train") + F.col("n_test")
    term = lambda seen, side: F.coalesce(
        F.try_divide(F.pow(F.col(seen) - F.col(side) * both / (F.col("a") + F.col("b")), F.lit(2)), F.col(side) * both / (F.col("a") + F.col("b"))),
        F.lit(0.0),
    )
    return total.groupBy("column").agg((F.sum(term("n_train", "a") + term("n_test", "b")) / F.greatest(F.max("k") - 1, F.lit(1))).alias("score"))


def cramers_v(counts: DataFrame) -> DataFrame:
    """column, cramers_v in 0 to 1; with two splits the smaller dimension less one is one."""
    return chi2_statistic(counts).select(
        "column", F.when(F.col("df") >= 1, F.least(F.lit(1.0), F.sqrt(F.col("statistic") / F.col("n")))).otherwise(0.0).alias("cramers_v")
    )


def divergence(counts: DataFrame) -> DataFrame:
    """column, js (nats), tv between the shares of levels in train and test."""
    w = Window.partitionBy("column")
    shares = counts.withColumns({"p": F.try_divide("n_train", F.sum("n_train").over(w)), "q": F.try_divide("n_test", F.sum("n_test").over(w))}).withColumn(
        "m", (F.col("p") + F.col("q")) / 2
    )
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / F.col("m"))).otherwise(0.0)
    return shares.groupBy("column").agg(
        ((F.sum(part("p")) + F.sum(part("q"))) / 2).alias("js"), (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv")
    )


def ecdf(frame: SplitFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """column, value, gap: the empirical distributions' difference at each distinct value.

    Counts by value are summed first, then run along ranges of values; no task sorts a whole column.
    """
    counts = melt_numbers(frame, columns).groupBy("column", "value").agg(
        F.count(F.when(F.col(SPLIT) == TRAIN, 1)).alias("a"), F.count(F.when(F.col(SPLIT) != TRAIN, 1)).alias("b")
    )
    summed = running(counts, ["column"], "value", ["a", "b"])
    return summed.select(
        "column",
        "value",
        F.col("all_a").alias("n_train"),
        F.col("all_b").alias("n_test"),
        (F.try_divide(F.col("before_a") + F.col("a"), F.col("all_a")) - F.try_divide(F.col("before_b") + F.col("b"), F.col("all_b"))).alias("gap"),
        "next",
    )


def ks(frame: SplitFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """column, ks, wasserstein, n_train, n_test; a split of fewer than two values gives ks 0."""
    return ecdf(frame, columns).groupBy("column").agg(
        F.when((F.max("n_train") >= 2) & (F.max("n_test") >= 2), F.max(F.abs("gap"))).otherwise(0.0).alias("ks"),
        F.coalesce(F.sum(F.abs("gap") * (F.col("next") - F.col("value"))), F.lit(0.0)).alias("wasserstein"),
        F.max("n_train").alias("n_train"),
        F.max("n_test").alias("n_test"),
    )


def moments(frame: SplitFrame) -> DataFrame:
    """column, mean and population deviation in each split."""
    own = lambda f, flag: f(F.when(F.col(SPLIT) == TRAIN if flag else F.col(SPLIT) != TRAIN, F.col("value")))
    return melt_numbers(frame).groupBy("column").agg(
        own(F.avg, True).alias("mean_train"), own(F.avg, False).alias("mean_test"), own(F.stddev_pop, True).alias("std_train"), own(F.stddev_pop, False).alias("std_test")
    )


def shift_report(frame: SplitFrame, domain_accuracy: float | None = None, alpha: float = 0.05) -> DataFrame:
    """feature, type, distance, p_value, significant and the parts of the overall score.

    p values are scalars of the driver: one row per feature reaches it.
    """
    spark = frame.df.sparkSession
    rows, m = [], max(1, len(frame.spec.num) + len(frame.spec.cat))
    if frame.spec.num:
        for r in ks(frame).collect():
            p = ks_tail(r["ks"], r["n_train"], r["n_test"])
            rows.append((r["column"], "numeric", float(r["ks"]), float(r["wasserstein"]), float(p), p < alpha / m))
    if frame.spec.cat:
        counts = split_counts(frame)
        tail = {r["column"]: chi2_tail(spark, r["statistic"], r["df"]) for r in chi2_statistic(counts).collect()}
        for r in divergence(counts).collect():
            p = tail[r["column"]]
            rows.append((r["column"], "categorical", float(r["js"]), float(r["tv"]), float(p), p < alpha / m))
    return spark.createDataFrame(rows, "feature string, type string, distance double, second double, p_value double, significant boolean")


def overall_score(mean_ks: float | None, mean_js: float | None, accuracy: float | None) -> float:
    """The mean of the available parts, each in 0 to 1."""
    parts = []
    if mean_ks is not None:
        parts.append(min(mean_ks, 1.0))
    if mean_js is not None:
        parts.append(min(mean_js / 0.693, 1.0))
    if accuracy is not None:
        parts.append(min(max(2 * (accuracy - 0.5), 0.0), 1.0))
    return sum(parts) / len(parts) if parts else 0.0
