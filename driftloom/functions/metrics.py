"""Metrics of predictions, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators.running import running


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """auc_roc from ranks of distinct scores: ties are counted first, ranks run along ranges of scores."""
    counts = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label)).alias("pos"), F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.lit(0).alias("one"), "s", "pos", (F.col("n") - F.col("pos")).alias("neg"))
    ranked = running(counts, ["one"], "s", ["neg"])
    area = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return ranked.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc_roc"))


def multiclass(rows: DataFrame, label: str, probabilities: str, eps: float = 2.220446049250313e-16) -> DataFrame:
    """accuracy, log_loss and auc_roc (the mean over classes, each against the rest); probabilities is an array by class."""
    size = rows.agg(F.max(F.size(probabilities))).first()[0] or 0  # one row
    p = F.col(probabilities)
    own = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.element_at(p, F.col(label).cast("int") + 1)))
    guess = F.array_position(p, F.array_max(p)) - 1
    out = rows.agg(F.avg((guess == F.col(label)).cast("double")).alias("accuracy"), (-F.avg(F.ln(own))).alias("log_loss"))
    # every class against the rest: ranks of scores run side by side
    sides = rows.select(F.col(label).alias("y"), F.posexplode(p).alias("one", "s"))
    counts = sides.groupBy("one", "s").agg(F.sum((F.col("y") == F.col("one")).cast("double")).alias("pos"), F.sum((F.col("y") != F.col("one")).cast("double")).alias("neg"))
    ranked = running(counts, ["one"], "s", ["neg"])
    area = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    per = ranked.groupBy("one").agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))
    return out.crossJoin(per.where(F.col("one") < size).agg(F.avg("auc").alias("auc_roc")))  # one row each


def classification(rows: DataFrame, label: str, probability: str, threshold: float = 0.5, eps: float = 2.220446049250313e-16) -> DataFrame:
    """accuracy, f1, log_loss and auc_roc of a binary label."""
    y, p = F.col(label), F.col(probability)
    hit = (p >= threshold).cast("double")
    bounded = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    tp, fp, fn = F.sum(hit * y), F.sum(hit * (1 - y)), F.sum((1 - hit) * y)
    out = rows.agg(
        F.avg((hit == y).cast("double")).alias("accuracy"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        (-F.avg(y * F.ln(bounded) + (1 - y) * F.ln(1 - bounded))).alias("log_loss"),
    )
    return out.crossJoin(auc(rows, label, probability))  # one row each


def macro_f1(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """The mean over classes of their F1."""
    both = rows.select(F.col(label).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("g"), (F.col(label) == F.col(predicted)).cast("int").alias("h")).unionByName(
        rows.select(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("h"))
    )
    per = both.groupBy("c").agg((2 * F.sum("h") / (F.sum("t") + F.sum("g"))).alias("f1"))
    return per.agg(F.avg("f1").alias("f1_macro"))


def regression(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """rmse, mae and r2."""
    y, gap = F.col(label), F.col(label) - F.col(predicted)
    return rows.agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), (1 - F.try_divide(F.sum(gap * gap), F.var_pop(y) * F.count(y))).alias("r2")
    )
