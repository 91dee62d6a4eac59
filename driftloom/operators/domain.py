"""Models that tell the splits apart, the weights they give, and training on confident test rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.frame import ROLE, SPLIT, SRC_ID, SRC_SPLIT, TARGET, TEST, TRAIN, WEIGHT, SplitFrame
from driftloom.operators.encode import label_codes
from driftloom.operators.lineage import cut
from driftloom.operators.neighbors import row_fold
from driftloom.operators.scale import finite, impute_median


def _learner(kind: str, label: str, seed: int, depth: int = 4, trees: int = 100):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    if kind == "logreg":
        return LogisticRegression(featuresCol="x", labelCol=label, standardization=True, maxIter=100)
    if kind == "rf":
        return RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return GBTClassifier(featuresCol="x", labelCol=label, maxDepth=depth, maxIter=trees, stepSize=0.1, seed=seed)


def matrix(frame: SplitFrame) -> DataFrame:
    """The ids, split, target and the vector x of label codes and imputed numerics."""
    from pyspark.ml.feature import VectorAssembler

    coded = label_codes(impute_median(frame) if frame.spec.num else frame)
    columns = [*[f"{c}_code" for c in frame.spec.cat], *frame.spec.num]
    rows = finite(coded.df.select(*frame.ids, SPLIT, TARGET, *[F.col(c).cast("double").alias(c) for c in columns if c not in frame.ids]), [c for c in columns if c not in frame.ids])
    return VectorAssembler(inputCols=columns, outputCol="x").transform(rows)


def _calibrated(scored: DataFrame, fitted: DataFrame, how: str | None) -> DataFrame:
    """Scores mapped by a monotone or logistic fit of the label on other folds' scores."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    if how is None:
        return scored
    if how == "isotonic":
        model = IsotonicRegression(featuresCol="p", labelCol="y").fit(fitted.select("p", "y"))
        return model.transform(scored).withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction")
    logit = F.ln((F.col("p") + 1e-6) / (1 - F.col("p") + 1e-6))
    pack = VectorAssembler(inputCols=["logit"], outputCol="z")
    model = LogisticRegression(featuresCol="z", labelCol="y").fit(pack.transform(fitted.withColumn("logit", logit)))
    out = model.transform(pack.transform(scored.withColumn("logit", logit)))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("logit", "z", "rawPrediction", "probability", "prediction")


def domain_scores(frame: SplitFrame, classifier: str = "lgbm", folds: int = 5, seed: int = 0, calibrate: str | None = None) -> DataFrame:
    """The ids, split and domain_score: the probability of test from models of the other folds.

    Folds are hashes of the ids, so a repeated task gives the same ones.
    """
    from pyspark.ml.functions import vector_to_array

    rows = matrix(frame).withColumn("y", (F.col(SPLIT) == TEST).cast("double")).withColumn("fold", row_fold(frame.ids, folds)).persist()
    raw = None
    for fold in range(folds):
        model = _learner(classifier, "y", seed + fold).fit(rows.where(F.col("fold") != fold))
        own = model.transform(rows.where(F.col("fold") == fold)).withColumn("p", vector_to_array("probability")[1])
        own = own.drop("rawPrediction", "probability", "prediction", "x")
        raw = own if raw is None else raw.unionByName(own)
    parts = raw
    if calibrate:  # each fold by a fit on the out-of-fold scores of the others
        raw, parts = cut(raw), None
        for fold in range(folds):
            own = _calibrated(raw.where(F.col("fold") == fold), raw.where(F.col("fold") != fold), calibrate)
            parts = own if parts is None else parts.unionByName(own)
    parts = parts.select(*frame.ids, F.col(SPLIT).alias("split"), F.col("p").alias("domain_score"))
    return parts


def separation(scores: DataFrame) -> tuple[float, float]:
    """Accuracy at one half, and the proxy A-distance."""
    accuracy = scores.agg(F.avg(((F.col("domain_score") >= 0.5) == (F.col("split") == TEST)).cast("double"))).first()[0]
    return accuracy, max(0.0, 2.0 * (1.0 - 2.0 * (1.0 - accuracy)))


def raw_weight(score: Column, kind: str = "ratio") -> Column:
    return score / (1 - score + 1e-8) if kind == "ratio" else score


def clipped(rows: DataFrame, weight: str, strategy: str = "hard", low: float = 0.1, high: float = 10.0, share: float = 0.05) -> DataFrame:
    """The weight column bounded: to limits, to a sum of the row count, or to its quantiles."""
    if strategy == "hard":
        return rows.withColumn(weight, F.greatest(F.lit(low), F.least(F.lit(high), F.col(weight))))
    if strategy in ("normalize", "softmax"):
        total = rows.agg(F.sum(weight).alias("__t"), F.count(weight).alias("__n"))  # one row
        value = F.when(F.col("__t") < 1e-10, 1.0).otherwise(F.try_divide(F.col(weight), F.col("__t")) * F.col("__n"))
        return rows.crossJoin(F.broadcast(total)).withColumn(weight, value).drop("__t", "__n")
    if strategy == "winsorize":
        ends = rows.agg(F.expr(f"percentile(`{weight}`, array({share}D, {1 - share}D))").alias("__e"))  # one row
        value = F.greatest(F.col("__e")[0], F.least(F.col("__e")[1], F.col(weight)))
        return rows.crossJoin(F.broadcast(ends)).withColumn(weight, value).drop("__e")
    raise ValueError(f"unknown strategy {strategy!r}")


def effective_size(rows: DataFrame, weight: str) -> DataFrame:
    """ess and its ratio to the rows."""
    ess = F.sum(weight) * F.sum(weight) / F.sum(F.col(weight) * F.col(weight))
    return rows.agg(ess.alias("ess"), (ess / F.count(weight)).alias("ess_ratio"))


def adversarial(
    frame: SplitFrame,
    classifier: str = "lgbm",
    return_as: str = "both",
    weight_type: str = "ratio",
    clip: str = "hard",
    calibrate: str | None = None,
    tempering: str | float | None = None,
    pad_max: float = 2.0,
    folds: int = 5,
) -> SplitFrame:
    """The domain score as a feature, as the weight of train rows, or as both."""
    scores = domain_scores(frame, classifier, folds, calibrate=calibrate).persist()
    df = frame.df.join(scores.drop("split"), list(frame.ids), "left")
    names = ["domain_score"] if return_as in ("feature", "both") else []
    if return_as in ("weight", "both"):
        train = df.where(F.col(SPLIT) == TRAIN).withColumn(WEIGHT, raw_weight(F.col("domain_score"), weight_type))
        train = clipped(train, WEIGHT, clip)
        if tempering is not None:
            a = min(separation(scores)[1] / pad_max, 1.0) if tempering == "pad" and pad_max > 0 else 1.0 if tempering == "pad" else float(tempering)
            train = train.withColumn(WEIGHT, F.lit(1 - a) + F.lit(a) * F.col(WEIGHT))
        df = train.unionByName(df.where(F.col(SPLIT) != TRAIN).withColumn(WEIGHT, F.lit(None).cast("double")))
    return frame.adding(df, *names)


def pseudo_label(
    frame: SplitFrame, confidence: float = 0.9, rounds: int = 3, weight: float = 0.5, classifier: str = "lgbm", calibrate: str | None = None, weight_mode: str = "fixed", seed: int = 0
) -> SplitFrame:
    """Test rows that a model is sure of join train with their predicted label, round by round.

    Weights are fixed, or grow with the confidence (proportional, quadratic). Binary labels.
    """
    from pyspark.ml.functions import vector_to_array

    if frame.spec.task != "classification":
        raise ValueError("pseudo_label_skip: needs a classification task")
    rows = matrix(frame).persist()
    train = rows.where(F.col(SPLIT) == TRAIN).withColumn("w", F.lit(1.0))
    left = rows.where(F.col(SPLIT) == TEST)
    accepted = None
    for turn in range(rounds):
        model = _learner(classifier, TARGET, seed + turn, depth=6, trees=30).setWeightCol("w").fit(train.select("x", TARGET, "w"))
        score = lambda df: model.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")  # noqa: B023, E731
        scored = score(left)
        if calibrate:
            scored = _calibrated(scored, score(train).withColumn("y", F.col(TARGET)), calibrate)
        sure = F.greatest("p", 1 - F.col("p"))
        scale = {"fixed": F.lit(1.0), "proportional": (sure - 0.5) / 0.5 * 2, "quadratic": F.pow((sure - 0.5) / 0.5, F.lit(2)) * 2}[weight_mode]
        new = scored.where(sure >= confidence).withColumn("w", scale * weight)
        new = cut(new.withColumn(TARGET, (F.col("p") >= 0.5).cast("double")).drop("p"))
        if not new.head(1):
            break
        accepted = new if accepted is None else accepted.unionByName(new)
        train = train.unionByName(new.select(train.columns))
        left = left.join(new.select(*frame.ids), list(frame.ids), "left_anti")
    (key,) = frame.ids
    old = frame.df.withColumns({WEIGHT: F.when(F.col(SPLIT) == TRAIN, 1.0), SRC_SPLIT: F.col(SPLIT), SRC_ID: F.col(key), ROLE: F.lit("original")})
    if accepted is None:
        return frame.adding(old)
    found = accepted.select(key, F.col(TARGET).alias("__label"), F.col("w").alias("__w"))
    added = frame.test.join(found, key).withColumns({TARGET: F.col("__label"), SPLIT: F.lit(TRAIN), WEIGHT: F.col("__w"), SRC_SPLIT: F.lit(TEST), SRC_ID: F.col(key), ROLE: F.lit("pseudo_label")})
    return frame.adding(old.unionByName(added.select(old.columns)))


def domain_auc(frame: SplitFrame, classifier: str = "lgbm", folds: int = 5) -> float:
    """The area under the curve of the domain score, ties counted half."""
    from driftloom.functions.metrics import auc

    scores = domain_scores(frame, classifier, folds).select((F.col("split") == TEST).cast("double").alias("y"), F.col("domain_score").alias("p"))
    return auc(scores, "y", "p").first()[0]
