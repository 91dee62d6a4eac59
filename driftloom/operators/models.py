"""Predictors by key, what happens to their matrices, and one run from frame to metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.frame import SPLIT, TARGET, TEST, TRAIN, WEIGHT, FeatureSpec, SplitFrame
from driftloom.operators.neighbors import row_fold
from driftloom.operators.scale import finite, impute_median, zscore


@dataclass(frozen=True)
class Predictor:
    """A learner for each task; weighted says whether it takes row weights."""

    name: str
    weighted: bool = True
    most_rows: int | None = None

    def learner(self, task: str, seed: int = 0):
        from pyspark.ml import classification as C
        from pyspark.ml import regression as R

        own = {"featuresCol": "x", "labelCol": TARGET}
        if self.name == "linear":
            return C.LogisticRegression(**own, maxIter=100) if task == "classification" else R.LinearRegression(**own, regParam=1e-3, elasticNetParam=0.0)
        if self.name == "tree":
            return (C.DecisionTreeClassifier if task == "classification" else R.DecisionTreeRegressor)(**own, maxDepth=8, seed=seed)
        if self.name == "forest":
            return (C.RandomForestClassifier if task == "classification" else R.RandomForestRegressor)(**own, numTrees=200, maxDepth=8, seed=seed)
        return (C.GBTClassifier if task == "classification" else R.GBTRegressor)(**own, maxIter=300, maxDepth=5, stepSize=0.1, seed=seed)


#: Keys of the boosted libraries map to the boosted trees that Spark has.
MODELS = {
    "logreg": Predictor("linear"),
    "decision_tree": Predictor("tree"),
    "random_forest": Predictor("forest"),
    "xgboost": Predictor("boosted"),
    "lightgbm": Predictor("boosted"),
    "catboost": Predictor("boosted"),
    "lightgbm_tabarena": Predictor("boosted"),
    "lightgbm_tabarena_bag8": Predictor("boosted"),
}
#: Pretrained networks are not part of this engine; asking for one is a skip.
SKIPPED = {"tabpfn_v2": "tabpfn_skip:", "tabicl_v2": "tabicl_skip:", "tabicl_v2_ne2": "tabicl_skip:"}


def model(name: str) -> Predictor:
    if name in SKIPPED:
        raise ValueError(f"{SKIPPED[name]} pretrained networks are not available")
    return MODELS[name]


def design(frame: SplitFrame) -> DataFrame:
    """ids, split, target, weight and x: codes, numerics and features, imputed and (unless done) scaled by train."""
    from pyspark.ml.feature import VectorAssembler

    from driftloom.operators.encode import label_codes

    coded = label_codes(frame)
    columns = tuple(dict.fromkeys((*[f"{c}_code" for c in frame.spec.cat], *[c for c in frame.spec.num if c not in frame.ids], *frame.features)))
    wide = SplitFrame(finite(coded.df.withColumns({c: F.col(c).cast("double") for c in columns}), list(columns)), FeatureSpec((), columns, frame.spec.task), frame.ids)
    wide = impute_median(wide, train_only=True)
    if not frame.prescaled:
        df = zscore(wide, train_only=True, suffix="__s").df
        columns = tuple(f"{c}__s" for c in columns)
    else:
        df = wide.df
    weight = F.coalesce(F.col(WEIGHT), F.lit(1.0)) if WEIGHT in df.columns else F.lit(1.0)
    rows = VectorAssembler(inputCols=list(columns), outputCol="x").transform(df.withColumn("w", weight))
    return rows.select(*frame.ids, SPLIT, TARGET, "w", "x")


def _predict(fitted, rows: DataFrame, task: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = fitted.transform(rows)
    return out.withColumn("prediction", vector_to_array("probability")[1]) if task == "classification" else out


def fit_predict(frame: SplitFrame, name: str = "lightgbm", seed: int = 0, log_target: bool = False) -> DataFrame:
    """ids and prediction of test rows: a probability, or a value; a log target is undone."""
    rows, task = design(frame), frame.spec.task
    own = model(name)
    train = rows.where(F.col(SPLIT) == TRAIN)
    if log_target and task == "regression":
        train = train.withColumn(TARGET, F.log1p(TARGET))
    learner = own.learner(task, seed)
    if own.weighted:
        learner = learner.setWeightCol("w")
    out = _predict(learner.fit(train), rows.where(F.col(SPLIT) == TEST), task).select(*frame.ids, "prediction")
    return out.withColumn("prediction", F.expm1("prediction")) if log_target and task == "regression" else out


def out_of_fold(frame: SplitFrame, name: str = "random_forest", folds: int = 5, seed: int = 0) -> DataFrame:
    """ids and prediction: train rows by models of the other folds, test rows by one of all of train."""
    rows, task = design(frame).withColumn("fold", row_fold(frame.ids, folds)).persist(), frame.spec.task
    train, out = rows.where(F.col(SPLIT) == TRAIN), None
    for fold in [*range(folds), None]:
        fitted = model(name).learner(task, seed).fit(train if fold is None else train.where(F.col("fold") != fold))
        part = _predict(fitted, rows.where(F.col(SPLIT) == TEST) if fold is None else train.where(F.col("fold") == fold), task).select(*frame.ids, "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def skewed(frame: SplitFrame, limit: float = 3.0) -> bool:
    """Whether a regression target asks for its logarithm: skewed, and never negative."""
    r = frame.train.agg(F.skewness(TARGET).alias("s"), F.min(TARGET).alias("low")).first()
    return r["s"] is not None and r["s"] > limit and r["low"] >= 0
