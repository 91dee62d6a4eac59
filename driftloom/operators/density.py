"""Clusters and leaves: how the splits share them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.frame import SPLIT, TEST, TRAIN, WEIGHT, SplitFrame
from driftloom.operators.lineage import written
from driftloom.operators.neighbors import leaf_distance, row_fold, space


def cluster_statistics(rows: DataFrame, purity: float = 0.05, extreme: float = 0.1) -> DataFrame:
    """cluster, cluster_relative_size, cluster_train_frac, weight; rows has cluster and split.

    The weight is test over train; a cluster of one split has 1, a mixed one of extreme share `extreme`.
    """
    counts = rows.groupBy("cluster").agg(F.count(F.when(F.col("split") == TRAIN, 1)).alias("a"), F.count(F.when(F.col("split") == TEST, 1)).alias("b"))
    total = rows.agg(F.count(F.lit(1)).alias("n"))  # one row
    share = F.col("a") / (F.col("a") + F.col("b") + 1e-10)
    ratio = F.when((F.col("a") == 0) | (F.col("b") == 0), 1.0).when((share < purity) | (share > 1 - purity), extreme).otherwise(F.try_divide("b", "a"))
    return counts.crossJoin(F.broadcast(total)).select(
        "cluster", ((F.col("a") + F.col("b")) / F.col("n")).alias("cluster_relative_size"), share.alias("cluster_train_frac"), ratio.alias("cluster_weight")
    )


def cluster_membership(frame: SplitFrame, clusters: int = 10, return_as: str = "both", weighting: str = "none", seed: int = 0, starts: int = 10) -> SplitFrame:
    """Cluster size, share of train and distance to the centre, by k-means over both splits; the best of several starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    (key,) = frame.ids
    points = space(frame, weighting=weighting).withColumn("features", array_to_vector("vec")).persist()
    n = points.count()
    k = max(2, n // 10) if n < 10 * clusters else clusters
    models = [KMeans(k=k, seed=seed + i, maxIter=50).fit(points) for i in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    rows = model.transform(points).select("id", "split", F.col("prediction").alias("cluster"), vector_to_array("features").alias("vec"))
    gap = F.zip_with("vec", F.element_at(centres, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b))
    rows = rows.withColumn("cluster_dist_to_centroid", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)))
    joined = rows.join(cluster_statistics(rows), "cluster").drop("vec", "split", "cluster").withColumnRenamed("id", key)
    df = frame.df.join(joined, key)
    names = ["cluster_relative_size"] + (["cluster_train_frac", "cluster_dist_to_centroid"] if return_as != "weight" else [])
    if return_as in ("weight", "both"):
        df = df.withColumn(WEIGHT, F.when(F.col(SPLIT) == TRAIN, F.col("cluster_weight")))
    return frame.adding(df, *names)


def leaf_confidence(leaves: DataFrame, minority: float = 0.1) -> DataFrame:
    """id, split, leaf_minority_ratio, leaf_avg_train_frac, leaf_avg_size; leaves: id, split, vec of leaf ids.

    Leaves are written first: exploding an array of many expressions keeps the planner busy without end.
    """
    leaves = written(leaves, "leaves")
    long = leaves.select("id", "split", F.posexplode("vec").alias("tree", "leaf"))
    counts = long.groupBy("tree", "leaf").agg(F.count(F.when(F.col("split") == TRAIN, 1)).alias("a"), F.count(F.lit(1)).alias("n"))
    share = F.col("a") / F.col("n")
    other = F.when(F.col("split") == TRAIN, 1 - share).otherwise(share)
    return long.join(counts, ["tree", "leaf"]).groupBy("id", "split").agg(
        F.avg((other < minority).cast("double")).alias("leaf_minority_ratio"), F.avg(share).alias("leaf_avg_train_frac"), F.avg(F.col("n").cast("double")).alias("leaf_avg_size")
    )


def leaf_density(frame: SplitFrame, mode: str = "confidence_feature", trees: int = 100, depth: int = 6, k: int = 10, folds: int = 5, seed: int = 0) -> SplitFrame:
    """Leaf features of cross-fitted forests: train rows from the fold that left them out, test rows the mean."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    from driftloom.frame import TARGET
    from driftloom.operators.encode import label_codes
    from driftloom.operators.scale import impute_median

    (key,) = frame.ids
    coded = label_codes(impute_median(frame))
    columns = [*[f"{c}_code" for c in frame.spec.cat], *frame.spec.num]
    rows = coded.df.select(F.col(key).alias("id"), F.col(SPLIT).alias("split"), TARGET, row_fold((key,), folds).alias("fold"), *[F.col(c).cast("double") for c in columns])
    rows = VectorAssembler(inputCols=columns, outputCol="x").transform(rows).persist()
    n = rows.where(F.col("split") == TRAIN).count()
    trees = 20 if n < 50 else min(trees, 50) if n < 200 else trees
    learner = RandomForestClassifier if frame.spec.task == "classification" else RandomForestRegressor
    parts = None
    for fold in range(folds):
        model = learner(featuresCol="x", labelCol=TARGET, numTrees=trees, maxDepth=min(depth, 12), seed=seed + fold, leafCol="leaves").fit(
            rows.where((F.col("split") == TRAIN) & (F.col("fold") != fold))
        )
        leaves = model.transform(rows).select("id", "split", "fold", vector_to_array("leaves").alias("vec"))
        found = leaf_confidence(leaves) if mode == "confidence_feature" else leaf_distance(leaves.select("id", "split", "vec"), k)
        own = found.join(leaves.select("id", "fold"), "id").where((F.col("split") == TEST) | (F.col("fold") == fold)).drop("fold")
        parts = own if parts is None else parts.unionByName(own)
    names = [c for c in parts.columns if c not in ("id", "split")]
    mean = parts.groupBy("id").agg(*[F.avg(c).alias(c) for c in names]).withColumnRenamed("id", key)
    return frame.adding(frame.df.join(mean, key, "left"), *names)
