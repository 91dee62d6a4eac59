"""Labels spread over the neighbour graph of both splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.frame import SPLIT, TARGET, TRAIN, SplitFrame
from driftloom.operators.lineage import cut as checkpointed
from driftloom.operators.neighbors import nearest, row_fold, space


def graph(points: DataFrame, k: int) -> DataFrame:
    """src, dst, w: the k nearest over both splits, each point its own first one, symmetric, rows sum to one."""
    near = nearest(points, k).select("id", "nid", "dist")
    own = points.select("id", F.col("id").alias("nid"), F.lit(0.0).alias("dist"))
    rank = Window.partitionBy("id").orderBy("dist", F.col("id") != F.col("nid"), "nid")
    edges = near.unionByName(own).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).persist()
    sigma = edges.where(F.col("rank") == k).agg((F.median("dist") + 1e-8).alias("sigma"))  # one row
    weighted = edges.crossJoin(F.broadcast(sigma)).select(F.col("id").alias("src"), F.col("nid").alias("dst"), F.exp(-F.col("dist") * F.col("dist") / (F.col("sigma") * F.col("sigma"))).alias("w"))
    both = weighted.unionByName(weighted.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    summed = both.groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))
    return summed.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src")))


def propagate(
    edges: DataFrame, labels: DataFrame, alpha: float = 0.5, iterations: int = 100, tolerance: float | None = 1e-4, cut: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """id, run, f after the iterations, or, run by run, before the first that changes nothing by the tolerance.

    labels: id, run, fixed (the known label, or null), start; every id has a row for every run. Runs
    (folds, classes) are columns and move together, one join and one aggregate an iteration; one that
    has stopped is kept as it is. Known rows keep the share alpha of their label. `cut` ends the lineage
    every iteration, or every fifth without tolerance; by default a checkpoint does.
    """
    cut = cut or checkpointed
    runs = sorted(r["run"] for r in labels.select("run").distinct().collect())
    cells = lambda c, name: [F.max(F.when(F.col("run") == F.lit(r), F.col(c))).alias(f"{name}{i}") for i, r in enumerate(runs)]
    state = labels.groupBy("id").agg(*cells("fixed", "k"), *cells("start", "f"))
    itself = labels.select(F.col("id").alias("src"), F.col("id").alias("dst")).distinct()  # carries what a row keeps
    edges = edges.select("src", "dst", "w", F.lit(False).alias("own")).unionByName(itself.select("src", "dst", F.lit(0.0).alias("w"), F.lit(True).alias("own")))
    edges = cut(edges.repartition("dst")).persist()  # its plan stays short, as every iteration is planned anew
    moving = list(range(len(runs)))
    for step in range(iterations):
        own = lambda c: F.max(F.when(F.col("own"), F.col(c)))
        kept = [own(f"{c}{i}").alias(f"{o}{i}") for c, o in (("k", "k"), ("f", "o")) for i in range(len(runs))]
        spread = edges.join(state.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"))
        spread = spread.agg(*kept, *[F.coalesce(F.sum(F.when(~F.col("own"), F.col("w") * F.col(f"f{i}"))), F.lit(0.0)).alias(f"s{i}") for i in moving])
        moved = {i: F.when(F.col(f"k{i}").isNotNull(), F.lit(alpha) * F.col(f"k{i}") + F.lit(1 - alpha) * F.col(f"s{i}")).otherwise(F.col(f"s{i}")) for i in moving}
        new = spread.select("id", *[f"k{i}" for i in range(len(runs))], *[f"o{i}" for i in range(len(runs))], *[moved.get(i, F.col(f"o{i}")).alias(f"f{i}") for i in range(len(runs))])
        if tolerance is not None:
            new = cut(new)
            change = new.agg(*[F.max(F.abs(F.col(f"f{i}") - F.col(f"o{i}"))).alias(f"c{i}") for i in moving]).first()
            stopped = [i for i in moving if (change[f"c{i}"] or 0.0) < tolerance]
            moving = [i for i in moving if i not in stopped]
            new = new.withColumns({f"f{i}": F.col(f"o{i}") for i in stopped})
        elif step % 5 == 4:
            new = cut(new)
        state = new.drop(*[f"o{i}" for i in range(len(runs))])
        if not moving:
            break
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.col(f"f{i}").alias("f")) for i, r in enumerate(runs)]))
    return state.select("id", each.alias("of")).select("id", "of.run", "of.f")


def label_propagation(frame: SplitFrame, k: int = 15, alpha: float = 0.5, folds: int = 5, iterations: int = 100, weighting: str = "none", threshold: float = 0.05) -> SplitFrame:
    """`label_prop_soft`: for train rows the value while their fold was unknown, for test rows the mean over folds."""
    (key,) = frame.ids
    points = space(frame, weighting=weighting, threshold=threshold)
    edges = graph(points, max(1, min(k, points.count() - 1)))
    runs = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    mean = frame.train.agg(F.avg(TARGET).alias("mean"))  # one row
    rows = frame.df.select(F.col(key).alias("id"), SPLIT, TARGET, row_fold((key,), folds).alias("fold")).crossJoin(F.broadcast(mean))
    rows = rows.withColumn("run", runs)
    known = (F.col(SPLIT) == TRAIN) & (F.col("fold") != F.col("run"))
    labels = rows.select("id", "run", F.when(known, F.col(TARGET)).alias("fixed"), F.when(known, F.col(TARGET)).otherwise(F.col("mean")).alias("start"))
    found = propagate(edges, labels, alpha, iterations).join(rows.select("id", "run", SPLIT, "fold"), ["id", "run"])
    soft = found.where((F.col(SPLIT) != TRAIN) | (F.col("fold") == F.col("run"))).groupBy("id").agg(F.avg("f").alias("label_prop_soft"))
    return frame.adding(frame.df.join(soft.withColumnRenamed("id", key), key, "left"), "label_prop_soft")
