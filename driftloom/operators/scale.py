"""Imputation, scaling and projection with statistics of train or of both splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.frame import SPLIT, TRAIN, SplitFrame
from driftloom.operators.encode import label_codes


def _of(frame: SplitFrame, train_only: bool):
    keep = F.col(SPLIT) == TRAIN if train_only else F.lit(True)
    return lambda f, c: f(F.when(keep, F.col(c).cast("double")))


def impute_median(frame: SplitFrame, train_only: bool = False, columns: tuple[str, ...] | None = None) -> SplitFrame:
    """Missing numerics become the exact median; a column without values becomes 0."""
    own, columns = _of(frame, train_only), columns or frame.spec.num
    medians = frame.df.agg(*[F.coalesce(own(F.median, c), F.lit(0.0)).alias(f"__m_{c}") for c in columns])
    df = frame.df.crossJoin(F.broadcast(medians))  # one row
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")) for c in columns}).drop(*medians.columns)
    return frame.adding(df)


def zscore(frame: SplitFrame, train_only: bool = False, codes: bool = False, suffix: str = "_z", columns: tuple[str, ...] | None = None) -> SplitFrame:
    """`{c}_z` by mean and population deviation, of train or of both; without spread the scale is 1.

    With codes, the label codes of the categoricals are scaled too and none is declared.
    """
    if codes:
        frame = label_codes(frame, train_only)
    columns = columns or (tuple(f"{c}_code" for c in frame.spec.cat) if codes else ()) + frame.spec.num
    own = _of(frame, train_only)
    stats = frame.df.agg(*[own(F.avg, c).alias(f"__a_{c}") for c in columns], *[own(F.stddev_pop, c).alias(f"__s_{c}") for c in columns])
    df = frame.df.crossJoin(F.broadcast(stats))  # one row
    scale = lambda c: F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
    df = df.withColumns({f"{c}{suffix}": (F.col(c).cast("double") - F.col(f"__a_{c}")) / scale(c) for c in columns}).drop(*stats.columns)
    old = tuple(f for f in frame.features if not (codes and f.endswith("_code")))
    return frame.adding(df, prescaled=True).__class__(df, frame.spec, frame.ids, (*old, *[f"{c}{suffix}" for c in columns]), True, frame.meta)


def pca(frame: SplitFrame, components: int | float = 5, train_only: bool = False) -> SplitFrame:
    """Principal components of the imputed, scaled numerics: `joint_pc{i}` or `pca_train_pc{i}`.

    The driver gets one row of medians (of columns with gaps), one of means, and p x p sums of
    products. A fraction asks for the fewest components that explain more than it. The greatest
    loading of a component is positive.
    """
    columns = frame.spec.num
    if not columns:
        return frame
    fit = frame.train if train_only else frame.df
    p = len(columns)
    first = fit.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    gaps = [i for i in range(p) if first[f"g{i}"]]
    middle = fit.agg(*[F.median(columns[i]).alias(f"m{i}") for i in gaps]).first() if gaps else {}
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(float((middle[f"m{i}"] if i in gaps else None) or 0.0))) for i, c in enumerate(columns)]
    means = np.array([m or 0.0 for m in fit.agg(*[F.avg(x).alias(f"a{i}") for i, x in enumerate(filled)]).first()])
    moments = _gram(fit.select(*[x.alias(f"x{i}") for i, x in enumerate(filled)]), means)
    spread = np.sqrt(np.maximum(np.diag(moments), 0.0))
    spread[spread <= 1e-12 * np.maximum(1.0, np.abs(means))] = 1.0
    values, loadings = np.linalg.eigh(moments / np.outer(spread, spread))
    values, loadings = np.maximum(values[::-1], 0), loadings[:, ::-1]
    if isinstance(components, float):
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        k = int(min(np.searchsorted(share, components, side="right") + 1, p))
    else:
        k = min(components, p)
    prefix = "pca_train_pc" if train_only else "joint_pc"
    made = {}
    for i in range(k):
        v = loadings[:, i] * np.sign(loadings[np.argmax(np.abs(loadings[:, i])), i]) / spread
        products = F.zip_with("__cells", F.array(*[F.lit(float(w)) for w in v]), lambda x, w: x * w)
        made[f"{prefix}{i + 1}"] = F.aggregate(products, F.lit(float(-(v * means).sum())), lambda total, x: total + x)
    df = frame.df.withColumn("__cells", F.array(*filled)).withColumns(made).drop("__cells")
    out = frame.adding(df, *made)
    return out if train_only else out.adding(out.df, prescaled=True)


def _gram(rows: DataFrame, means: np.ndarray) -> np.ndarray:
    """The mean of the outer products of centred rows: p x p sums per partition, added before they are collected."""
    p = len(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((p, p)), 0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64) - means
            total += x.T @ x
            n += len(x)
        i, j = np.triu_indices(p)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j]), pa.array(np.full(len(i), n))], ["i", "j", "v", "n"])

    out = np.zeros((p, p))
    sums = rows.mapInArrow(run, "i long, j long, v double, n long").groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    for r in sums.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / max(r["n"], 1)
    return out


def finite(df: DataFrame, columns: list[str], limit: float = 1e10) -> DataFrame:
    """NaN to 0 and infinities to plus or minus the limit."""
    clean = lambda c: F.when(F.isnan(c), 0.0).when(F.col(c) == float("inf"), limit).when(F.col(c) == float("-inf"), -limit).otherwise(F.col(c))
    return df.withColumns({c: clean(c) for c in columns})
