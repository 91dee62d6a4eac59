"""Label propagation with the defaults of the operator, against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.frame import FeatureSpec, bind
from driftloom.operators import propagate
from driftloom.operators.neighbors import row_fold
from driftloom.plans import geometry


def _expected(x, y, train, fold, k=15, alpha=0.5, folds=5, iterations=100, tolerance=1e-4):
    n = len(x)
    k = min(k, n - 1)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, axis=1)
    w = np.zeros((n, n))
    np.put_along_axis(w, near, np.exp(-(dist**2) / (np.median(dist[:, -1]) + 1e-8) ** 2), axis=1)
    w = (w + w.T) / 2
    w /= w.sum(axis=1, keepdims=True)
    found, steps = [], []
    for run in range(folds):
        known = train & (fold != run)
        start = np.where(known, y, y[train].mean())
        f = start.copy()
        for step in range(iterations):
            new = w @ f
            new[known] = alpha * start[known] + (1 - alpha) * new[known]
            if np.abs(new - f).max() < tolerance:
                break
            f = new
        found.append(f)
        steps.append(step)
    found = np.array(found)
    return np.where(train, found[np.where(train, fold, 0), np.arange(n)], found.mean(axis=0)), steps


@pytest.mark.parametrize("n", [9, 80])
def test_label_propagation_goes_on_until_each_fold_stops(spark, n):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(n, 3)), rng.integers(0, 10, n).astype(float)
    df = spark.createDataFrame([(i, *x[i].tolist(), float(y[i])) for i in range(n)], "id long, a double, b double, c double, y double")
    frame = bind(df, ["id"], FeatureSpec((), ("a", "b", "c")), F.col("id") % 2 == 0, F.col("y"))
    fold = np.array([r["fold"] for r in df.select("id", row_fold(("id",), 5).alias("fold")).orderBy("id").collect()])
    expected, steps = _expected(x, y, np.arange(n) % 2 == 0, fold)
    got = [r["label_prop_soft"] for r in propagate.label_propagation(frame).output().orderBy("id").collect()]
    assert n == 9 or max(steps) > 10 and len(set(steps)) > 1
    np.testing.assert_allclose(got, expected, rtol=1e-9)


def test_the_query_takes_the_defaults(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(geometry.P, "label_propagation", lambda frame, *a, **b: asked.append((a, b)) or frame)
    geometry.label_prop_soft(spark, "/root/testdata/sf0.001")
    assert asked == [((), {})]
