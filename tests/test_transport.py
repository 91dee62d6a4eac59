"""Optimal transport along one column: medians, and plans in which nothing grows in one place."""

import random
import re

from driftloom.frame import SPLIT, FeatureSpec, bind
from driftloom.operators import transport


def _frame(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 7 == 0 else round(rng.gauss(0, 5), 1), float(i % 5)) for i in range(211)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    return rows, bind(df, ["id"], FeatureSpec((), ("x", "y")), df["id"] % 3 > 0)


def test_medians_equal_those_of_sorted_values(spark):
    rows, frame = _frame(spark)
    got = {r[SPLIT]: (r["__m_x"], r["__m_y"]) for r in transport._medians(frame.df, ("x", "y")).collect()}
    for split, own in (("train", [r for r in rows if r[0] % 3 > 0]), ("test", [r for r in rows if r[0] % 3 == 0])):
        for k in (1, 2):
            values = sorted(r[k] for r in own if r[k] is not None)
            middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
            assert abs(got[split][k - 1] - middle) < 1e-12


def test_nothing_of_a_columns_size_is_broadcast_or_in_one_task(spark):
    _, frame = _frame(spark)
    out = transport.displacement(frame)
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert out.df.count() == 211
    assert set(re.findall(r"BroadcastHashJoin \[(\w+)", plan)) <= {SPLIT} and not re.search("percentile|Window", plan)
