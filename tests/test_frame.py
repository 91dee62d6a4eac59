"""Contracts, encoders on tiny frames with nulls, lineage, weights and slices."""

import math

import pytest
from pyspark.sql import functions as F

from driftloom.frame import SPLIT, TARGET, WEIGHT, ContractError, FeatureSpec, LabelGuard, bind
from driftloom.functions import two_sample as D
from driftloom.operators import compose as C
from driftloom.operators import encode as E
from driftloom.operators import etl as X
from driftloom.operators import group as G
from driftloom.operators import neighbors as N
from driftloom.operators import scale as S
from driftloom.operators import select as L
from driftloom.operators import temporal as T


def tiny(spark, task="classification"):
    rows = [
        (1, "a", 1.0, 0.0, 1.0, True),
        (2, "a", 2.0, None, 0.0, True),
        (3, "b", float("nan"), 2.0, 1.0, True),
        (4, None, 4.0, 3.0, 0.0, True),
        (5, "b", 5.0, 4.0, None, False),
        (6, "c", 6.0, 5.0, None, False),
    ]
    df = spark.createDataFrame(rows, "id long, c string, x double, z double, y double, side boolean")
    return bind(df, ["id"], FeatureSpec(("c",), ("x", "z"), task), F.col("side"), F.col("y"))


def values(df, column, key="id"):
    return {r[key]: r[column] for r in df.select(key, column).collect()}


def test_contract(spark):
    df = spark.createDataFrame([(1, "a")], "id long, c string")
    for spec in (FeatureSpec(("c", "c")), FeatureSpec((), ("c",)), FeatureSpec(("no",)), FeatureSpec(("c",), (), "ranking")):
        with pytest.raises(ContractError):
            spec.check(df)


def test_missing_category_is_a_level_and_nan_is_null(spark):
    f = E.frequency(tiny(spark))
    assert values(f.df, "c_freq_joint") == {1: 2 / 6, 2: 2 / 6, 3: 2 / 6, 4: 1 / 6, 5: 2 / 6, 6: 1 / 6}
    assert f.df.where("id = 3 and x is null").count() == 1


def test_train_only_codes_mark_unseen(spark):
    assert values(E.label_codes(tiny(spark), train_only=True).df, "c_code") == {1: 0, 2: 0, 3: 1, 4: 2, 5: 1, 6: -1}


def test_unseen_level_encodes_to_the_global_mean(spark):
    assert math.isclose(values(E.target_encoding(tiny(spark)).df, "c_target_enc")[6], 0.5)


def test_oof_encoding_leaves_the_own_fold_out(spark):
    enc = values(E.target_encoding_oof(tiny(spark), F.col("id") % 2, "diff").df, "c_target_enc_oof")
    # row 1 sees level a in row 2 alone: label 0, f_train 1/2, f_test 0
    m = 10 * (abs(0 - 1 / 2) + 1)
    assert math.isclose(enc[1], (0 + m * 0.5) / (1 + m))


def test_median_and_scale(spark):
    f = S.impute_median(tiny(spark))
    assert values(f.df, "x")[3] == 4.0
    z = values(S.zscore(f).df, "x_z")
    assert math.isclose(sum(z.values()), 0, abs_tol=1e-9)


def test_combined_groups_fill_with_zero(spark):
    out = G.grouped(tiny(spark), ("c",), ("x",), ("std",))
    assert values(out.df, "c_x_std_joint")[6] == 0.0


def test_ratio_is_flat_when_splits_agree(spark):
    rows = spark.range(40).select("id", (F.col("id") % 4).cast("string").alias("c"), (F.col("id") % 4).cast("double").alias("x"), (F.floor(F.col("id") / 4) % 2 == 0).alias("side"))
    f = bind(rows, ["id"], FeatureSpec(("c",), ("x",)), F.col("side"))
    assert all(abs(v) < 1e-12 for v in values(E.frequency_ratio(f).df, "c_freq_ratio").values())
    assert D.ks(f).first()["ks"] == 0.0


def test_guard_hides_once_and_scores(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, 0.0, False)], "id long, y double, side boolean")
    guard = LabelGuard()
    hidden = guard.hide(df, ("id",), "y", F.col("side"))
    assert hidden.where(f"id = 2 and {TARGET} is null").count() == 1
    with pytest.raises(ContractError):
        guard.hide(df, ("id",), "y", F.col("side"))
    assert guard.truth(df.select("id"), ("id",)).first()["__truth"] == 0.0


def test_weights_multiply_and_stay_off_test_rows(spark):
    put = lambda v: lambda f: f.adding(f.df.withColumn(WEIGHT, F.lit(v)))
    out = values(C.pipeline(put(2.0), put(3.0))(tiny(spark)).df, WEIGHT)
    assert out[1] == 6.0 and out[5] is None


def test_augmented_rows_have_sources(spark):
    out = N.augmented(tiny(spark), 2, 0.5, 1)
    C.check_lineage(out)
    assert out.df.where("__role = 'tdda_augment'").count() == 4
    assert out.df.where(F.col(SPLIT) == "test").count() == 2


def test_neighbours_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3)).round(1)
    points = spark.createDataFrame([(i, "train" if i % 3 else "test", [float(v) for v in x[i]]) for i in range(60)], "id long, split string, vec array<double>")
    got = {(r["id"], r["nsplit"], r["rank"]): r["nid"] for r in N.nearest(points, 4, block=16).collect()}
    for i in range(60):
        for s in ("train", "test"):
            other = [j for j in range(60) if j != i and ("train" if j % 3 else "test") == s]
            best = sorted(other, key=lambda j: (float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j))[:4]
            assert [got[(i, s, r + 1)] for r in range(4)] == best


def test_cumulative_selection():
    assert L.select_cumulative({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, 0.75, 1) == ["a", "b"]
    assert L.select_cumulative({"a": 0.0, "b": 0.0}) == ["a", "b"]


def test_window_sizes():
    assert T.default_sizes(30_000, 20_000) == (8000, 5000)
    assert T.default_sizes(18_846, 4646) == (6282, 2323)
    assert T.default_sizes(3000, 1500) == (2500, 1000)
    assert T.gap_windows(100, 50, 40, 10, 4).starts == (0, 20, 40, 60)


def test_rare_levels_share_a_code(spark):
    rows = spark.createDataFrame([(i, "A" if i < 60 else "B" if i < 98 else "C" if i == 98 else "D") for i in range(100)], "id long, x string")
    f = bind(rows, ["id"], FeatureSpec(("x",)), F.col("id") < 100)
    codes = values(E.label_codes(f, min_frequency=1 / 50).df, "x_code")
    assert codes[98] == codes[99] == 2 and codes[0] == 0


def test_bootstrap_and_sample_sizes(spark):
    rows = spark.range(50)
    assert X.bootstrap(rows, ["id"], 80, 1).count() == 80
    assert X.exact_sample(rows, 7, ["id"], 3).count() == 7


def test_projection_is_orthogonal(spark):
    rows = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 + F.col("id") % 3).cast("double").alias("b"), (F.col("id") % 5).cast("double").alias("c"))
    out = S.pca(bind(rows, ["id"], FeatureSpec((), ("a", "b", "c")), F.col("id") < 100), 2)
    assert abs(out.df.agg(F.corr("joint_pc1", "joint_pc2")).first()[0]) < 1e-8


def test_tails(spark):
    assert math.isclose(D.chi2_tail(spark, 3.841458820694124, 1), 0.05, rel_tol=1e-6)
    assert D.ks_tail(0.0, 100, 100) == 1.0 and D.ks_tail(0.9, 100, 100) < 1e-10


def test_entry_without_the_text_package(tmp_path):
    """The rest imports and lists its queries when the text operators are gone."""
    import pathlib
    import shutil
    import subprocess
    import sys

    here = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(here / "driftloom", tmp_path / "driftloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_neighbours_meet_without_a_join_of_blocks(spark):
    """Blocks in pairs were 21 GB on disk at 100,000 rows of 64 columns."""
    points = spark.createDataFrame([(i, "train" if i % 2 else "test", [float(i % 7), 1.0]) for i in range(40)], "id long, split string, vec array<double>")
    near = N.nearest(points, 3, block=4)
    assert "Join" not in near._jdf.queryExecution().toString() and "Cartesian" not in near._jdf.queryExecution().toString()
    got = {(r["id"], r["nsplit"], r["rank"]): (r["nid"], r["dist"]) for r in near.collect()}
    for i in range(40):
        for s in (0, 1):
            best = sorted((abs(i % 7 - j % 7), j) for j in range(40) if j != i and j % 2 == s)[:3]
            assert [got[(i, "train" if s else "test", r + 1)] for r in range(3)] == [(j, float(d)) for d, j in best]


def test_a_missing_leaf_differs_from_nothing(spark):
    """As in SQL, where a comparison with null is not true."""
    leaves = spark.createDataFrame([(0, "train", [1.0, None]), (1, "test", [2.0, 5.0]), (2, "test", [1.0, 3.0])], "id long, split string, vec array<double>")
    got = {(r["id"], r["nid"]): r["dist"] for r in N.nearest(leaves, 2, "hamming").collect()}
    assert got[(0, 1)] == 0.5 and got[(0, 2)] == 0.0 and got[(1, 2)] == 1.0


def test_leaves_of_many_expressions_are_planned_soon(spark):
    """With 64 of them the planner of the exploded array did not end in two minutes."""
    from driftloom.operators.density import leaf_confidence

    rows = spark.range(20).select("id", F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"), *[(F.rand(i) - 0.5).alias(f"e{i}") for i in range(64)])
    cells = [F.floor(F.when(~F.isnan(f"e{i}"), F.col(f"e{i}")) * 3).cast("double") for i in range(64)]
    out = leaf_confidence(rows.select("id", "split", F.array(*cells).alias("vec")))
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert out.count() == 20
