"""Dataset folders, folds, raw formats and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.frame import SPLIT, ContractError
from driftloom.functions import two_sample
from driftloom.functions.two_sample import ks
from driftloom.operators import runs as R
from driftloom.sources import datasets as S
from driftloom.streaming import stats


def folder(spark, path, meta=None):
    rows = spark.createDataFrame([(f"c{i % 3}", float(i), float(i % 2)) for i in range(20)], "c string, x double, __target__ double")
    rows.where("x < 12").write.parquet(f"{path}/train.parquet")
    rows.where("x >= 12").write.parquet(f"{path}/test.parquet")
    text = {"name": "tiny", "task_type": "classification", "cat_features": ["c"], "num_features": ["x"]} | (meta or {})
    with open(f"{path}/meta.json", "w") as out:
        json.dump(text, out, indent=1)


def test_folder_round_trip(spark, tmp_path):
    folder(spark, str(tmp_path))
    data = S.load_folder(spark, str(tmp_path))
    assert data.frame.train.count() == 12 and data.frame.test.count() == 8
    assert data.frame.test.where("__target is not null").count() == 0
    assert S.load_folder(spark, str(tmp_path), max_rows=5).frame.df.count() == 10


@pytest.mark.parametrize("meta", [{"num_features": []}, {"cat_features": ["c", "c"]}, {"task_type": "regression"}])
def test_folder_contract(spark, tmp_path, meta):
    folder(spark, str(tmp_path), meta)
    with pytest.raises(ContractError):
        S.load_folder(spark, str(tmp_path))


def test_writer_refuses_overlap_and_empty_splits(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, 1, "train"), (0.0, 2, "test")], f"__target__ double, __time__ int, {SPLIT} string")
    S.write_folder(rows, str(tmp_path / "ok"), {"name": "w"})
    assert spark.read.text(str(tmp_path / "ok/meta.json")).count() == 1
    for bad in (rows.withColumn("__time__", F.lit(1)), rows.where(f"{SPLIT} = 'train'"), rows.drop("__target__")):
        with pytest.raises(ContractError):
            S.write_folder(bad, str(tmp_path / "bad"), {})


def test_folds(spark, tmp_path):
    np.savez(tmp_path / "folds.npz", train_idx_0=[0, 1], test_idx_0=[2], train_idx_1=[2], test_idx_1=[0, 9])
    folds = S.fold_table(spark, str(tmp_path / "folds.npz"))
    data = spark.range(3).withColumnRenamed("id", "row_id")
    assert {(r["row_id"], r[SPLIT]) for r in S.fold_rows(data, folds, 0).collect()} == {(0, "train"), (1, "train"), (2, "test")}
    with pytest.raises(ContractError):
        S.fold_rows(data, folds, 1)


def test_sparse_lines(spark, tmp_path):
    (tmp_path / "a.dat").write_text("1;10.5 1:0.5 3:-2e3\n\n2 2:7\n")
    rows = sorted(S.read_sparse(spark, str(tmp_path / "a.dat"), 3).collect())
    assert [tuple(r) for r in rows] == [(1, 10.5, 0.5, None, -2000.0), (2, None, None, 7.0, None)]


def test_csv_with_pruning(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,NA,x\n2,5,y\n")
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "a.csv"), ["a", "b"], null="NA").orderBy("a").collect()] == [(1, None), (2, 5)]


def test_icd9_groups(spark):
    codes = spark.createDataFrame([("250.13",), ("414",), ("785",), ("786",), ("V57",), ("999",), (None,)], "c string")
    assert [r[0] for r in codes.select(S.icd9_group(F.col("c"))).collect()] == ["diabetes", "circulatory", "circulatory", "respiratory", "supplementary", "injury", "unknown"]


@pytest.mark.parametrize("strength,mean_ks,mean_js", [(0.0, 0.011, 8.5e-05), (0.5, 0.04362, 0.000427), (1.0, 0.08208, 0.00151), (3.0, 0.20872, 0.013951), (5.0, 0.30666, 0.041693)])
def test_generated_shift_is_as_published(spark, strength, mean_ks, mean_js):
    frame = S.synthetic(spark, 10_000, 10_000, strength)
    assert abs(ks(frame).agg(F.avg("ks")).first()[0] - mean_ks) < 0.008
    assert abs(two_sample.divergence(two_sample.split_counts(frame)).agg(F.avg("js")).first()[0] - mean_js) < 0.0003 + 0.1 * mean_js


def test_label_shift_keeps_what_columns_are_like(spark):
    frame = S.synthetic(spark, 6000, 4000, mode="label_shift", prevalence=0.65)
    assert frame.test.count() == 4000 and frame.train.count() == 6000
    assert ks(frame).agg(F.max("ks")).first()[0] < 0.08


def test_random_chains_and_their_unknown_steps(spark):
    from driftloom.operators import compose, runs

    made = runs.chains([{"name": "one", "steps": ["freq_ratio_log", "joint_scaling"]}], compose.METHODS)
    out = made["one"](S.synthetic(spark, 300, 200)).output()
    assert out.count() == 500 and len(out.columns) > 5
    with pytest.raises(KeyError):
        runs.chains([{"name": "bad", "steps": ["no such step"]}], compose.METHODS)


def test_generated_shift_rises(spark):
    found = [ks(S.synthetic(spark, 3000, 3000, s)).where("column = 'AGEP'").first()["ks"] for s in (0.0, 1.0, 5.0)]
    assert found[0] < 0.05 < found[1] < found[2]


def test_stream_counts_equal_the_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stats.windowed_levels(stream, "ts", ("event_type",)).writeStream.outputMode("complete").format("memory").queryName("levels").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("levels").agg(F.sum("n")).first()[0] == rows.count()
    q = stats.per_batch(stream, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == rows.count()


def test_runs(spark):
    schema = "dataset string, method string, model string, seed int, fold int, error string"
    done = spark.createDataFrame([("d", "m", "x", 0, 0, None), ("d", "m", "x", 0, 1, "boom"), ("d", "m", "x", 0, 2, "tabpfn_skip: rows")], schema)
    tasks = done.drop("error")
    assert [r["fold"] for r in R.pending(tasks, done).collect()] == [1]
    assert R.same_runs(tasks, done) and not R.same_runs(tasks, done.where("fold > 0"))
    assert R.flat_record({"auc": 1}, {"auc": 2, "long": list(range(20))}, {"auc"}) == {"auc": 1, "meta_auc": 2}
