"""Queries of sources and sinks, column operators, joins of raw tables, and bookkeeping."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from driftloom.frame import SPLIT, TEST, TRAIN, FeatureSpec, bind
from driftloom.functions import metrics as M
from driftloom.operators import etl as X
from driftloom.operators import neighbors as N
from driftloom.operators import runs as R
from driftloom.operators import scale as Z
from driftloom.operators import temporal as G
from driftloom.operators.lineage import put_file, shared_folder
from driftloom.plans.catalog import LI_SQL, lineitems, query, r6, table
from driftloom.sources import datasets as S

_CUT = "timestamp_ntz '1999-01-01'"

# -- sources and sinks -----------------------------------------------------------------------------


@query("csv_gz_scan", "SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment FROM customer")
def csv_gz_scan(spark, sf_dir):
    folder = shared_folder(spark, "csv")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment"))
    rows.write.option("header", True).option("compression", "gzip").option("nullValue", "NA").csv(folder)
    schema = "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"
    return S.read_csv(spark, folder, ["c_custkey", "c_acctbal", "c_mktsegment"], null="NA", schema=schema)


@query("zipped_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_regionkey <> 2 THEN CAST(n_regionkey AS VARCHAR) END AS region FROM nation")
def zipped_csv(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    text = "key,name,region\n" + "".join(f"{r['n_nationkey']},{r['n_name']},{'NA' if r['n_regionkey'] == 2 else r['n_regionkey']}\n" for r in rows)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("other.csv", "a,b\n1,2\n")
        archive.writestr("nation.csv", text)
    path = put_file(shared_folder(spark, "zip"), "nation.zip", held.getvalue())
    return S.read_zipped_csv(spark, path, "nation.csv", "NA", ["key", "region"])


@query("archive_members", "SELECT 'data/' || n_nationkey || '.txt' AS member, CAST(strlen(n_name) AS BIGINT) AS n_bytes FROM nation WHERE n_regionkey = 1")
def archive_members(spark, sf_dir):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for r in table(spark, sf_dir, "nation").where("n_regionkey = 1").collect():  # a few rows
            archive.writestr(f"data/{r['n_nationkey']}.txt", r["n_name"])
            archive.writestr(f"skipped/{r['n_nationkey']}.txt", r["n_name"])
    folder = shared_folder(spark, "archive")
    return S.unpack_archive(spark, put_file(folder, "a.zip", held.getvalue()), f"{folder}/out", "data/")


@query("glob_concat", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS o_totalprice FROM orders")
def glob_concat(spark, sf_dir):
    folder, rows = shared_folder(spark, "glob"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows.where("o_orderstatus = 'F'").write.parquet(f"{folder}/part-a")
    rows.where("o_orderstatus <> 'F'").drop("o_totalprice").write.parquet(f"{folder}/part-b")
    return S.read_many(spark, f"{folder}/part-*").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "folder_round_trip",
    f"""SELECT CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS split, count(*) AS n, {r6('sum(o_totalprice)')} AS price,
count(DISTINCT o_orderpriority) AS levels, {r6("sum(CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN CAST(o_orderstatus = 'F' AS INT) END)")} AS target FROM orders GROUP BY 1""",
)
def folder_round_trip(spark, sf_dir):
    """Written with its description, found below a root, checked and read again."""
    root = shared_folder(spark, "datasets")
    split = F.when(F.col("o_orderdate") < F.expr(_CUT), TRAIN).otherwise(TEST)
    rows = table(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_totalprice", F.col("o_orderdate").alias(S.FOLDER_TIME), (F.col("o_orderstatus") == "F").cast("int").alias(S.FOLDER_TARGET), split.alias(SPLIT)
    )
    meta = {"name": "tabred_weather", "task_type": "classification", "cat_features": ["o_orderpriority"], "num_features": ["o_totalprice"]}
    S.write_folder(rows, f"{root}/tabred_weather", meta)
    frame = S.load(spark, "tabred_weather", root)
    return frame.df.groupBy(F.col(SPLIT).alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("price"), F.count_distinct("o_orderpriority").alias("levels"), F.sum("__target").cast("double").alias("target")
    )


@query("fold_scan", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 5 = 2 THEN 'test' ELSE 'train' END AS split FROM orders WHERE o_orderkey % 7 <> 0")
def fold_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    folds = rows.where("o_orderkey % 7 <> 0").select(F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("fold"), F.col("o_orderkey"))
    folds = folds.withColumn("split", F.when(F.col("o_orderkey") % 5 == F.col("fold"), TEST).otherwise(TRAIN))
    return S.fold_rows(rows, folds, 2, "o_orderkey").select("o_orderkey", "o_totalprice", F.col(SPLIT).alias("split"))


@query("exact_subsample", "SELECT least(500, count(*)) AS n, least(500, count(*)) AS different, least(500, count(*)) AS known, true AS again FROM orders")
def exact_subsample(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    once, twice = X.exact_sample(rows, 500, ["o_orderkey"], 7), X.exact_sample(rows.repartition(7), 500, ["o_orderkey"], 7)
    same = once.join(twice, "o_orderkey").agg(F.count(F.lit(1)).alias("both"))
    known = once.join(rows, "o_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("known"))
    out = once.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("different")).crossJoin(known).crossJoin(same)  # one row each
    return out.select("n", "different", "known", (F.col("both") == F.col("n")).alias("again"))


@query("streamed_sample", "SELECT true AS share_holds, true AS filter_holds, true AS nested")
def streamed_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    keys, keep = ["l_orderkey", "l_linenumber", "l_partkey"], F.col("l_quantity") > 10
    whole = rows.where(keep).agg(F.count(F.lit(1)).alias("whole"))
    small = S.streamed_sample(rows, keys, 0.1, keep)
    some = S.streamed_sample(rows, keys, 0.25, keep).agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("least"))
    lost = small.join(S.streamed_sample(rows, keys, 0.25, keep), keys, "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    one = whole.crossJoin(some).crossJoin(lost)  # one row each
    return one.select((F.abs(F.col("n") / F.col("whole") - 0.25) < 0.03).alias("share_holds"), (F.col("least") > 10).alias("filter_holds"), (F.col("lost") == 0).alias("nested"))


@query(
    "stratified_split",
    "SELECT o_orderstatus, CAST(count(*) - round(count(*) * 0.2) AS BIGINT) AS n_train, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM orders GROUP BY 1",
)
def stratified_split(spark, sf_dir):
    out = S.stratified_split(table(spark, sf_dir, "orders"), "o_orderstatus", ["o_orderkey"])
    return out.groupBy("o_orderstatus").agg(F.count(F.when(F.col(SPLIT) == TRAIN, 1)).alias("n_train"), F.count(F.when(F.col(SPLIT) == TEST, 1)).alias("n_test"))


@query(
    "sparse_lines",
    "SELECT l_linenumber AS label, l_tax AS concentration, l_quantity AS f0, CAST(NULL AS DOUBLE) AS f1, CASE WHEN l_discount > 0.02 THEN l_discount END AS f2 FROM lineitem",
)
def sparse_lines(spark, sf_dir):
    folder = shared_folder(spark, "sparse")
    line = F.concat(F.col("l_linenumber"), F.lit(";"), F.col("l_tax"), F.lit(" 1:"), F.col("l_quantity"), F.when(F.col("l_discount") > 0.02, F.concat(F.lit(" 3:"), F.col("l_discount"))).otherwise(""))
    table(spark, sf_dir, "lineitem").select(line.alias("value")).write.text(folder)
    return S.read_sparse(spark, folder, 3)


_CODE = "CASE o_orderkey % 9 WHEN 0 THEN 'V' || (o_orderkey % 90) WHEN 1 THEN 'E' || (800 + o_orderkey % 100) WHEN 2 THEN '?' WHEN 3 THEN NULL WHEN 4 THEN '250.' || (o_orderkey % 100) WHEN 5 THEN (o_orderkey % 1000) || '.5' ELSE CAST(o_orderkey % 1000 AS {text}) END"


@query(
    "icd9_groups",
    f"""WITH c AS (SELECT {_CODE.format(text='VARCHAR')} AS code FROM orders), n AS (SELECT code, TRY_CAST(replace(replace(code, 'E', ''), 'V', '') AS DOUBLE) AS x FROM c)
SELECT CASE WHEN code IS NULL OR code = '?' THEN 'unknown' WHEN code LIKE 'V%' THEN 'supplementary' WHEN code LIKE 'E%' THEN 'external_causes'
WHEN x BETWEEN 390 AND 459 OR x = 785 THEN 'circulatory' WHEN x BETWEEN 460 AND 519 OR x = 786 THEN 'respiratory' WHEN x BETWEEN 520 AND 579 OR x = 787 THEN 'digestive'
WHEN x >= 250 AND x < 251 THEN 'diabetes' WHEN x BETWEEN 800 AND 999 THEN 'injury' WHEN x BETWEEN 710 AND 739 THEN 'musculoskeletal'
WHEN x BETWEEN 580 AND 629 OR x = 788 THEN 'genitourinary' WHEN x BETWEEN 140 AND 239 THEN 'neoplasms' ELSE 'other' END AS chapter, count(*) AS n FROM n GROUP BY 1""",
)
def icd9_groups(spark, sf_dir):
    codes = table(spark, sf_dir, "orders").select(F.expr(_CODE.format(text="STRING")).alias("code"))
    return codes.groupBy(S.icd9_group(F.col("code")).alias("chapter")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "hospital_first_stays",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
SELECT o_orderkey AS encounter_id, CASE WHEN o_orderkey % 8 IN (1, 2, 3, 7) THEN 'train' ELSE 'test' END AS split,
CASE WHEN o_orderkey % 8 IN (1, 2, 3, 7) THEN CAST(o_orderstatus = 'F' AS DOUBLE) END AS target FROM f WHERE i = 1""",
)
def hospital_first_stays(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("encounter_id"), F.col("o_custkey").alias("patient_nbr"), (F.col("o_orderkey") % 8).alias("admission_type_id"), F.when(F.col("o_orderstatus") == "F", "<30").otherwise("NO").alias("readmitted"), "o_totalprice"
    )
    frame = S.diabetes_hospital(rows, (), ("o_totalprice",))
    return frame.df.select("encounter_id", F.col(SPLIT).alias("split"), F.col("__target").alias("target"))


@query(
    "loans_by_year",
    """SELECT o_orderkey AS id, CASE WHEN year(o_orderdate) + 14 <= 2014 THEN 'train' ELSE 'test' END AS split, CAST(o_orderkey % 60 AS DOUBLE) AS term, (o_orderkey % 300) / 10.0 AS int_rate,
CASE WHEN year(o_orderdate) + 14 <= 2014 THEN CAST(o_orderstatus = 'F' AS DOUBLE) END AS target FROM orders WHERE o_orderstatus IN ('F', 'O') AND year(o_orderdate) + 14 BETWEEN 2007 AND 2018""",
)
def loans_by_year(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "Charged Off").when(F.col("o_orderstatus") == "O", "Fully Paid").otherwise("Current")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        status.alias("loan_status"),
        F.concat(F.lit("Mar-"), F.year("o_orderdate") + 14).alias("issue_d"),
        F.concat(F.lit(" "), F.col("o_orderkey") % 60, F.lit(" months")).alias("term"),
        F.concat((F.col("o_orderkey") % 300) / 10, F.lit("%")).alias("int_rate"),
    )
    return S.lending_club(rows, (), ("term", "int_rate")).df.select("id", F.col(SPLIT).alias("split"), "term", "int_rate", F.col("__target").alias("target"))


@query("bikes_by_year", "SELECT l_orderkey, l_linenumber, CASE WHEN year(l_shipdate) < 1999 THEN 'train' ELSE 'test' END AS split, CASE WHEN year(l_shipdate) < 1999 THEN l_quantity END AS target FROM lineitem")
def bikes_by_year(spark, sf_dir):
    cat, num = ("season", "holiday", "weekday", "workingday", "weathersit", "mnth", "hr"), ("temp", "atemp", "hum", "windspeed")
    rows = table(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber").alias("instant"), (F.year("l_shipdate") >= 1999).cast("int").alias("yr"), F.col("l_quantity").alias("cnt"), *[F.month("l_shipdate").alias(c) for c in cat], *[F.col("l_tax").alias(c) for c in num]
    )
    return S.bike_sharing(rows).df.select("instant.l_orderkey", "instant.l_linenumber", F.col(SPLIT).alias("split"), F.col("__target").alias("target"))


@query(
    "survey_by_region",
    """SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN 'train' ELSE 'test' END AS split, CAST(coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 END, -1) AS VARCHAR) AS sex,
CASE WHEN c_custkey % 100 IN (77, 99) THEN NULL WHEN c_custkey % 100 = 88 THEN 0.0 ELSE CAST(c_custkey % 100 AS DOUBLE) END AS days,
CASE WHEN c_nationkey < 8 THEN CAST(c_custkey % 5 = 1 AS DOUBLE) END AS target FROM customer WHERE c_nationkey < 20 AND c_custkey % 5 IN (1, 3)""",
)
def survey_by_region(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("_STATE"), (F.col("c_custkey") % 5).alias("DIABETE"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 4).alias("sex"), (F.col("c_custkey") % 100).alias("days")
    )
    regions = {i: "south" if i < 8 else "west" for i in range(20)}
    frame = S.brfss(rows, regions, "DIABETE", [1], [3], ("sex",), ("days",), ("south",), ["c_custkey"])
    return frame.df.select("c_custkey", F.col(SPLIT).alias("split"), "sex", "days", F.col("__target").alias("target"))


@query("census_by_state", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'train' ELSE 'test' END AS split, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN CAST(c_acctbal > 0 AS DOUBLE) END AS target FROM customer")
def census_by_state(spark, sf_dir):
    rows = S.state_column(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "STATE").withColumn("rich", F.col("c_acctbal") > 0))
    frame = S.by_state(rows, "ST", ("BUILDING", "MACHINERY"), FeatureSpec((), ("c_acctbal",)), ["c_custkey"], "rich")
    return frame.df.select("c_custkey", F.col(SPLIT).alias("split"), F.col("__target").alias("target"))


@query("split_files", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, value FROM events")
def split_files(spark, sf_dir):
    """Splits that come as files, with columns that only describe rows left out."""
    rows = table(spark, sf_dir, "events").select("event_id", "value", "props", F.lit(1.0).alias("fact"))
    frame = S.by_file(rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0").drop("props"), FeatureSpec((), ("value",)), ["event_id"], "fact")
    return frame.df.select("event_id", F.col(SPLIT).alias("split"), "value")


@query("footer_shape", "SELECT 'orders' AS name, count(*) AS n_rows, 6 AS n_columns FROM orders UNION ALL SELECT 'nation', count(*), 3 FROM nation")
def footer_shape(spark, sf_dir):
    return spark.createDataFrame([(t, *S.parquet_shape(f"{sf_dir}/{t}.parquet")) for t in ("orders", "nation")], "name string, n_rows long, n_columns int")


@query("sweep_csv", "SELECT CAST(o_custkey % 3 AS VARCHAR) AS dataset, count(*) AS n FROM orders GROUP BY 1")
def sweep_csv(spark, sf_dir):
    folder = shared_folder(spark, "sweep")
    R.write_sweep(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).cast("string").alias("dataset"), F.lit("m").alias("method"), F.col("o_orderkey").alias("seed")), folder)
    back = S.read_csv(spark, folder, schema="dataset string, method string, seed long")
    return back.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


# -- columns -------------------------------------------------------------------------------------------


@query("columns_by_type", "SELECT p_partkey, p_size, p_retailprice FROM part")
def columns_by_type(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.select(*[f.name for f in rows.schema if f.dataType.typeName() in ("long", "integer", "double")])


@query("drop_rename_reorder", "SELECT p_size AS size, p_partkey AS id, p_brand FROM part")
def drop_rename_reorder(spark, sf_dir):
    return table(spark, sf_dir, "part").drop("p_name", "p_type", "p_retailprice").withColumnsRenamed({"p_size": "size", "p_partkey": "id"}).select("size", "id", "p_brand")


@query("rows_with_key", "SELECT event_id, CASE WHEN value >= 20 THEN value END AS value FROM events WHERE value >= 20")
def rows_with_key(spark, sf_dir):
    return X.sentinel_to_null(table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") >= 20, F.col("value")).alias("value")), ["value"], -1.0).dropna(subset=["value"])


@query("coerced_numbers", "SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS x FROM part")
def coerced_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("x"))
    return X.coerce(rows, ["x"])


@query("plain_names", "SELECT p_partkey AS part_key, p_size AS size, p_brand AS size_1, p_type AS column FROM part")
def plain_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    return rows.toDF(*X.sanitised(["part key", "size!", "(size)", "$$"]))


@query("finite_numbers", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1e10 WHEN 2 THEN -1e10 ELSE p_retailprice END AS x FROM part")
def finite_numbers(spark, sf_dir):
    k = F.col("p_partkey") % 4
    odd = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("p_retailprice"))
    return Z.finite(table(spark, sf_dir, "part").select("p_partkey", odd.alias("x")), ["x"])


@query("table_fingerprint", "SELECT count(*) AS n, true AS same, true AS differs FROM orders")
def table_fingerprint(spark, sf_dir):
    """The fingerprint is that of the same rows in any order, and not that of rows changed in one cell."""
    rows = table(spark, sf_dir, "orders")
    own, mixed = X.file_contract(rows), X.file_contract(rows.repartition(5, "o_custkey").sortWithinPartitions(F.desc("o_totalprice")))
    least = rows.agg(F.min("o_orderkey").alias("least"))
    changed = X.file_contract(rows.crossJoin(least).withColumn("o_totalprice", F.when(F.col("o_orderkey") == F.col("least"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).drop("least"))
    name = lambda df, n: df.select(F.col("rows").alias(f"{n}_rows"), F.col("fingerprint").alias(f"{n}_print"))
    one = name(own, "a").crossJoin(name(mixed, "b")).crossJoin(name(changed, "c"))  # one row each
    same = (F.col("a_rows") == F.col("b_rows")) & (F.col("a_print") == F.col("b_print"))
    return one.select(F.col("a_rows").alias("n"), same.alias("same"), (F.col("a_print") != F.col("c_print")).alias("differs"))


# -- joins and aggregates of raw tables -------------------------------------------------------------------


@query("join_with_suffixes", "SELECT a.n_regionkey AS key, a.n_name AS name_x, b.r_name AS name_y FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey")
def join_with_suffixes(spark, sf_dir):
    left = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("name"))
    right = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return X.inner_suffixed(left, right, "key")


@query(
    "aggregates_with_static",
    f"""SELECT o_orderkey, o_totalprice, max(l_quantity) AS "max_quantityP", min(l_quantity) AS "min_quantityP", {r6('avg(l_quantity)')} AS "mean_quantityP", {r6('stddev_samp(l_quantity)')} AS "std_quantityP"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def aggregates_with_static(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantityP"))
    depth = X.suffix_aggregates(rows, "l_orderkey", "l_linenumber").withColumnRenamed("l_orderkey", "o_orderkey")
    return depth.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("joined_on_time", f"SELECT event_id, {r6('value')} AS value, {r6('macro')} AS macro FROM events JOIN (SELECT date_trunc('day', o_orderdate) AS day, avg(o_totalprice) AS macro FROM orders GROUP BY 1) m ON date_trunc('day', ts) = day + INTERVAL 26 YEAR")
def joined_on_time(spark, sf_dir):
    macro = table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("macro"))
    macro = macro.withColumn("day", F.expr("CAST(day AS timestamp_ntz) + INTERVAL '26' YEAR"))
    rows = table(spark, sf_dir, "events").withColumn("day", F.expr("CAST(date_trunc('day', ts) AS timestamp_ntz)"))
    return rows.join(macro, "day").select("event_id", "value", "macro")


@query(
    "label_correlation",
    f"""WITH {LI_SQL}, t AS (SELECT *, CAST(l_returnflag = 'R' AS DOUBLE) AS y FROM li WHERE split = 'train')
SELECT 'l_quantity' AS feature, {r6('abs(corr(l_quantity, y))')} AS importance FROM t UNION ALL SELECT 'l_extendedprice', {r6('abs(corr(l_extendedprice, y))')} FROM t
UNION ALL SELECT 'l_discount', {r6('abs(corr(l_discount, y))')} FROM t UNION ALL SELECT 'l_tax', {r6('abs(corr(l_tax, y))')} FROM t""",
)
def label_correlation(spark, sf_dir):
    frame = lineitems(spark, sf_dir, target="l_returnflag = 'R'")
    return spark.createDataFrame(sorted(N.importance(frame, frame.spec.num).items()), "feature string, importance double")


# -- bookkeeping and metrics ----------------------------------------------------------------------------


@query(
    "tasks_by_cost",
    "SELECT c_nationkey || '' AS dataset, CAST(f.f AS INT) AS fold, 'a' AS method, 'm' AS model, 1 AS seed, cost, CAST(row_number() OVER (ORDER BY cost DESC, c_nationkey || '', f.f) AS BIGINT) AS place FROM (SELECT c_nationkey, count(*) AS cost FROM customer GROUP BY 1) CROSS JOIN range(2) f(f)",
)
def tasks_by_cost(spark, sf_dir):
    data = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("dataset")).agg(F.count(F.lit(1)).alias("cost")).withColumn("folds", F.lit(2))
    one = lambda name, value, kind: spark.createDataFrame([(value,)], f"{name} {kind}")
    tasks = R.costly_first(R.manifest(data, one("method", "a", "string"), one("model", "m", "string"), one("seed", 1, "int"))).collect()  # a manifest is small
    rows = [(r["dataset"], r["fold"], r["method"], r["model"], r["seed"], r["cost"], i + 1) for i, r in enumerate(tasks)]
    return spark.createDataFrame(rows, "dataset string, fold int, method string, model string, seed int, cost long, place long")


@query("first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def first_rows(spark, sf_dir):
    return X.preview(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"])


@query("same_rows", "SELECT true AS same, false AS lacking, false AS doubled")
def same_rows(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select(F.col("c_name").alias("dataset"), F.lit("a").alias("method"), F.lit("m").alias("model"), F.lit(1).alias("seed"), F.lit(0).alias("fold"))
    found = R.same_runs(runs, runs.repartition(3)), R.same_runs(runs, runs.limit(10)), R.same_runs(runs, runs.unionAll(runs.limit(1)))
    return spark.createDataFrame([found], "same boolean, lacking boolean, doubled boolean")


@query("window_choice", "SELECT * FROM (VALUES ('near', 40), ('far', 0), ('maxdiff', 20)) t(kind, win)")
def window_choice(spark, sf_dir):
    scores = spark.createDataFrame([(0, 0.1), (20, 0.7), (30, 0.7), (40, 0.2)], "window int, score double")
    return G.choose_windows(scores).withColumnRenamed("window", "win")


@query(
    "distinct_versions",
    """WITH s AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-22' THEN 'train' ELSE 'test' END AS split FROM events), p AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY split ORDER BY ts DESC, event_id DESC) AS j FROM s)
SELECT 'near' AS kind, count(*) FILTER (split = 'train' AND i > 200 AND i <= 300) AS n_train, count(*) FILTER (split = 'test' AND j <= 50) AS n_test FROM p
UNION ALL SELECT 'far', count(*) FILTER (split = 'train' AND i <= 100), count(*) FILTER (split = 'test' AND j <= 50) FROM p""",
)
def distinct_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "value").withColumn(SPLIT, F.when(F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz"), TRAIN).otherwise(TEST))
    plan, root, written = G.Windows((0, 200), 100, 50), shared_folder(spark, "versions"), []
    held = G.in_windows(rows, "ts", ["event_id"], plan)
    choice = G.choose_windows(spark.createDataFrame([(0, 0.9), (200, 0.1)], "window int, score double"))

    def write(kind, own):
        own.drop("window", "place").write.parquet(f"{root}/{kind}")
        written.append(kind)

    frame = bind(rows, ["event_id"], FeatureSpec((), ("value",)), F.col(SPLIT) == TRAIN)
    G.write_versions(frame, held, "ts", plan, choice, write)
    parts = [spark.read.parquet(f"{root}/{k}").agg(F.lit(k).alias("kind"), F.count(F.when(F.col(SPLIT) == TRAIN, 1)).alias("n_train"), F.count(F.when(F.col(SPLIT) == TEST, 1)).alias("n_test")) for k in written]
    return X.union_all(parts)


_PROBS = "WITH p AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y, [(o_orderkey % 7 + 1) / s, (o_custkey % 5 + 1) / s, (o_orderkey % 3 + 1) / s] AS p FROM (SELECT *, (o_orderkey % 7 + o_custkey % 5 + o_orderkey % 3 + 3.0) AS s FROM orders))"


@query(
    "metrics_multiclass",
    f"""{_PROBS}, q AS (SELECT y, p, CAST(unnest(range(3)) AS INT) AS c FROM p), r AS (SELECT c, y, p[c + 1] AS s FROM q), a AS (
SELECT c, CAST(y = c AS DOUBLE) AS pos, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0 AS rk FROM r),
u AS (SELECT c, (sum(rk * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (count(*) - sum(pos))) AS auc FROM a GROUP BY c)
SELECT {r6('avg(CAST(list_position(p, list_max(p)) - 1 = y AS DOUBLE))')} AS accuracy, {r6('-avg(ln(p[y + 1]))')} AS log_loss, (SELECT {r6('avg(auc)')} FROM u) AS auc_roc FROM p""",
)
def metrics_multiclass(spark, sf_dir):
    a, b, c = F.col("o_orderkey") % 7 + 1.0, F.col("o_custkey") % 5 + 1.0, F.col("o_orderkey") % 3 + 1.0
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = table(spark, sf_dir, "orders").select(label.alias("y"), F.array(*[x / (a + b + c) for x in (a, b, c)]).alias("p"))
    return M.multiclass(rows, "y", "p")


@query("summary_with_errors", "SELECT 'bad' AS dataset, true AS failed, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'good', false, count(*) FROM orders")
def summary_with_errors(spark, sf_dir):
    found = R.summary({"good": lambda: table(spark, sf_dir, "orders"), "bad": lambda: S.load(spark, "no such dataset")}, lambda df: {"n": df.count()})
    return spark.createDataFrame([(r["dataset"], r["error"] is not None, r.get("n", 0)) for r in found], "dataset string, failed boolean, n long")
