"""Queries of time slices, raw-table preparation, metrics, provenance and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.frame import SPLIT, TRAIN
from driftloom.functions import metrics as M
from driftloom.functions import two_sample as D
from driftloom.operators import etl as X
from driftloom.operators import runs as R
from driftloom.operators import temporal as G
from driftloom.plans.catalog import EV_SQL, ORD_SQL, event_frame, order_rows, query, r6, table
from driftloom.sources.datasets import synthetic
from driftloom.streaming import stats as S

_NTZ = lambda s: F.lit(s).cast("timestamp_ntz")


# -- time ----------------------------------------------------------------------------------------


@query(
    "temporal_split_gap",
    """SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'train' ELSE 'test' END AS split FROM events
WHERE ts < TIMESTAMP '2024-01-15' OR ts >= TIMESTAMP '2024-01-22'""",
)
def temporal_split_gap(spark, sf_dir):
    rows = G.split_with_gap(table(spark, sf_dir, "events"), "ts", "2024-01-15", "2024-01-22")
    return rows.select("event_id", F.col(SPLIT).alias("split"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn(SPLIT, F.when(F.col("ts") < _NTZ("2024-01-22"), TRAIN).otherwise("test"))


@query(
    "earliest_latest_sample",
    f"""WITH {EV_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY split ORDER BY ts DESC, event_id DESC) AS j FROM ev)
SELECT event_id, split FROM p WHERE (split = 'train' AND i <= 1000) OR (split = 'test' AND j <= 500)""",
)
def earliest_latest_sample(spark, sf_dir):
    return G.earliest_latest(_events(spark, sf_dir), "ts", ["event_id"], 1000, 500).select("event_id", F.col(SPLIT).alias("split"))


_STARTS = f"""{EV_SQL}, n AS (SELECT count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM ev),
s AS (SELECT DISTINCT CAST(floor((a - a // 3) * i / 4.0) AS BIGINT) AS start, a // 3 AS len, b // 2 AS tail FROM n CROSS JOIN range(5) r(i)),
p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY split ORDER BY ts DESC, event_id DESC) AS j FROM ev),
win AS (SELECT s.start, p.* FROM s JOIN p ON (split = 'train' AND i > start AND i <= start + len) OR (split = 'test' AND j <= tail))"""


def _plan(rows):
    n = {r[SPLIT]: r["count"] for r in rows.groupBy(SPLIT).count().collect()}
    return G.gap_windows(n["train"], n["test"], n["train"] // 3, n["test"] // 2, 5)


@query("gap_windows", f"WITH {_STARTS} SELECT start AS win, split, count(*) AS n, min(ts) AS first, max(ts) AS last FROM win GROUP BY 1, 2")
def gap_windows(spark, sf_dir):
    rows = _events(spark, sf_dir)
    held = G.in_windows(rows, "ts", ["event_id"], _plan(rows))
    return held.groupBy(F.col("window").alias("win"), F.col(SPLIT).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(
    "gap_window_shift",
    f"""WITH {_STARTS}, c AS (SELECT start, value AS v, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM win GROUP BY 1, 2)
SELECT start AS win, {r6('max(g)')} AS ks FROM (SELECT start, abs(sum(a) OVER w * 1.0 / sum(a) OVER q - sum(b) OVER w * 1.0 / sum(b) OVER q) AS g
FROM c WINDOW w AS (PARTITION BY start ORDER BY v), q AS (PARTITION BY start)) GROUP BY start""",
)
def gap_window_shift(spark, sf_dir):
    rows = _events(spark, sf_dir)
    plan = _plan(rows)
    held = G.in_windows(rows, "ts", ["event_id"], plan).persist()
    frame, out = event_frame(spark, sf_dir, cats=()), None
    for start in plan.starts:
        one = D.ks(G.window_frame(frame, held, start)).select(F.lit(start).cast("long").alias("win"), "ks")
        out = one if out is None else out.unionByName(one)
    return out


# -- raw tables ------------------------------------------------------------------------------------

_DAYS = (30, 90, 180, 365)


def _cells() -> str:
    out = ["sum(l_extendedprice) AS total_spend"]
    for name, cond in (("returned", "l_returnflag = 'R'"), ("discounted", "l_discount >= 0.05"), ("taxed", "l_tax > 0.02")):
        for tag, keep in [("", cond), *[(f"_{d}", f"{cond} AND age < {d}") for d in _DAYS]]:
            out += [
                f"count(*) FILTER ({keep}) AS has_bought_{name}{tag}",
                f"coalesce(sum(l_quantity) FILTER ({keep}), 0.0) AS has_bought_{name}_q{tag}",
                f"coalesce(sum(l_extendedprice) FILTER ({keep}), 0.0) AS has_bought_{name}_a{tag}",
            ]
    return ", ".join(r6(c.rsplit(" AS ", 1)[0]) + " AS " + c.rsplit(" AS ", 1)[1] if "sum(" in c else c for c in out)


@query(
    "conditional_window_aggregates",
    f"WITH x AS (SELECT *, date_diff('day', CAST(l_shipdate AS DATE), DATE '2001-12-31') AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT o_custkey, {_cells()} FROM x GROUP BY o_custkey",
    bench=True,
)
def conditional_window_aggregates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    age = F.datediff(F.lit("2001-12-31").cast("date"), F.col("l_shipdate").cast("date"))
    conditions = {"returned": F.col("l_returnflag") == "R", "discounted": F.col("l_discount") >= 0.05, "taxed": F.col("l_tax") > 0.02}
    return X.conditional_windows(rows, "o_custkey", age, conditions, "l_quantity", "l_extendedprice", _DAYS)


@query(
    "suffix_aggregates",
    f"""WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice AS priceA, o_orderstatus AS statusM, o_orderdate AS orderD FROM orders)
SELECT o_custkey, {', '.join(r6(f'{f}(priceA)') + f' AS {n}_priceA' for n, f in (('max', 'max'), ('min', 'min'), ('mean', 'avg'), ('std', 'stddev_samp')))},
max_by(statusM, o_orderkey) AS last_statusM, min_by(statusM, o_orderkey) AS first_statusM, count(DISTINCT statusM) AS n_unique_statusM,
{', '.join(r6(f"{f}(CAST(date_diff('day', DATE '1970-01-01', CAST(orderD AS DATE)) AS DOUBLE))") + f' AS {n}_orderD' for n, f in (('max', 'max'), ('min', 'min'), ('mean', 'avg'), ('std', 'stddev_samp')))}
FROM x GROUP BY o_custkey""",
)
def suffix_aggregates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_totalprice").alias("priceA"), F.col("o_orderstatus").alias("statusM"), F.col("o_orderdate").alias("orderD")
    )
    return X.suffix_aggregates(rows, "o_custkey", "o_orderkey")


@query(
    "update_join",
    f"""SELECT c.c_custkey, {r6('coalesce(s.bal, c.c_acctbal)')} AS c_acctbal, c.c_mktsegment FROM customer c
LEFT JOIN (SELECT s_suppkey AS c_custkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS bal FROM supplier) s USING (c_custkey)""",
)
def update_join(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    fixes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.expr("CASE WHEN s_acctbal > 0 THEN s_acctbal END").alias("c_acctbal"))
    return X.update_join(rows, fixes, "c_custkey")


@query("dedupe_first", f"SELECT o_custkey, o_orderkey, {r6('o_totalprice')} AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedupe_first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return X.first_by(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "time_parts",
    """SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(day(ts) AS INTEGER) AS day_of_month, CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(month(ts) AS INTEGER) AS month,
CAST(year(ts) AS INTEGER) AS year, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day FROM events""",
)
def time_parts(spark, sf_dir):
    return X.time_parts(table(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")


@query("bin_columns", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS parity, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS dear FROM orders")
def bin_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 2 * 7 + 3).alias("parity"), F.when(F.col("o_totalprice") > 250000, "y").otherwise("n").alias("dear"), "o_orderstatus")
    found = X.binary_columns(rows, ["parity", "dear", "o_orderstatus"])
    return X.recode_binary(rows, found).select("o_orderkey", *found)


@query(
    "column_rules",
    """WITH x AS (SELECT o_orderstatus, CAST(o_orderkey AS VARCHAR) AS key_text, o_totalprice FROM orders),
r AS (SELECT 'o_orderstatus' AS col, count(DISTINCT o_orderstatus) AS n, true AS text, count(*) AS rows FROM x
UNION ALL SELECT 'key_text', count(DISTINCT key_text), true, count(*) FROM x UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), false, count(*) FROM x UNION ALL SELECT 'fixed', 1, false, count(*) FROM x)
SELECT col AS kept FROM r WHERE n > 1 AND NOT (text AND n >= 0.9 * rows)""",
)
def column_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderkey").cast("string").alias("key_text"), "o_totalprice", F.lit(1).alias("fixed"), F.lit(None).cast("string").alias("gone"))
    return spark.createDataFrame([(c,) for c in X.column_rules(rows, id_share=0.9)], "kept string")


@query(
    "semi_anti_join",
    """SELECT o_orderkey FROM orders WHERE (NOT o_totalprice > 400000 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def semi_anti_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    rows = X.drop_unless_listed(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 400000, customers.where("c_mktsegment = 'BUILDING'"), "o_custkey")
    return rows.join(customers.where("c_acctbal > 0"), "o_custkey", "left_semi").select("o_orderkey")


@query(
    "chained_left_joins",
    f"""SELECT c_custkey, n_orders, {r6('spent')} AS spent, last_order FROM customer
LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1) USING (c_custkey)
LEFT JOIN (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS spent FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (c_custkey)
LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY 1) USING (c_custkey)""",
)
def chained_left_joins(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    sides = [
        rows.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders")),
        rows.where("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.sum("o_totalprice").alias("spent")),
        rows.groupBy("c_custkey").agg(F.max("o_orderdate").alias("last_order")),
    ]
    return X.chain_left(table(spark, sf_dir, "customer").select("c_custkey"), sides, "c_custkey")


@query("sentinel_retype", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN CAST(l_linenumber AS VARCHAR) END AS line FROM lineitem")
def sentinel_retype(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_linenumber").alias("line"))
    return X.retype(X.sentinel_to_null(rows, ["line"], 7), ["line"])


# -- metrics -----------------------------------------------------------------------------------------

_PRED = f"{ORD_SQL}, p AS (SELECT o_orderkey, label AS y, 1.0 / (1.0 + exp(-(o_totalprice - 250000 + 200000 * (o_orderkey % 7 - 3)) / 150000.0)) AS p FROM ord WHERE split = 'test')"


def _predicted(spark, sf_dir):
    rows = order_rows(spark, sf_dir).where(F.col("o_orderdate") >= _NTZ("1999-01-01"))
    p = F.expr("1.0D / (1.0D + exp(-(o_totalprice - 250000 + 200000 * (o_orderkey % 7 - 3)) / 150000.0D))")
    return rows.select("o_orderkey", "o_totalprice", F.when(F.col("o_totalprice") > 250000, 1.0).otherwise(0.0).alias("y"), p.alias("p"))


@query(
    "metrics_classification",
    f"""WITH {_PRED}, r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM p)
SELECT {r6('avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)')} AS accuracy,
{r6('2.0 * sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) / (sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) + sum(y))')} AS f1,
{r6('-avg(y * ln(p) + (1 - y) * ln(1 - p))')} AS log_loss,
{r6('(sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))')} AS auc_roc FROM r""",
)
def metrics_classification(spark, sf_dir):
    return M.classification(_predicted(spark, sf_dir), "y", "p")


@query(
    "metrics_regression",
    f"""WITH x AS (SELECT o_totalprice AS y, 200000 + 0.3 * o_totalprice AS p FROM orders)
SELECT {r6('sqrt(avg(power(y - p, 2)))')} AS rmse, {r6('avg(abs(y - p))')} AS mae, {r6('1 - sum(power(y - p, 2)) / (var_pop(y) * count(*))')} AS r2 FROM x""",
)
def metrics_regression(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("y"), (200000 + 0.3 * F.col("o_totalprice")).alias("p"))
    return M.regression(rows, "y", "p")


@query(
    "metrics_macro_f1",
    f"""WITH x AS (SELECT o_orderstatus AS y, CASE WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 3 = 1 THEN 'O' ELSE o_orderstatus END AS p FROM orders),
c AS (SELECT DISTINCT y AS c FROM x UNION SELECT DISTINCT p FROM x)
SELECT {r6('avg(f1)')} AS f1_macro FROM (SELECT c, 2.0 * (SELECT count(*) FROM x WHERE y = c AND p = c) / ((SELECT count(*) FROM x WHERE y = c) + (SELECT count(*) FROM x WHERE p = c)) AS f1 FROM c)""",
)
def metrics_macro_f1(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("y"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 3 = 1 THEN 'O' ELSE o_orderstatus END").alias("p"))
    return M.macro_f1(rows, "y", "p")


@query("target_skewness", f"SELECT {r6('(avg(power(l_extendedprice, 3)) - 3 * avg(l_extendedprice) * avg(power(l_extendedprice, 2)) + 2 * power(avg(l_extendedprice), 3)) / power(stddev_pop(l_extendedprice), 3)')} AS skew, {r6('corr(l_extendedprice, l_quantity)')} AS correlation FROM lineitem")
def target_skewness(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.skewness("l_extendedprice").alias("skew"), F.corr("l_extendedprice", "l_quantity").alias("correlation"))


# -- provenance and runs ---------------------------------------------------------------------------------


@query(
    "provenance_restore",
    f"""WITH {ORD_SQL} SELECT o_orderkey AS src_id, role, o_orderstatus, o_orderpriority FROM (
SELECT *, 'original' AS role FROM ord WHERE split = 'train' UNION ALL SELECT *, 'pseudo_label' FROM ord WHERE split = 'test' AND o_orderkey % 10 = 0)""",
)
def provenance_restore(spark, sf_dir):
    rows = order_rows(spark, sf_dir)
    raw = rows.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.when(F.col("o_orderdate") < _NTZ("1999-01-01"), "train").otherwise("test").alias("side"))
    lineage = raw.where("side = 'train'").select(F.col("side").alias("src_split"), F.col("o_orderkey").alias("src_id"), F.lit("original").alias("role"))
    added = raw.where("side = 'test' and o_orderkey % 10 = 0").select(F.col("side").alias("src_split"), F.col("o_orderkey").alias("src_id"), F.lit("pseudo_label").alias("role"))
    from driftloom.operators.compose import restore

    return restore(lineage.unionByName(added), raw.withColumnRenamed("side", "src_split").withColumnRenamed("o_orderkey", "src_id"), ["o_orderstatus", "o_orderpriority"]).select("src_id", "role", "o_orderstatus", "o_orderpriority")


_TASKS = """t AS (SELECT n_name AS dataset, r_name AS method, 'm' AS model, 0 AS seed, CAST(f AS INTEGER) AS fold FROM nation CROSS JOIN region CROSS JOIN (SELECT unnest([0, 1, 2]) AS f) WHERE f = 0 OR n_nationkey % 2 = 0),
d AS (SELECT t.*, CASE WHEN length(dataset) % 4 = 0 THEN 'boom' WHEN length(dataset) % 4 = 1 THEN 'tabpfn_skip: too large' END AS error FROM t WHERE (length(dataset) + length(method) + fold) % 2 = 0)"""


def _tasks(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("dataset"), F.lit(1).alias("cost"), F.when(F.col("n_nationkey") % 2 == 0, 3).otherwise(1).alias("folds"))
    methods = table(spark, sf_dir, "region").select(F.col("r_name").alias("method"))
    one = spark.range(1)
    tasks = R.manifest(nations, methods, one.select(F.lit("m").alias("model")), one.select(F.lit(0).alias("seed")))
    n = F.length("dataset")
    error = F.when(n % 4 == 0, "boom").when(n % 4 == 1, "tabpfn_skip: too large")
    return tasks, tasks.where((n + F.length("method") + F.col("fold")) % 2 == 0).withColumn("error", error)


@query("pending_runs", f"WITH {_TASKS} SELECT dataset, method, fold FROM t WHERE (dataset, method, fold) NOT IN (SELECT (dataset, method, fold) FROM d WHERE error IS NULL OR error LIKE 'tabpfn_skip:%')")
def pending_runs(spark, sf_dir):
    tasks, done = _tasks(spark, sf_dir)
    return R.pending(tasks, done).select("dataset", "method", "fold")


@query("collect_runs", f"WITH {_TASKS} SELECT 'done' AS kind, dataset, method, fold FROM d UNION ALL SELECT 'missing', dataset, method, fold FROM t WHERE (dataset, method, fold) NOT IN (SELECT (dataset, method, fold) FROM d)")
def collect_runs(spark, sf_dir):
    tasks, done = _tasks(spark, sf_dir)
    merged, missing = R.collected(tasks, [done.where("fold = 0"), done.where("fold > 0").drop("cost")])
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), "dataset", "method", "fold")
    return pick(merged, "done").unionByName(pick(missing, "missing"))


# -- mergeable statistics and generated data ---------------------------------------------------------------


@query("windowed_levels", "SELECT strftime(ts, '%Y-%m-%d') AS day, 'event_type' AS col, event_type AS value, count(*) AS n FROM events GROUP BY ALL")
def windowed_levels(spark, sf_dir):
    """The statistics that a stream keeps, over the whole table as one batch."""
    out = S.windowed_levels(table(spark, sf_dir, "events"), "ts", ("event_type",))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), F.col("column").alias("col"), "value", "n")


@query(
    "windowed_moments",
    f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(value) AS n, {r6('sum(value)')} AS total, {r6('sum(value * value)')} AS squares FROM events GROUP BY ALL",
)
def windowed_moments(spark, sf_dir):
    out = S.windowed_moments(table(spark, sf_dir, "events"), "ts", "event_type", "value")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), F.col("group").alias("event_type"), "n", "total", "squares")


@query("synthetic_shift")
def synthetic_shift(spark, sf_dir):
    """Shift statistics of generated tables of rising strength."""
    out = None
    for strength in (0.0, 1.0, 3.0):
        one = D.ks(synthetic(spark, 4000, 4000, strength)).select(F.lit(strength).alias("strength"), F.col("column").alias("feature"), "ks")
        out = one if out is None else out.unionByName(one)
    return out
