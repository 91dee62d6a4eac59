"""Queries of two-sample statistics and column selection."""

from __future__ import annotations


from pyspark.sql import functions as F

from driftloom.functions import two_sample as D
from driftloom.operators import encode as E
from driftloom.operators import select as L
from driftloom.plans.catalog import LI_CATS, LI_KEYS, LI_NUMS, LI_SQL, lineitems, query, r6

_LONG = "num AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v, split, l_orderkey FROM li" for c in LI_NUMS) + ")"
_GAP = f"""{LI_SQL}, {_LONG},
cnt AS (SELECT col, v, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM num GROUP BY col, v),
gap AS (SELECT col, v, abs(sum(a) OVER w * 1.0 / sum(a) OVER p - sum(b) OVER w * 1.0 / sum(b) OVER p) AS g,
               lead(v) OVER (PARTITION BY col ORDER BY v) - v AS step
        FROM cnt WINDOW w AS (PARTITION BY col ORDER BY v), p AS (PARTITION BY col)),
ks AS (SELECT col, max(g) AS ks, sum(g * coalesce(step, 0)) AS w1 FROM gap GROUP BY col)"""
_CATS = "cat AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v, split, l_orderkey FROM li" for c in LI_CATS) + ")"
_CHI = f"""{_CATS},
lv AS (SELECT col, v, count(*) FILTER (split = 'train') * 1.0 AS a, count(*) FILTER (split = 'test') * 1.0 AS b FROM cat GROUP BY col, v),
ex AS (SELECT *, (a + b) * sum(a) OVER p / sum(a + b) OVER p AS ea, (a + b) * sum(b) OVER p / sum(a + b) OVER p AS eb,
              count(*) OVER p AS k, sum(a + b) OVER p AS n, a / sum(a) OVER p AS pa, b / sum(b) OVER p AS pb FROM lv WINDOW p AS (PARTITION BY col)),
chi AS (SELECT col, max(k) - 1 AS df, max(n) AS n, sum(power(a - ea, 2) / ea + power(b - eb, 2) / eb) AS raw,
               sum(CASE WHEN k = 2 THEN power(abs(a - ea) - least(0.5, abs(a - ea)), 2) / ea + power(abs(b - eb) - least(0.5, abs(b - eb)), 2) / eb
                        ELSE power(a - ea, 2) / ea + power(b - eb, 2) / eb END) AS stat FROM ex GROUP BY col)"""


@query("ks_by_column", f"WITH {_GAP} SELECT col AS feature, {r6('ks')} AS ks FROM ks", bench=True)
def ks_by_column(spark, sf_dir):
    return D.ks(lineitems(spark, sf_dir)).select(F.col("column").alias("feature"), "ks")


@query("wasserstein_by_column", f"WITH {_GAP} SELECT col AS feature, {r6('w1')} AS wasserstein FROM ks")
def wasserstein_by_column(spark, sf_dir):
    return D.ks(lineitems(spark, sf_dir)).select(F.col("column").alias("feature"), "wasserstein")


@query("chi2_by_column", f"WITH {LI_SQL}, {_CHI} SELECT col AS feature, {r6('stat')} AS statistic, CAST(df AS BIGINT) AS df FROM chi", bench=True)
def chi2_by_column(spark, sf_dir):
    return D.chi2_statistic(D.split_counts(lineitems(spark, sf_dir))).select(F.col("column").alias("feature"), "statistic", F.col("df").cast("long").alias("df"))


@query("chi2_normalised", f"WITH {LI_SQL}, {_CHI} SELECT col AS feature, {r6('raw / greatest(df, 1)')} AS score FROM chi")
def chi2_normalised(spark, sf_dir):
    return D.chi2_normalised(D.split_counts(lineitems(spark, sf_dir))).select(F.col("column").alias("feature"), "score")


@query("cramers_v", f"WITH {LI_SQL}, {_CHI} SELECT col AS feature, {r6('least(1.0, sqrt(stat / n))')} AS cramers_v FROM chi")
def cramers_v(spark, sf_dir):
    return D.cramers_v(D.split_counts(lineitems(spark, sf_dir))).select(F.col("column").alias("feature"), "cramers_v")


_KL = lambda x: f"CASE WHEN {x} > 0 THEN {x} * ln({x} / ((pa + pb) / 2)) ELSE 0 END"
_JS = f"SELECT col, (sum({_KL('pa')}) + sum({_KL('pb')})) / 2 AS js, sum(abs(pa - pb)) / 2 AS tv FROM ex GROUP BY col"


@query("js_tv_by_column", f"WITH {LI_SQL}, {_CHI} SELECT col AS feature, {r6('js')} AS js, {r6('tv')} AS tv FROM ({_JS})")
def js_tv_by_column(spark, sf_dir):
    return D.divergence(D.split_counts(lineitems(spark, sf_dir))).select(F.col("column").alias("feature"), "js", "tv")


@query(
    "moments_by_column",
    f"WITH {LI_SQL}, {_LONG} SELECT col AS feature, "
    + ", ".join(f"{r6(f'''{f}(v) FILTER (split = '{s}')''')} AS {n}_{s}" for n, f in (("mean", "avg"), ("std", "stddev_pop")) for s in ("train", "test"))
    + " FROM num GROUP BY col",
)
def moments_by_column(spark, sf_dir):
    return D.moments(lineitems(spark, sf_dir)).withColumnRenamed("column", "feature")


@query(
    "shift_report",
    f"""WITH {_GAP}, {_CHI}
SELECT col AS feature, 'numeric' AS type, {r6('ks')} AS distance, {r6('w1')} AS second FROM ks
UNION ALL SELECT col, 'categorical', {r6('js')}, {r6('tv')} FROM ({_JS})""",
)
def shift_report(spark, sf_dir):
    return D.shift_report(lineitems(spark, sf_dir)).drop("p_value", "significant")


@query("significant_share")
def significant_share(spark, sf_dir):
    """Shares of features that shift beyond the corrected level, and the overall score."""
    report = D.shift_report(lineitems(spark, sf_dir))
    parts = {r["type"]: r for r in report.groupBy("type").agg(F.avg(F.col("significant").cast("int")).alias("share"), F.avg("distance").alias("mean")).collect()}
    num, cat = parts.get("numeric"), parts.get("categorical")
    score = D.overall_score(num and num["mean"], cat and cat["mean"], None)
    return spark.createDataFrame([(num and float(num["share"]), cat and float(cat["share"]), score)], "numeric double, categorical double, overall double")


_SCORED = f"{_GAP}, {_CHI}, scored AS (SELECT col, ks AS score FROM ks UNION ALL SELECT col, least(1.0, sqrt(stat / n)) FROM chi)"


@query("select_shift_top_k", f"WITH {_SCORED} SELECT col AS feature, {r6('score')} AS score FROM scored ORDER BY scored.score DESC LIMIT 3")
def select_shift_top_k(spark, sf_dir):
    picked = L.select_shifted(lineitems(spark, sf_dir), top=3, comparable=True)
    return spark.createDataFrame([(c, float(picked.scores[c])) for c in (*picked.cat, *picked.num)], "feature string, score double")


@query(
    "select_cumshift",
    f"""WITH {_GAP}, run AS (SELECT col, ks, sum(ks) OVER (ORDER BY ks DESC) - ks AS before, sum(ks) OVER () AS total, row_number() OVER (ORDER BY ks DESC) AS k FROM ks)
SELECT col AS feature FROM run WHERE k <= 3 OR before < 0.9 * total""",
)
def select_cumshift(spark, sf_dir):
    scores = {r["column"]: float(r["ks"]) for r in D.ks(lineitems(spark, sf_dir)).collect()}
    return spark.createDataFrame([(c,) for c in L.select_cumulative(scores, 0.9, 3)], "feature string")


def _votes() -> str:
    per = []
    for k in range(3):
        per.append(f"""SELECT col, row_number() OVER (ORDER BY max(g) DESC) AS rank FROM (
  SELECT col, v, abs(sum(a) OVER w * 1.0 / sum(a) OVER p - sum(b) OVER w * 1.0 / sum(b) OVER p) AS g FROM (
    SELECT col, v, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM num WHERE split = 'test' OR l_orderkey % 3 = {k} GROUP BY col, v)
  WINDOW w AS (PARTITION BY col ORDER BY v), p AS (PARTITION BY col)) GROUP BY col""")
    return f"WITH {LI_SQL}, {_LONG}, picked AS ({' UNION ALL '.join(f'SELECT * FROM ({p}) WHERE rank <= 2' for p in per)}) SELECT col AS feature, count(*) AS votes FROM picked GROUP BY col"


@query("oof_votes", _votes())
def oof_votes(spark, sf_dir):
    frame = lineitems(spark, sf_dir, cats=())
    picked = L.select_votes(frame, lambda f: L.select_shifted(f, top=2), F.col("l_orderkey") % 3, 3, "union")
    return spark.createDataFrame([(c, round(picked.scores[c] * 3)) for c in picked.num], "feature string, votes long")


@query(
    "selective_freq",
    f"WITH {LI_SQL}, {_CHI}, best AS (SELECT col FROM chi ORDER BY sqrt(stat / n) DESC LIMIT 1), n AS (SELECT count(*) AS n FROM li) SELECT {', '.join(LI_KEYS)}, split, best.col AS chosen, "
    + r6("CASE best.col " + " ".join(f"WHEN '{c}' THEN count(*) OVER (PARTITION BY {c}) * 1.0 / n.n" for c in LI_CATS) + " END")
    + " AS freq FROM li CROSS JOIN best CROSS JOIN n",
)
def selective_freq(spark, sf_dir):
    frame = lineitems(spark, sf_dir, nums=())
    picked = L.select_shifted(frame, top=1, comparable=True)
    out = L.selective(frame, lambda f: E.frequency(f, "combined"), picked)
    return out.df.select(*LI_KEYS, F.col("__split").alias("split"), F.lit(picked.cat[0]).alias("chosen"), F.col(f"{picked.cat[0]}_freq_joint").alias("freq"))


@query("domain_importance")
def domain_importance(spark, sf_dir):
    picked = L.select_domain(lineitems(spark, sf_dir), fraction=0.5)
    return spark.createDataFrame([(c, float(s), c in (*picked.cat, *picked.num)) for c, s in picked.scores.items()], "feature string, importance double, chosen boolean")


