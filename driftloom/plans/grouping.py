"""Queries of scaling, imputation, projection and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import group as G
from driftloom.operators import scale as S
from driftloom.plans.catalog import (
    EV_SQL,
    LI_CATS,
    LI_KEYS,
    LI_NUMS,
    LI_SQL,
    ORD_NUMS,
    ORD_SQL,
    event_frame,
    lineitems,
    orders,
    query,
    r6,
)

_KEYS = ", ".join(LI_KEYS)
_CODED = "coded AS (SELECT li.*, " + ", ".join(f"CAST(dense_rank() OVER (ORDER BY CAST({c} AS VARCHAR)) - 1 AS DOUBLE) AS {c}_code" for c in LI_CATS) + " FROM li)"


def _z(columns, filter_: str = "") -> str:
    f = f"FILTER ({filter_})" if filter_ else ""
    sd = lambda c: f"stddev_pop({c}) {f} OVER ()"
    return ", ".join(f"{r6(f'({c} - avg({c}) {f} OVER ()) / CASE WHEN {sd(c)} > 0 THEN {sd(c)} ELSE 1.0 END')} AS {c}_z" for c in columns)


_COLUMNS = [f"{c}_code" for c in LI_CATS] + list(LI_NUMS)


@query("joint_scaling", f"WITH {LI_SQL}, {_CODED} SELECT {_KEYS}, split, {_z(_COLUMNS)} FROM coded", bench=True)
def joint_scaling(spark, sf_dir):
    return S.zscore(lineitems(spark, sf_dir), codes=True).output()


_TRAIN = "split = 'train'"


@query("train_only_scaling", f"WITH {LI_SQL} SELECT {_KEYS}, split, {_z(LI_NUMS, _TRAIN)} FROM li")
def train_only_scaling(spark, sf_dir):
    return S.zscore(lineitems(spark, sf_dir), train_only=True).output()


@query("no_scaling", f"WITH {LI_SQL} SELECT {_KEYS}, split, {', '.join(f'{r6(c)} AS {c}_raw' for c in LI_NUMS)} FROM li")
def no_scaling(spark, sf_dir):
    frame = lineitems(spark, sf_dir)
    return frame.adding(frame.df.withColumns({f"{c}_raw": F.col(c) for c in LI_NUMS}), *[f"{c}_raw" for c in LI_NUMS]).output()


@query(
    "median_impute_scale",
    f"""WITH {LI_SQL}, gone AS (SELECT {_KEYS}, split, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS d, l_tax AS t FROM li),
filled AS (SELECT {_KEYS}, split, coalesce(d, median(d) FILTER (split = 'train') OVER ()) AS d, t FROM gone)
SELECT {_KEYS}, split, {_z(['d', 't'], _TRAIN)} FROM filled""",
)
def median_impute_scale(spark, sf_dir):
    from driftloom.frame import FeatureSpec, bind
    from driftloom.plans.catalog import table

    rows = table(spark, sf_dir, "lineitem")
    rows = rows.withColumn("d", F.expr("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END")).withColumn("t", F.col("l_tax"))
    frame = bind(rows, LI_KEYS, FeatureSpec((), ("d", "t")), F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return S.zscore(S.impute_median(frame, train_only=True), train_only=True).output()


@query("joint_pca_5")
def joint_pca_5(spark, sf_dir):
    return S.pca(lineitems(spark, sf_dir), 5).output()


@query("pca_train_only_var90")
def pca_train_only_var90(spark, sf_dir):
    return S.pca(lineitems(spark, sf_dir), 0.9, train_only=True).output()


_FUNCS = {"mean": "avg", "count": "count", "std": "stddev_samp"}
_GROUPS, _AGGS = ("l_returnflag", "l_linestatus", "l_linenumber"), ("l_discount", "l_tax")


def _by_group(funcs, tags) -> str:
    """tags: (suffix, filter of the aggregate, filter of the fallback or None)."""
    cells = []
    for g in _GROUPS:
        for a in _AGGS:
            for f in funcs:
                for tag, keep, whole in tags:
                    own = f"CAST({_FUNCS[f]}({a}) {f'FILTER ({keep})' if keep else ''} OVER (PARTITION BY {g}) AS DOUBLE)"
                    if whole is not None:
                        seen = f"count(*) FILTER ({keep}) OVER (PARTITION BY {g})"
                        back = f"CAST({_FUNCS[f]}({a}) {f'FILTER ({whole})' if whole else ''} OVER () AS DOUBLE)"
                        own = f"CASE WHEN {seen} > 0 THEN coalesce({own}, {back}) ELSE {back} END"
                    cells.append(f"{r6(f'coalesce({own}, 0.0)')} AS {g}_{a}_{f}_{tag}")
    return f"WITH {LI_SQL} SELECT {_KEYS}, split, {', '.join(cells)} FROM li"


_ALL = ("mean", "count", "std")


@query("groupby_combined", _by_group(_ALL, [("joint", "", None)]), bench=True)
def groupby_combined(spark, sf_dir):
    return G.grouped(lineitems(spark, sf_dir), _GROUPS, _AGGS).output()


@query("groupby_separate", _by_group(_ALL, [("train", "split = 'train'", ""), ("test", "split = 'test'", "")]))
def groupby_separate(spark, sf_dir):
    return G.grouped(lineitems(spark, sf_dir), _GROUPS, _AGGS, variant="separate").output()


@query("groupby_mean_only", _by_group(("mean",), [("joint", "", None)]))
def groupby_mean_only(spark, sf_dir):
    return G.grouped(lineitems(spark, sf_dir), _GROUPS, _AGGS, ("mean",)).output()


@query("groupby_train_only", _by_group(_ALL, [("train", "split = 'train'", "split = 'train'")]))
def groupby_train_only(spark, sf_dir):
    return G.grouped(lineitems(spark, sf_dir), _GROUPS, _AGGS, variant="train_only").output()


def _ratio(log: bool) -> str:
    mean = lambda s, g: f"(coalesce(avg(value) FILTER (split = '{s}') OVER (PARTITION BY {g}), avg(value) FILTER (split = '{s}') OVER ()) + 1e-6)"
    ratio = lambda g: f"{mean('test', g)} / {mean('train', g)}"
    cell = lambda g: f"ln(greatest({ratio(g)}, 1e-10))" if log else ratio(g)
    return f"WITH {EV_SQL} SELECT event_id, split, " + ", ".join(f"{r6(cell(g))} AS {g}_value_shift_ratio" for g in ("event_type", "user_id")) + " FROM ev"


@query("groupby_shift_ratio_log", _ratio(True), bench=True)
def groupby_shift_ratio_log(spark, sf_dir):
    return G.shift_ratio(event_frame(spark, sf_dir), ("event_type", "user_id"), ("value",)).output()


@query("groupby_shift_ratio_raw", _ratio(False))
def groupby_shift_ratio_raw(spark, sf_dir):
    return G.shift_ratio(event_frame(spark, sf_dir), ("event_type", "user_id"), ("value",), use_log=False).output()


def _cohen(least: int) -> str:
    def cell(g: str) -> str:
        own = lambda f, s: f"{f}(value) FILTER (split = '{s}') OVER (PARTITION BY {g})"
        n1, n2 = own("count", "train"), own("count", "test")
        pooled = f"sqrt((({n1} - 1) * {own('var_samp', 'train')} + ({n2} - 1) * {own('var_samp', 'test')}) / nullif({n1} + {n2} - 2, 0))"
        return f"coalesce(CASE WHEN {n1} >= {least} AND {n2} >= {least} AND {pooled} >= 1e-12 THEN ({own('avg', 'test')} - {own('avg', 'train')}) / {pooled} ELSE 0.0 END, 0.0)"

    return f"WITH {EV_SQL} SELECT event_id, split, " + ", ".join(f"{r6(cell(g))} AS {g}_value_shift_d" for g in ("event_type", "user_id")) + " FROM ev"


@query("groupby_cohen_d", _cohen(5))
def groupby_cohen_d(spark, sf_dir):
    return G.cohen_d(event_frame(spark, sf_dir), ("event_type", "user_id"), ("value",)).output()


@query("groupby_cohen_d_min10", _cohen(10))
def groupby_cohen_d_min10(spark, sf_dir):
    return G.cohen_d(event_frame(spark, sf_dir), ("event_type", "user_id"), ("value",), 10).output()


def _targeted() -> str:
    """The SQL ranks the groups itself by the statistic; three of four stay."""
    cats = ("o_orderstatus", "o_orderpriority", "c_mktsegment", "c_nationkey")
    ctes = []
    for i, c in enumerate(cats):
        ctes.append(f"""k{i} AS (SELECT {c} AS lv, count(*) FILTER (split = 'train') * 1.0 AS a, count(*) FILTER (split = 'test') * 1.0 AS b FROM ord GROUP BY {c}),
x{i} AS (SELECT '{c}' AS col, {i} AS pos, sum(power(a - ea, 2) / ea + power(b - eb, 2) / eb) AS stat FROM (
  SELECT *, (a + b) * sum(a) OVER () / sum(a + b) OVER () AS ea, (a + b) * sum(b) OVER () / sum(a + b) OVER () AS eb FROM k{i}))""")
    top = "top AS (SELECT col FROM (" + " UNION ALL ".join(f"SELECT * FROM x{i}" for i in range(4)) + ") ORDER BY stat DESC, pos LIMIT 3)"
    long = []
    for c in cats:
        for a in ORD_NUMS:
            long.append(f"SELECT o_orderkey, split, '{c}' AS grp, '{a}' AS col, avg({a}) OVER (PARTITION BY {c}) AS m, CAST(count({a}) OVER (PARTITION BY {c}) AS DOUBLE) AS n FROM ord")
    return f"WITH {ORD_SQL}, {', '.join(ctes)}, {top} SELECT o_orderkey, split, grp, col, {r6('m')} AS mean, {r6('n')} AS n FROM ({' UNION ALL '.join(long)}) WHERE grp IN (SELECT col FROM top)"


@query("targeted_groupby_top3", _targeted())
def targeted_groupby_top3(spark, sf_dir):
    out = G.targeted(orders(spark, sf_dir), top=3)
    pairs = dict.fromkeys((f.rsplit("_", 2)[0]) for f in out.features)
    cells = []
    for stem in pairs:
        g = next(c for c in out.spec.cat if stem.startswith(c + "_"))
        cells.append(F.struct(F.lit(g).alias("grp"), F.lit(stem[len(g) + 1 :]).alias("col"), F.col(f"{stem}_mean_joint").alias("mean"), F.col(f"{stem}_count_joint").alias("n")))
    return out.df.select("o_orderkey", F.col("__split").alias("split"), F.inline(F.array(*cells)))


_CAP_AGGS = ("l_discount", "l_tax", "l_quantity")


@query(
    "capped_groupby",
    f"WITH {LI_SQL} SELECT {_KEYS}, split, "
    + ", ".join(f"{r6(f'avg(l_quantity) OVER (PARTITION BY {g})')} AS {g}_l_quantity_mean_joint" for g in _GROUPS)
    + " FROM li",
)
def capped_groupby(spark, sf_dir):
    frame = lineitems(spark, sf_dir)
    plan = G.capped_plan(frame, _GROUPS, _CAP_AGGS, _ALL, cap=3)
    return G.grouped(frame, plan.groups, plan.aggs, plan.funcs).output()
