"""Queries of the encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import encode as E
from driftloom.plans.catalog import LI_CATS, LI_KEYS, LI_SQL, ORD_CATS, ORD_SQL, lineitems, order_rows, orders, query, r6

_KEYS = ", ".join(LI_KEYS)


def _freq(kind: str) -> str:
    share = {
        "joint": lambda c: f"{r6(f'count(*) OVER (PARTITION BY {c}) * 1.0 / count(*) OVER ()')} AS {c}_freq_joint",
        "train": lambda c: f"{r6(f'''count(*) FILTER (split = 'train') OVER (PARTITION BY {c}) * 1.0 / count(*) FILTER (split = 'train') OVER ()''')} AS {c}_freq_train",
        "test": lambda c: f"{r6(f'''count(*) FILTER (split = 'test') OVER (PARTITION BY {c}) * 1.0 / count(*) FILTER (split = 'test') OVER ()''')} AS {c}_freq_test",
    }
    return ", ".join(share[k](c) for c in LI_CATS for k in kind.split())


@query("freq_joint", f"WITH {LI_SQL} SELECT {_KEYS}, split, {_freq('joint')} FROM li", bench=True)
def freq_joint(spark, sf_dir):
    return E.frequency(lineitems(spark, sf_dir), "combined").output()


@query("freq_separate", f"WITH {LI_SQL} SELECT {_KEYS}, split, {_freq('train test')} FROM li", bench=True)
def freq_separate(spark, sf_dir):
    return E.frequency(lineitems(spark, sf_dir), "separate").output()


@query("freq_train_only", f"WITH {LI_SQL} SELECT {_KEYS}, split, {_freq('train')} FROM li")
def freq_train_only(spark, sf_dir):
    return E.frequency(lineitems(spark, sf_dir), "train_only").output()


def _counts_sql(columns=ORD_CATS) -> str:
    """CTEs s_<c>: level, n_train, n_test, totals, levels, y_sum for every column."""
    parts = []
    for c in columns:
        parts.append(f"""s_{c} AS (
  SELECT {c} AS lv, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b,
         sum(label) FILTER (split = 'train') AS y,
         sum(count(*) FILTER (split = 'train')) OVER () AS na, sum(count(*) FILTER (split = 'test')) OVER () AS nb,
         count(*) OVER () AS k, sum(sum(label) FILTER (split = 'train')) OVER () / sum(count(*) FILTER (split = 'train')) OVER () AS ybar
  FROM ord GROUP BY {c})""")
    return ",\n".join(parts)


def _lookup(expressions: dict[str, str], columns=ORD_CATS) -> str:
    """SQL that looks every expression (name suffix to SQL over s_<c>) up by level."""
    cells = [f"{r6(e.replace('@', f's_{c}'))} AS {c}{n}" for c in columns for n, e in expressions.items()]
    joins = " ".join(f"LEFT JOIN s_{c} ON s_{c}.lv = ord.{c}" for c in columns)
    return f"WITH {ORD_SQL},\n{_counts_sql(columns)}\nSELECT o_orderkey, split, {', '.join(cells)} FROM ord {joins}"


_RATIO = "(@.{x} + {a}) / (@.n{x} + {a} * @.k)"


def _share(x: str, alpha: str) -> str:
    return f"((@.{x} + {alpha}) / (@.n{x} + {alpha} * @.k))"


@query("freq_ratio_log", _lookup({"_freq_ratio": f"ln({_share('b', '1.0')} / {_share('a', '1.0')})"}))
def freq_ratio_log(spark, sf_dir):
    return E.frequency_ratio(orders(spark, sf_dir)).output()


_V2 = {"_freq_ratio_v2": f"ln({_share('b', '(1.0 / @.k)')} / {_share('a', '(1.0 / @.k)')})", "_freq_diff": f"{_share('b', '(1.0 / @.k)')} - {_share('a', '(1.0 / @.k)')}"}


@query("freq_ratio_v2_both_ungated", _lookup(_V2))
def freq_ratio_v2_both_ungated(spark, sf_dir):
    return E.frequency_ratio_v2(orders(spark, sf_dir), "both", gated=False).output()


#: Upper 5 % points of the chi-squared law by degrees of freedom, fixed values.
CHI2_95 = {2: 5.991464547107979, 4: 9.487729036781154, 24: 36.41502850180731}


def _gated() -> str:
    gates = []
    for c in ORD_CATS:
        term = lambda x: f"power(s_{c}.{x} - s_{c}.n{x} * (s_{c}.a + s_{c}.b) * 1.0 / (s_{c}.na + s_{c}.nb), 2) / (s_{c}.n{x} * (s_{c}.a + s_{c}.b) * 1.0 / (s_{c}.na + s_{c}.nb))"  # noqa: B023, E731
        bounds = " ".join(f"WHEN {d} THEN {v}" for d, v in CHI2_95.items())
        gates.append(f"g_{c} AS (SELECT CASE WHEN sum({term('a')} + {term('b')}) > CASE max(s_{c}.k) - 1 {bounds} END THEN 1.0 ELSE 0.0 END AS open FROM s_{c})")
    body = _lookup({n: f"({e}) * @g.open" for n, e in _V2.items()})
    for c in ORD_CATS:
        body = body.replace(f"s_{c}g.open", f"g_{c}.open")
    head, tail = body.split("\nSELECT o_orderkey")
    return f"{head},\n{', '.join(gates)}\nSELECT o_orderkey{tail} " + " ".join(f"CROSS JOIN g_{c}" for c in ORD_CATS)


@query("freq_ratio_v2_gated", _gated())
def freq_ratio_v2_gated(spark, sf_dir):
    return E.frequency_ratio_v2(orders(spark, sf_dir), "both", gated=True).output()


@query(
    "label_encode_joint",
    f"WITH {ORD_SQL} SELECT o_orderkey, split, " + ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_code" for c in ORD_CATS) + " FROM ord",
)
def label_encode_joint(spark, sf_dir):
    return E.label_codes(orders(spark, sf_dir)).output()


@query(
    "label_encode_train_only",
    f"WITH {ORD_SQL}, "
    + ", ".join(f"t_{c} AS (SELECT {c} AS lv, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM ord WHERE split = 'train'))" for c in ORD_CATS)
    + " SELECT o_orderkey, split, "
    + ", ".join(f"CAST(coalesce(t_{c}.code, -1) AS INTEGER) AS {c}_code" for c in ORD_CATS)
    + " FROM ord "
    + " ".join(f"LEFT JOIN t_{c} ON t_{c}.lv = ord.{c}" for c in ORD_CATS),
)
def label_encode_train_only(spark, sf_dir):
    return E.label_codes(orders(spark, sf_dir), train_only=True).output()


@query(
    "ordinal_rare_bucket",
    f"""WITH {ORD_SQL}, d AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS month FROM ord),
n AS (SELECT month, count(*) AS n, sum(count(*)) OVER () AS total FROM d GROUP BY month),
c AS (SELECT month, CAST(dense_rank() OVER (ORDER BY CASE WHEN n < 0.0125 * total THEN 1 ELSE 0 END, CASE WHEN n < 0.0125 * total THEN '' ELSE month END) - 1 AS INTEGER) AS month_code FROM n)
SELECT o_orderkey, split, month_code FROM d JOIN c USING (month)""",
)
def ordinal_rare_bucket(spark, sf_dir):
    rows = order_rows(spark, sf_dir).withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    from driftloom.frame import FeatureSpec, bind

    frame = bind(rows, ["o_orderkey"], FeatureSpec(("month",), ()), F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return E.label_codes(frame, min_frequency=0.0125).output()


def _te(adjust: str, invert: bool = False, base: float = 10.0) -> str:
    m = f"({base} / greatest({adjust}, 1e-6))" if invert else f"({base} * {adjust})"
    return f"(coalesce(@.y, 0.0) + {m} * @.ybar) / (@.a + {m})"


_FTR, _FTE = "(@.a * 1.0 / @.na)", "(@.b * 1.0 / @.nb)"
_MEAN = "(SELECT avg(b * 1.0 / nb) FROM @ WHERE b > 0)"
_ADJ = {
    "ratio": f"(({_FTE} + 1e-6) / ({_FTR} + 1e-6))",
    "absolute": f"(({_FTE} + 1e-6) / ({_MEAN} + 1e-6))",
    "diff": f"(abs({_FTE} - {_FTR}) + 1.0)",
}
for _name, _sql, _args in [
    ("ratio", _te(_ADJ["ratio"]), {"mode": "ratio"}),
    ("absolute", _te(_ADJ["absolute"]), {"mode": "absolute"}),
    ("diff", _te(_ADJ["diff"]), {"mode": "diff"}),
    ("ratio_cap5", _te(f"least({_ADJ['ratio']}, 5.0)"), {"mode": "ratio", "cap": 5.0}),
    ("inv_ratio", _te(_ADJ["ratio"], invert=True), {"mode": "ratio", "invert": True}),
    ("standard_m5", _te("1.0", base=5.0), {"mode": "standard", "base": 5.0}),
    ("standard_m10", _te("1.0"), {"mode": "standard"}),
    ("standard_m20", _te("1.0", base=20.0), {"mode": "standard", "base": 20.0}),
]:

    @query(f"target_enc_{_name}", _lookup({"_target_enc": _sql}), bench=_name == "ratio")
    def _target(spark, sf_dir, args=_args):
        return E.target_encoding(orders(spark, sf_dir), **args).output()


def _oof(adjust: str, invert: bool = False) -> str:
    """Straight from the definition: statistics over the train rows of other folds."""
    ctes, cells, joins = [], [], []
    for c in ORD_CATS:
        ctes.append(f"""o_{c} AS (
  SELECT f.fold, s.lv, count(x.o_orderkey) AS a, coalesce(sum(x.label), 0.0) AS y
  FROM (SELECT * FROM range(5) r(fold) UNION ALL SELECT -1) f CROSS JOIN s_{c} s
  LEFT JOIN (SELECT * FROM ord WHERE split = 'train') x ON x.{c} = s.lv AND x.o_orderkey % 5 <> f.fold
  GROUP BY 1, 2)""")
        ctes.append(f"n_{c} AS (SELECT fold, sum(a) AS na FROM o_{c} GROUP BY fold)")
        expr = adjust.replace("@.a", f"o_{c}.a").replace("@.na", f"n_{c}.na").replace("@", f"s_{c}")
        m = f"(10.0 / greatest({expr}, 1e-6))" if invert else f"(10.0 * {expr})"
        cells.append(f"{r6(f'(o_{c}.y + {m} * s_{c}.ybar) / (o_{c}.a + {m})')} AS {c}_target_enc_oof")
        joins.append(f"JOIN s_{c} ON s_{c}.lv = q.{c} JOIN o_{c} ON o_{c}.lv = q.{c} AND o_{c}.fold = q.fold JOIN n_{c} ON n_{c}.fold = q.fold")
    return (
        f"WITH {ORD_SQL},\n{_counts_sql()},\n{', '.join(ctes)},\nq AS (SELECT *, CASE WHEN split = 'train' THEN o_orderkey % 5 ELSE -1 END AS fold FROM ord)\n"
        f"SELECT o_orderkey, split, {', '.join(cells)} FROM q {' '.join(joins)}"
    )


for _name, _sql, _args in [
    ("ratio", _oof(_ADJ["ratio"]), {"mode": "ratio"}),
    ("diff", _oof(_ADJ["diff"]), {"mode": "diff"}),
    ("absolute", _oof(_ADJ["absolute"]), {"mode": "absolute"}),
    ("ratio_cap5", _oof(f"least({_ADJ['ratio']}, 5.0)"), {"mode": "ratio", "cap": 5.0}),
    ("inv_ratio", _oof(_ADJ["ratio"], True), {"mode": "ratio", "invert": True}),
]:

    @query(f"target_enc_oof_{_name}", _sql, bench=_name == "ratio")
    def _target_oof(spark, sf_dir, args=_args):
        return E.target_encoding_oof(orders(spark, sf_dir), F.col("o_orderkey") % 5, **args).output()
