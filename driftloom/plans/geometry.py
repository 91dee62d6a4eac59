"""Queries of transport, neighbours, augmentation, propagation, leaves, clusters and weights."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from driftloom.frame import SPLIT, WEIGHT
from driftloom.operators import density as C
from driftloom.operators import domain as A
from driftloom.operators import neighbors as N
from driftloom.operators import propagate as P
from driftloom.operators import transport as T
from driftloom.plans.catalog import EV_SQL, LI_SQL, emb_sql, event_frame, lineitems, orders, query, r6, table, vectors

DIMS = 64
_E = [f"e{i}" for i in range(DIMS)]


# -- transport ------------------------------------------------------------------------------


def _ot(columns: list[str]) -> str:
    """CTEs d_<c>: event_id and displacement, straight from ranks and sorted arrays."""
    out = []
    for c in columns:
        out.append(f"""d_{c} AS (
  WITH u AS (SELECT event_id, split, {c} AS x, rank() OVER (PARTITION BY split ORDER BY {c}) + (count(*) OVER (PARTITION BY split, {c}) - 1) / 2.0 AS r,
                    count(*) OVER (PARTITION BY split) AS n, (SELECT count(*) FROM w) - count(*) OVER (PARTITION BY split) AS m FROM w),
  q AS (SELECT *, greatest(1.0, least(m * 1.0, r / (n + 1) * (m + 1))) AS pos FROM u),
  s AS (SELECT split, {c} AS x, row_number() OVER (PARTITION BY split ORDER BY {c}) AS i FROM w)
  SELECT q.event_id, a.x + (q.pos - floor(q.pos)) * (b.x - a.x) - q.x AS disp
  FROM q JOIN s a ON a.split <> q.split AND a.i = CAST(floor(q.pos) AS BIGINT)
         JOIN s b ON b.split <> q.split AND b.i = least(CAST(floor(q.pos) AS BIGINT) + 1, q.m))""")
    return ",\n".join(out)


_OT_W = f"{EV_SQL}, w AS (SELECT event_id, split, value, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS code, value * value AS square FROM ev)"


@query(
    "ot_displacement",
    f"""WITH {_OT_W}, {_ot(['code', 'value'])}
SELECT w.event_id, split, {r6('d_code.disp')} AS ot_disp_event_type_code, {r6('d_value.disp')} AS ot_disp_value,
       {r6('sqrt(d_code.disp * d_code.disp + d_value.disp * d_value.disp)')} AS ot_disp_magnitude
FROM w JOIN d_code USING (event_id) JOIN d_value USING (event_id)""",
    bench=True,
)
def ot_displacement(spark, sf_dir):
    return T.displacement(event_frame(spark, sf_dir, cats=("event_type",))).output()


def _scaled(c: str) -> str:
    return f"(d_{c}.disp / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM w))"


@query(
    "ot_displacement_v2_summary",
    f"""WITH {_OT_W}, {_ot(['value', 'square'])}
SELECT w.event_id, split, {r6(f'(abs({_scaled("value")}) + abs({_scaled("square")})) / 2')} AS ot_mean_abs_disp,
       {r6(f'greatest(abs({_scaled("value")}), abs({_scaled("square")}))')} AS ot_max_abs_disp,
       {r6(f'sqrt(power({_scaled("value")}, 2) + power({_scaled("square")}, 2))')} AS ot_disp_magnitude
FROM w JOIN d_value USING (event_id) JOIN d_square USING (event_id)""",
)
def ot_displacement_v2_summary(spark, sf_dir):
    frame = event_frame(spark, sf_dir, cats=())
    frame = replace(frame, df=frame.df.withColumn("square", F.col("value") * F.col("value")), spec=replace(frame.spec, num=("value", "square")))
    return T.displacement_v2(frame, "summary_only", columns=("value", "square")).output()


# -- neighbours -----------------------------------------------------------------------------

_SPACE = f"""{emb_sql(DIMS)},
z AS (SELECT vec_id, split, label, {', '.join(f'({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END AS {c}' for c in _E)} FROM emb)"""
_D2 = " + ".join(f"power(a.{c} - b.{c}, 2)" for c in _E)


def _knn(k: int) -> str:
    return f"""nn AS (SELECT * FROM (
  SELECT a.vec_id AS id, a.split AS s, b.vec_id AS nid, b.split AS t, sqrt({_D2}) AS d,
         row_number() OVER (PARTITION BY a.vec_id, b.split ORDER BY sqrt({_D2}), b.vec_id) AS rn
  FROM z a JOIN z b ON a.vec_id <> b.vec_id) WHERE rn <= {k})"""


_DIST = f"""WITH {_SPACE}, {_knn(5)}, f AS (
  SELECT id AS vec_id, s AS split, avg(d) FILTER (s <> t) AS o, min(d) FILTER (s <> t) AS m, avg(d) FILTER (s = t) AS own, min(d) FILTER (t = 'train') AS tr FROM nn GROUP BY id, s)"""


@query(
    "nearest_test_k5",
    f"""{_DIST} SELECT vec_id, split, {r6('o')} AS mean_dist_to_other, {r6('m')} AS min_dist_to_other, {r6('own')} AS mean_dist_self_density,
{r6('tr')} AS nearest_train_dist, {r6("CASE WHEN split = 'train' THEN 1.0 / (1.0 + o) END")} AS __weight FROM f""",
    bench=True,
)
def nearest_test_k5(spark, sf_dir):
    return N.nearest_test(vectors(spark, sf_dir, DIMS), 5).output()


@query(
    "nearest_test_rel_k5",
    f"""{_DIST} SELECT vec_id, split, {r6('o / (own + 1e-8)')} AS rel_dist_to_other, {r6('ln(1 + o / (own + 1e-8))')} AS log_rel_dist_to_other,
{r6('own')} AS mean_dist_self_density, {r6('tr')} AS nearest_train_dist, {r6("CASE WHEN split = 'train' THEN 1.0 / (1.0 + o / (own + 1e-8)) END")} AS __weight FROM f""",
)
def nearest_test_rel_k5(spark, sf_dir):
    return N.nearest_test(vectors(spark, sf_dir, DIMS), 5, relative=True).output()


_LEAVES = f"{emb_sql(DIMS)}, z AS (SELECT vec_id, split, {', '.join(f'floor({c} * 3) AS {c}' for c in _E)} FROM emb)"
_HAMMING = "(" + " + ".join(f"CASE WHEN a.{c} <> b.{c} THEN 1.0 ELSE 0.0 END" for c in _E) + f") / {DIMS}"


def _leaves(spark, sf_dir):
    frame = vectors(spark, sf_dir, DIMS)
    return frame.df.select(F.col("vec_id").alias("id"), F.col(SPLIT).alias("split"), F.array(*[F.floor(F.col(c) * 3).cast("double") for c in _E]).alias("vec"))


@query(
    "hamming_knn",
    f"""WITH {_LEAVES}, p AS (SELECT a.vec_id AS id, a.split AS s, b.split AS t, {_HAMMING} AS d, b.vec_id AS nid FROM z a JOIN z b ON a.vec_id <> b.vec_id),
o AS (SELECT id, s, avg(d) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS rn FROM p WHERE s <> t) WHERE rn <= 5 GROUP BY id, s),
x AS (SELECT id, avg(CASE WHEN s <> t THEN 1.0 ELSE 0.0 END) AS f FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS rn FROM p) WHERE rn <= 5 GROUP BY id)
SELECT id, s AS split, {r6('d')} AS leaf_hamming_dist_to_other, {r6('f')} AS leaf_cross_split_frac FROM o JOIN x USING (id)""",
)
def hamming_knn(spark, sf_dir):
    return N.leaf_distance(_leaves(spark, sf_dir), 5)


def _tdda(share: str, weight: str, extra: str = "") -> str:
    cells = ", ".join(f"{r6(f'{share.format(c=c)} * x.{c} + (1 - {share.format(c=c)}) * y.{c}')} AS {c}" for c in _E)
    plain = ", ".join(f"{r6(c)} AS {c}" for c in _E)
    return f"""WITH {_SPACE}, {_knn(5)}{extra}
SELECT vec_id, CASE WHEN split = 'train' THEN label * 1.0 END AS target, {plain}, CASE WHEN split = 'train' THEN 1.0 END AS weight, 'original' AS role FROM emb
UNION ALL SELECT x.vec_id, x.label * 1.0, {cells}, {r6(weight)}, 'tdda_augment'
FROM nn JOIN emb x ON x.vec_id = nn.id JOIN emb y ON y.vec_id = nn.nid WHERE nn.s = 'train' AND nn.t = 'test' AND nn.rn = 1"""


def _augmented(frame):
    return frame.df.select("vec_id", F.col("__target").alias("target"), *_E, F.col(WEIGHT).alias("weight"), F.col("__role").alias("role"))


@query("tdda_k5", _tdda("0.7", "0.5"))
def tdda_k5(spark, sf_dir):
    return _augmented(N.augmented(vectors(spark, sf_dir, DIMS), 5, 0.7, 1))


_KS = ", shift AS (SELECT " + ", ".join(
    f"(SELECT max(abs(a / na - b / nb)) FROM (SELECT sum(CASE WHEN split = 'train' THEN 1.0 ELSE 0 END) OVER w AS a, sum(CASE WHEN split = 'test' THEN 1.0 ELSE 0 END) OVER w AS b, "
    f"count(*) FILTER (split = 'train') OVER () AS na, count(*) FILTER (split = 'test') OVER () AS nb FROM emb WINDOW w AS (ORDER BY {c}))) AS {c}"
    for c in _E
) + ")"


@query("tdda_v2_k5", _tdda("(0.7 + 0.3 * (1 - (SELECT {c} FROM shift)))", "0.5 / (1 + nn.d)", _KS))
def tdda_v2_k5(spark, sf_dir):
    return _augmented(N.augmented(vectors(spark, sf_dir, DIMS), 5, 0.7, 1, per_feature=True, by_distance=True))


@query(
    "consensus_given_scores",
    f"""WITH {_SPACE}, {_knn(5)}, g AS (SELECT vec_id, label / 10.0 AS p FROM emb),
j AS (SELECT id, s, g.p AS own, h.p AS o, 1.0 / greatest(d, 1e-4) AS w FROM nn JOIN g ON g.vec_id = id JOIN g h ON h.vec_id = nid WHERE s = t),
m AS (SELECT id, s, any_value(own) AS own, sum(w * o) / sum(w) AS mu, sum(w * o * o) / sum(w) AS sq, avg(CASE WHEN (o >= 0.5) = (own >= 0.5) THEN 1.0 ELSE 0.0 END) AS agree FROM j GROUP BY id, s)
SELECT id, s AS split, {r6('own')} AS nbr_consensus_self, {r6('mu')} AS nbr_consensus_mean, round(sqrt(greatest(0.0, sq - mu * mu)), 5) AS nbr_consensus_std, {r6('own - mu')} AS nbr_consensus_diff, {r6('agree')} AS nbr_consensus_agree FROM m""",
)
def consensus_given_scores(spark, sf_dir):
    frame = vectors(spark, sf_dir, DIMS)
    scores = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") / 10.0).alias("score"))
    return N.consensus(N.space(frame), scores, 5).withColumn("nbr_consensus_std", F.round("nbr_consensus_std", 5))


def _steps(n: int) -> str:
    out = []
    for i in range(n):
        before = "f0" if i == 0 else f"f{i}"
        out.append(f"""f{i + 1} AS (SELECT {before}.id, known, y, CASE WHEN known THEN 0.5 * y + 0.5 * s.v ELSE s.v END AS f
  FROM {before} JOIN (SELECT g.src, sum(g.w * p.f) AS v FROM g JOIN {before} p ON p.id = g.dst GROUP BY g.src) s ON s.src = {before}.id)""")
    return ", ".join(out)


@query(
    "label_propagation_3_iters",
    f"""WITH {_SPACE},
near AS (SELECT * FROM (SELECT a.vec_id AS id, b.vec_id AS nid, sqrt({_D2}) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt({_D2}), a.vec_id <> b.vec_id, b.vec_id) AS rn FROM z a CROSS JOIN z b) WHERE rn <= 5),
sig AS (SELECT median(d) + 1e-8 AS sigma FROM near WHERE rn = 5),
e AS (SELECT id AS src, nid AS dst, exp(-d * d / (sigma * sigma)) AS w FROM near CROSS JOIN sig),
b AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY 1, 2),
g AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM b),
f0 AS (SELECT vec_id AS id, split = 'train' AS known, label * 1.0 AS y, CASE WHEN split = 'train' THEN label * 1.0 ELSE (SELECT avg(label) FROM emb WHERE split = 'train') END AS f FROM emb),
{_steps(3)}
SELECT id, {r6('f')} AS f FROM f3""",
)
def label_propagation_3_iters(spark, sf_dir):
    frame = vectors(spark, sf_dir, DIMS)
    edges = P.graph(N.space(frame), 5)
    mean = frame.train.agg(F.avg("__target").alias("mean"))
    rows = frame.df.crossJoin(F.broadcast(mean)).select(F.col("vec_id").alias("id"), F.lit(0).alias("run"), F.col("__target").alias("fixed"), F.coalesce("__target", "mean").alias("start"))
    return P.propagate(edges, rows, 0.5, 3, tolerance=None).select("id", "f")


# -- leaves and clusters -----------------------------------------------------------------------


@query(
    "leaf_occupancy_given_leaves",
    f"""WITH {_LEAVES}, long AS ({' UNION ALL '.join(f"SELECT vec_id, split, {i} AS tree, {c} AS leaf FROM z" for i, c in enumerate(_E))}),
c AS (SELECT tree, leaf, count(*) FILTER (split = 'train') * 1.0 / count(*) AS tf, count(*) * 1.0 AS n FROM long GROUP BY tree, leaf)
SELECT vec_id AS id, split, {r6("avg(CASE WHEN CASE WHEN split = 'train' THEN 1 - tf ELSE tf END < 0.1 THEN 1.0 ELSE 0.0 END)")} AS leaf_minority_ratio, {r6('avg(tf)')} AS leaf_avg_train_frac, {r6('avg(n)')} AS leaf_avg_size
FROM long JOIN c USING (tree, leaf) GROUP BY vec_id, split""",
)
def leaf_occupancy_given_leaves(spark, sf_dir):
    return C.leaf_confidence(_leaves(spark, sf_dir))


@query(
    "cluster_stats_given_labels",
    f"""WITH {LI_SQL}, c AS (SELECT l_linenumber AS cluster, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b, sum(count(*)) OVER () AS n FROM li GROUP BY 1)
SELECT cluster, {r6('(a + b) * 1.0 / n')} AS cluster_relative_size, {r6('a / (a + b + 1e-10)')} AS cluster_train_frac,
{r6('CASE WHEN a = 0 OR b = 0 THEN 1.0 WHEN a / (a + b + 1e-10) < 0.05 OR a / (a + b + 1e-10) > 0.95 THEN 0.1 ELSE b * 1.0 / a END')} AS cluster_weight FROM c""",
)
def cluster_stats_given_labels(spark, sf_dir):
    rows = lineitems(spark, sf_dir, cats=(), nums=()).df
    return C.cluster_statistics(rows.select(F.col("l_linenumber").alias("cluster"), F.col(SPLIT).alias("split")))


# -- weights from a given score ------------------------------------------------------------------

_SCORE = f"{EV_SQL}, t AS (SELECT event_id, 0.05 + 0.9 * (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS p FROM ev), r AS (SELECT event_id, p / (1 - p + 1e-8) AS w FROM t)"


def _scored(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    ends = rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    p = 0.05 + 0.9 * (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return rows.crossJoin(F.broadcast(ends)).select("event_id", A.raw_weight(p).alias("w"))


for _name, _sql in {
    "hard": "greatest(0.1, least(10.0, w))",
    "normalize": "w / sum(w) OVER () * count(*) OVER ()",
    "winsorize": "greatest((SELECT quantile_cont(w, 0.05) FROM r), least((SELECT quantile_cont(w, 0.95) FROM r), w))",
}.items():

    @query(f"weights_{_name}", f"WITH {_SCORE} SELECT event_id, {r6(_sql)} AS w FROM r")
    def _weights(spark, sf_dir, name=_name):
        return A.clipped(_scored(spark, sf_dir), "w", name)


@query("ess", f"WITH {_SCORE} SELECT {r6('sum(w) * sum(w) / sum(w * w)')} AS ess, {r6('sum(w) * sum(w) / sum(w * w) / count(*)')} AS ess_ratio FROM r")
def ess(spark, sf_dir):
    return A.effective_size(_scored(spark, sf_dir), "w")


# -- learned: no SQL ---------------------------------------------------------------------------


@query("domain_scores_lr")
def domain_scores_lr(spark, sf_dir):
    return A.domain_scores(event_frame(spark, sf_dir, cats=("event_type",)), "logreg")


@query("adversarial_both")
def adversarial_both(spark, sf_dir):
    return A.adversarial(event_frame(spark, sf_dir, cats=("event_type",)), "logreg", "both", tempering="pad").output()


@query("domain_auc")
def domain_auc(spark, sf_dir):
    return spark.createDataFrame([(float(A.domain_auc(event_frame(spark, sf_dir, cats=("event_type",)), "rf")),)], "auc double")


@query("pseudo_label_round")
def pseudo_label_round(spark, sf_dir):
    out = A.pseudo_label(orders(spark, sf_dir), 0.9, 1, classifier="logreg")
    return out.df.select("o_orderkey", F.col(SPLIT).alias("split"), F.col(WEIGHT).alias("weight"), F.col("__role").alias("role"))


@query("kmeans_membership")
def kmeans_membership(spark, sf_dir):
    return C.cluster_membership(vectors(spark, sf_dir, DIMS), 5, starts=2).output()


@query("leaf_density_rf")
def leaf_density_rf(spark, sf_dir):
    frame = vectors(spark, sf_dir, DIMS)
    return C.leaf_density(frame, trees=20, depth=4, folds=2).output()


@query("label_prop_soft")
def label_prop_soft(spark, sf_dir):
    return P.label_propagation(vectors(spark, sf_dir, DIMS)).output()


