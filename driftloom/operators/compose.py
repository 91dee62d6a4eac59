"""Methods in sequence, their weights and lineage, and the registry of methods by key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.frame import ROLE, SPLIT, SRC_ID, SRC_SPLIT, TEST, TRAIN, WEIGHT, ContractError, SplitFrame
from driftloom.operators import density, domain, encode, group, neighbors, propagate, scale, transport
from driftloom.operators import select as chooser
from driftloom.operators.embed import joint_tsne

Method = Callable[[SplitFrame], SplitFrame]


def restore(lineage: DataFrame, raw: DataFrame, columns: list[str]) -> DataFrame:
    """Raw columns of every row by its source split and id; lineage has src_split and src_id."""
    return lineage.join(raw.select("src_split", "src_id", *columns), ["src_split", "src_id"], "left")


def check_lineage(frame: SplitFrame) -> None:
    """Fail unless every train row has a source that exists and test rows are all there once."""
    if SRC_ID not in frame.df.columns:
        return
    (key,) = frame.ids
    sources = frame.df.where(F.col(ROLE) == "original").select(F.col(SPLIT).alias("s"), F.col(key).alias("i"))
    rows = frame.df.where(F.col(ROLE) != "original").select(F.col(SRC_SPLIT).alias("s"), F.col(SRC_ID).alias("i"))
    if rows.join(sources, ["s", "i"], "left_anti").head(1):
        raise ContractError("a row's source does not exist")
    bad = frame.df.where(~F.col(SRC_SPLIT).isin(TRAIN, TEST) | F.col(SRC_ID).isNull())
    if bad.head(1):
        raise ContractError("a row has no source")


def pipeline(*steps: Method) -> Method:
    """Steps one after the other; raw categoricals stay in the frame, and weights multiply.

    A step that appends rows must give them a source; rows that had no weight count 1. What a
    step gives is persisted, since the statistics of the next ones read it more than once.
    """

    def run(frame: SplitFrame) -> SplitFrame:
        for step in steps:
            before = WEIGHT in frame.df.columns
            held = replace(frame, df=frame.df.withColumnRenamed(WEIGHT, "__before")) if before else frame
            after = step(held)
            if before:
                own = F.coalesce(F.col(WEIGHT), F.lit(1.0)) if WEIGHT in after.df.columns else F.lit(1.0)
                weight = F.when(F.col(SPLIT) == TRAIN, F.coalesce(F.col("__before"), F.lit(1.0)) * own)
                after = replace(after, df=after.df.withColumn(WEIGHT, weight).drop("__before"))
            frame = replace(after, df=after.df.persist(), prescaled=frame.prescaled or after.prescaled)
        return frame

    return run


def plain_pipeline(*steps: Method) -> Method:
    """Steps without the categoricals' return: a step after the first that replaces them finds numbers alone."""

    def run(frame: SplitFrame) -> SplitFrame:
        whole = frame.spec
        for i, step in enumerate(steps):
            frame = replace(pipeline(step)(frame), spec=replace(whole, cat=()))
            if i + 1 < len(steps):
                frame = replace(frame, spec=replace(frame.spec, num=(*whole.num, *frame.features)))
        return replace(frame, spec=whole)

    return run


def _groups(frame: SplitFrame) -> tuple[str, ...]:
    """Categoricals of at most 100 levels in train."""
    if not frame.spec.cat:
        return ()
    n = frame.train.agg(*[F.count_distinct(c).alias(c) for c in frame.spec.cat]).first()
    return tuple(c for c in frame.spec.cat if n[c] <= 100)


def grouped(variant: str = "combined", funcs: tuple[str, ...] = ("mean", "count", "std")) -> Method:
    return lambda f: group.grouped(f, _groups(f), f.spec.num, funcs, variant)


def capped(joint: bool = True, cap: int = 300) -> Method:
    def run(frame: SplitFrame) -> SplitFrame:
        encoded = tuple(c for c in frame.features)
        plan = group.capped_plan(frame, _groups(frame), (*frame.spec.num, *encoded), ("mean", "count", "std"), cap)
        return group.grouped(frame, plan.groups, plan.aggs, plan.funcs, "combined" if joint else "train_only")

    return run


def _shift(method) -> Method:
    return lambda f: method(f, _groups(f), f.spec.num)


def _projected(frame: SplitFrame, k: int, train_only: bool) -> SplitFrame:
    """Components of numerics and of the features that earlier steps added."""
    wide = replace(frame, spec=replace(frame.spec, num=(*frame.spec.num, *frame.features)))
    return replace(scale.pca(wide, k, train_only), spec=frame.spec)


METHODS: dict[str, Method] = {
    "identity": encode.label_codes,
    "inductive_baseline": lambda f: encode.label_codes(f, train_only=True),
    "joint_freq_combined": lambda f: encode.frequency(f, "combined"),
    "joint_freq_separate": lambda f: encode.frequency(f, "separate"),
    "freq_enc_train_only": lambda f: encode.frequency(f, "train_only"),
    "freq_ratio_log": encode.frequency_ratio,
    "joint_scaling": lambda f: scale.zscore(f, codes=True),
    "train_only_scaling": lambda f: scale.zscore(f, train_only=True, codes=True),
    "no_scaling": encode.label_codes,
    "joint_groupby_combined": grouped(),
    "joint_groupby_separate": grouped("separate"),
    "joint_groupby_mean_only": grouped(funcs=("mean",)),
    "groupby_train_only": grouped("train_only"),
    "groupby_shift_ratio_log": _shift(group.shift_ratio),
    "groupby_shift_ratio_raw": _shift(lambda f, g, a: group.shift_ratio(f, g, a, use_log=False)),
    "groupby_shift_cohen_d": _shift(group.cohen_d),
    "groupby_shift_cohen_d_min10": _shift(lambda f, g, a: group.cohen_d(f, g, a, 10)),
    "joint_tsne_2d_p30": lambda f: joint_tsne(f, 2, 30),
    "joint_tsne_2d_p50": lambda f: joint_tsne(f, 2, 50),
    "joint_tsne_3d_p30": lambda f: joint_tsne(f, 3, 30),
}
for _k, _v in {"5": 5, "10": 10, "var90": 0.9, "var95": 0.95}.items():
    METHODS[f"joint_pca_{_k}"] = lambda f, v=_v: scale.pca(f, v)
    METHODS[f"pca_train_only_{_k}"] = lambda f, v=_v: scale.pca(f, v, train_only=True)
for _k, _a in {"ratio": {}, "absolute": {"mode": "absolute"}, "diff": {"mode": "diff"}, "ratio_cap5": {"cap": 5.0}, "inv_ratio": {"invert": True}}.items():
    METHODS[f"target_enc_{_k}"] = lambda f, a=_a: encode.target_encoding(f, **a)
    METHODS[f"target_enc_oof_{_k}"] = lambda f, a=_a: encode.target_encoding_oof(f, neighbors.row_fold(f.ids, 5), **a)
for _m in (5, 10, 20):
    METHODS[f"target_enc_standard_m{_m}"] = lambda f, m=_m: encode.target_encoding(f, "standard", float(m))
for _k, _a in {"ratio_gated": ("ratio", True), "diff_gated": ("diff", True), "both_gated": ("both", True), "ratio_ungated": ("ratio", False)}.items():
    METHODS[f"freq_ratio_v2_{_k}"] = lambda f, a=_a: encode.frequency_ratio_v2(f, a[0], gated=a[1])
for _t in (3, 5):
    METHODS[f"targeted_groupby_top{_t}"] = lambda f, t=_t: group.targeted(f, top=t)
    METHODS[f"targeted_groupby_top{_t}_shifted_agg"] = lambda f, t=_t: group.targeted(f, top=t, filter_aggs=True)
for _m in ("joint_freq_combined", "joint_freq_separate", "freq_ratio_log", "target_enc_ratio", "joint_groupby_combined", "groupby_shift_cohen_d"):
    for _s in ("intersection", "union"):
        METHODS[f"{_m}__sel_combined_{_s}"] = lambda f, m=_m, s=_s: chooser.selective(f, METHODS[m], chooser.select_combined(f, 0.5, 0.5, s))
for _c in ("lgbm", "logreg", "rf"):
    METHODS[f"adversarial_{_c}_feature"] = lambda f, c=_c: domain.adversarial(f, c, "feature")
METHODS["adversarial_lgbm_weight_ratio"] = lambda f: domain.adversarial(f, "lgbm", "weight", "ratio")
METHODS["adversarial_lgbm_weight_raw"] = lambda f: domain.adversarial(f, "lgbm", "weight", "raw")
METHODS["adversarial_lgbm_both_ratio"] = lambda f: domain.adversarial(f, "lgbm", "both", "ratio")
METHODS["adversarial_lgbm_cal_iso_feature"] = lambda f: domain.adversarial(f, "lgbm", "feature", calibrate="isotonic")
METHODS["adversarial_lgbm_cal_platt_feature"] = lambda f: domain.adversarial(f, "lgbm", "feature", calibrate="platt")
METHODS["adversarial_lgbm_cal_iso_both_ratio"] = lambda f: domain.adversarial(f, "lgbm", "both", "ratio", calibrate="isotonic")
for _k in ("ratio_hard", "ratio_normalize", "ratio_winsorize", "raw_hard", "cal_iso_ratio_hard", "cal_iso_ratio_winsorize", "ratio_hard_tempered", "ratio_winsorize_tempered", "cal_iso_ratio_hard_tempered"):
    _w = _k.split("_")
    _a = {
        "return_as": "weight",
        "weight_type": "raw" if "raw" in _w else "ratio",
        "clip": next(c for c in ("hard", "normalize", "winsorize") if c in _w),
        "calibrate": "isotonic" if "iso" in _w else None,
        "tempering": "pad" if "tempered" in _w else None,
        "pad_max": 1.0,
    }
    METHODS[f"adversarial_reweight_lgbm_{_k}"] = lambda f, a=_a: domain.adversarial(f, "lgbm", **a)
for _k, _a in {"conf90_iter3": (0.9, 3), "conf95_iter3": (0.95, 3), "conf80_iter5": (0.8, 5), "conf90_iter1": (0.9, 1)}.items():
    METHODS[f"pseudo_label_lgbm_{_k}"] = lambda f, a=_a: domain.pseudo_label(f, *a)
for _cal, _mode, _conf in (("iso", "prop", 90), ("iso", "quad", 90), ("platt", "prop", 90), ("iso", "prop", 85), ("iso", "fixed", 90)):
    METHODS[f"pseudo_label_v2_cal_{_cal}_w{_mode}_conf{_conf}"] = lambda f, c=_cal, m=_mode, p=_conf: domain.pseudo_label(
        f, p / 100, 3, calibrate={"iso": "isotonic", "platt": "platt"}[c], weight_mode={"prop": "proportional", "quad": "quadratic", "fixed": "fixed"}[m]
    )
for _k, _a in {"k10_both": (10, "none"), "k10_filter_both": (10, "filter"), "k5_both": (5, "none"), "k10_cumshift_both": (10, "cumshift")}.items():
    METHODS[f"nearest_test_{_k}"] = lambda f, a=_a: neighbors.nearest_test(f, a[0], weighting=a[1])
for _k, _a in {"k10_both": (10, "none"), "k5_both": (5, "none"), "k10_cumshift_both": (10, "cumshift")}.items():
    METHODS[f"nearest_test_rel_{_k}"] = lambda f, a=_a: neighbors.nearest_test(f, a[0], relative=True, weighting=a[1])
for _k, _a in {"k15_a05": (15, 0.5), "k10_a05": (10, 0.5), "k15_a08": (15, 0.8)}.items():
    METHODS[f"label_prop_{_k}"] = lambda f, a=_a: propagate.label_propagation(f, *a)
    METHODS[f"label_prop_weighted_{_k}"] = lambda f, a=_a: propagate.label_propagation(f, *a, weighting="importance")


def _adaptive(frame: SplitFrame) -> int:
    return int(min(50, max(5, frame.df.count() ** 0.5)))


METHODS["label_prop_weighted_adaptive_a05"] = lambda f: propagate.label_propagation(f, _adaptive(f), 0.5, weighting="importance")
for _k, (_n, _t) in {"t005_k15": (15, 0.05), "t01_k15": (15, 0.1), "t005_k10": (10, 0.05), "adaptive": (None, 0.05)}.items():
    METHODS[f"label_prop_v3_{_k}"] = lambda f, n=_n, t=_t: propagate.label_propagation(f, n or _adaptive(f), 0.5, weighting="filter", threshold=t)
METHODS["ot_displacement_mag"] = transport.displacement
METHODS["ot_displacement_no_mag"] = lambda f: transport.displacement(f, magnitude=False)
for _k, _a in {
    "summary_only": {"mode": "summary_only"},
    "selective": {"mode": "selective"},
    "selective_and_summary": {},
    "selective_top10": {"mode": "selective", "top": 10},
    "selective_and_summary_top10": {"top": 10},
    "selective_abs": {"mode": "selective", "absolute": True},
    "selective_and_summary_abs": {"absolute": True},
}.items():
    METHODS[f"ot_disp_v2_{_k}"] = lambda f, a=_a: transport.displacement_v2(f, **a)
for _n, _l, _g, _w in ((5, 7, 1, ""), (5, 6, 1, ""), (5, 8, 1, ""), (5, 7, 2, ""), (10, 7, 1, ""), (5, 7, 1, "cumshift")):
    METHODS[f"tdda_k{_n}_lam0{_l}_aug{_g}" + (f"_{_w}" if _w else "")] = lambda f, a=(_n, _l / 10, _g), w=_w: neighbors.augmented(f, *a, weighting=w or "none")
for _n, _l, _p, _d, _w in ((5, 7, 1, 1, ""), (5, 6, 1, 1, ""), (5, 7, 1, 0, ""), (5, 7, 0, 1, ""), (10, 7, 1, 1, ""), (5, 7, 1, 1, "cumshift")):
    METHODS[f"tdda_v2_k{_n}_lam0{_l}_{'pfl' if _p else 'nopfl'}_{'dw' if _d else 'nodw'}" + (f"_{_w}" if _w else "")] = (
        lambda f, a=(_n, _l / 10, 1), p=_p, d=_d, w=_w: neighbors.augmented(f, *a, weighting=w or "none", per_feature=bool(p), by_distance=bool(d))
    )
for _k, _a in {
    "conf": {},
    "conf_shallow": {"depth": 3},
    "conf_deep": {"trees": 150, "depth": 8},
    "embed_k10": {"mode": "leaf_embedding_knn"},
    "embed_k5": {"mode": "leaf_embedding_knn", "k": 5},
    "embed_k20": {"mode": "leaf_embedding_knn", "k": 20},
}.items():
    METHODS[f"leaf_density_{_k}"] = lambda f, a=_a: density.leaf_density(f, **a)


def _on_shifted(method: Method) -> Method:
    """The method on the columns that hold nine tenths of the shift."""

    def run(frame: SplitFrame) -> SplitFrame:
        scores, _ = chooser.shift_scores(frame, comparable=True)
        picked = chooser.select_cumulative(scores)
        spec = replace(frame.spec, cat=tuple(c for c in frame.spec.cat if c in picked), num=tuple(c for c in frame.spec.num if c in picked))
        return replace(method(replace(frame, spec=spec)), spec=frame.spec)

    return run


METHODS["leaf_density_conf_cumshift"] = _on_shifted(METHODS["leaf_density_conf"])
METHODS["leaf_density_embed_k10_cumshift"] = _on_shifted(METHODS["leaf_density_embed_k10"])
for _n, _r in ((5, "feature"), (10, "feature"), (10, "weight"), (10, "both"), (5, "both"), (15, "both")):
    METHODS[f"cluster_membership_k{_n}_{_r}"] = lambda f, n=_n, r=_r: density.cluster_membership(f, n, r)
for _r in ("both", "feature"):
    METHODS[f"cluster_membership_k10_{_r}_cumshift"] = lambda f, r=_r: density.cluster_membership(f, 10, r, weighting="cumshift")


def _consensus(k: int, how: str, weighting: str = "none") -> Method:
    """Pass one: a model's out-of-fold probability on train and its refit on test; pass two: agreement."""

    def run(frame: SplitFrame) -> SplitFrame:
        from driftloom.operators.models import out_of_fold

        (key,) = frame.ids
        scores = out_of_fold(frame).select(F.col(key).alias("id"), F.col("prediction").alias("score"))
        classify = frame.spec.task == "classification"
        found = neighbors.consensus(neighbors.space(frame, weighting=weighting), scores, k, how, classify)
        names = [c for c in found.columns if c not in ("id", "split")]
        return frame.adding(frame.df.join(found.drop("split").withColumnRenamed("id", key), key, "left"), *names)

    return run


for _n, _h, _w in ((10, "dist", ""), (10, "uniform", ""), (5, "dist", ""), (20, "dist", ""), (10, "dist", "cumshift"), (5, "dist", "cumshift")):
    METHODS[f"neighbor_consensus_k{_n}_{_h}" + (f"_{_w}" if _w else "")] = _consensus(_n, "distance" if _h == "dist" else "uniform", _w or "none")

# -- compositions: frequency, target encoding, grouped aggregates, projection ---------------------------

_STEPS = {
    "joint": {"f": METHODS["joint_freq_combined"], "t": METHODS["target_enc_ratio"], "g": capped(True), "p": lambda f: _projected(f, 10, False)},
    "train_only": {"f": METHODS["freq_enc_train_only"], "t": METHODS["target_enc_standard_m10"], "g": capped(False), "p": lambda f: _projected(f, 10, True)},
}
COMPOSED: dict[str, Method] = {}
for _mode, _parts in _STEPS.items():
    for _n in range(1, 5):
        for _c in combinations("ftgp", _n):
            if "".join(_c) in ("g", "ft", "fg", "fp", "tg", "tp", "gp", "ftg", "ftp", "fgp", "tgp", "ftgp"):
                COMPOSED[f"lattice_{''.join(_c)}_{_mode}"] = pipeline(*[_parts[s] for s in _c])
    _whole = grouped("combined" if _mode == "joint" else "train_only")
    COMPOSED[f"lattice_fgp_plain_{_mode}"] = plain_pipeline(_parts["f"], _parts["g"], _parts["p"])
    COMPOSED[f"composed_fgp_{_mode}"] = pipeline(_parts["f"], _whole, _parts["p"])
    COMPOSED[f"composed_fg_{_mode}"] = pipeline(_parts["f"], _whole)
