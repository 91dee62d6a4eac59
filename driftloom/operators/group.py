"""Aggregates of numerics by category, their shifts between splits, and caps on how many."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.frame import SPLIT, TEST, TRAIN, SplitFrame, level
from driftloom.functions.two_sample import chi2_statistic, ks, ks_tail, split_counts

#: Aggregates that may be asked for by name.
AGGREGATES = {
    "mean": F.avg,
    "count": F.count,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "median": F.median,
    "nunique": F.count_distinct,
    "first": lambda c: F.first(c, ignorenulls=True),
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _agg(func: str, column: str, split: str | None = None) -> Column:
    value = F.col(column).cast("double")
    return AGGREGATES[func](F.when(F.col(SPLIT) == split, value) if split else value).cast("double")


def _lookup(df: DataFrame, group: str, stats: DataFrame) -> DataFrame:
    joined = df.withColumn("__g", level(group)).join(stats.withColumnRenamed("__level", "__h"), F.col("__g") == F.col("__h"), "left")
    return joined.drop("__g", "__h")


def grouped(
    frame: SplitFrame,
    groups: tuple[str, ...],
    aggs: tuple[str, ...],
    funcs: tuple[str, ...] = ("mean", "count", "std"),
    variant: str = "combined",
    fallback: str = "default",
) -> SplitFrame:
    """`{g}_{a}_{f}_joint`, or `_train` and `_test`: one aggregate per group column for all a and f.

    combined: over both splits, missing values 0. separate: in each split; a level that a split
    lacks has the aggregate over both splits (fallback `default`) or over its own (`per_split`).
    train_only: levels that train lacks have train's aggregate. Whatever is missing then is 0.
    """
    splits = {"combined": [(None, "joint")], "separate": [(TRAIN, "train"), (TEST, "test")], "train_only": [(TRAIN, "train")]}[variant]
    df, names = frame.df, []
    totals = []
    for g in groups:
        cells = {f"{g}_{a}_{f}_{tag}": _agg(f, a, split) for a in aggs if a != g for f in funcs for split, tag in splits}
        stats = frame.df.groupBy(level(g).alias("__level")).agg(
            *[e.alias(n) for n, e in cells.items()],
            F.count(F.when(F.col(SPLIT) == TRAIN, 1)).alias("__train"),
            F.count(F.when(F.col(SPLIT) == TEST, 1)).alias("__test"),
        )
        lacks = {"train": F.col("__train") == 0, "test": F.col("__test") == 0, "joint": F.lit(False)}
        stats = stats.select("__level", *[F.when(~lacks[n.rsplit("_", 1)[1]], F.col(n)).alias(n) for n in cells])
        df = _lookup(df, g, stats)
        names += cells
        for a in aggs:
            for f in funcs:
                for split, tag in splits:
                    if a != g and (variant != "combined" or fallback == "global"):
                        whole = None if (variant == "separate" and fallback == "default") or variant == "combined" else split
                        totals.append((f"{g}_{a}_{f}_{tag}", _agg(f, a, whole)))
    if totals:
        whole = frame.df.agg(*[e.alias(f"__t_{n}") for n, e in totals])  # one row
        df = df.crossJoin(F.broadcast(whole)).withColumns({n: F.coalesce(F.col(n), F.col(f"__t_{n}")) for n, _ in totals}).drop(*whole.columns)
    df = df.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names})
    return frame.adding(df, *names)


def shift_ratio(frame: SplitFrame, groups: tuple[str, ...], aggs: tuple[str, ...], use_log: bool = True, alpha: float = 1e-6) -> SplitFrame:
    """`{g}_{a}_shift_ratio`: the mean in test over that in train; a missing mean is the split's own."""
    df, names = frame.df, []
    whole = frame.df.agg(*[_agg("mean", a, s).alias(f"__{s}_{a}") for a in aggs for s in (TRAIN, TEST)])
    for g in groups:
        own = [a for a in aggs if a != g]
        stats = frame.df.groupBy(level(g).alias("__level")).agg(*[_agg("mean", a, s).alias(f"{s}_{a}") for a in own for s in (TRAIN, TEST)])
        stats = stats.crossJoin(F.broadcast(whole))  # one row
        cells = {}
        for a in own:
            mean = {s: F.coalesce(F.col(f"{s}_{a}"), F.col(f"__{s}_{a}")) + alpha for s in (TRAIN, TEST)}
            ratio = F.try_divide(mean[TEST], mean[TRAIN])
            cells[f"{g}_{a}_shift_ratio"] = F.coalesce(F.ln(F.greatest(ratio, F.lit(1e-10))) if use_log else ratio, F.lit(0.0))
        df = _lookup(df, g, stats.select("__level", *[e.alias(n) for n, e in cells.items()]))
        names += cells
    return frame.adding(df, *names)


def cohen_d(frame: SplitFrame, groups: tuple[str, ...], aggs: tuple[str, ...], least: int = 5) -> SplitFrame:
    """`{g}_{a}_shift_d`: the difference of means over the pooled deviation; 0 in small or constant groups."""
    df, names = frame.df, []
    for g in groups:
        own = [a for a in aggs if a != g]
        parts = [_agg(f, a, s).alias(f"{f}_{s}_{a}") for a in own for s in (TRAIN, TEST) for f in ("count", "mean", "var")]
        stats = frame.df.groupBy(level(g).alias("__level")).agg(*parts)
        cells = {}
        for a in own:
            n1, n2 = F.col(f"count_{TRAIN}_{a}"), F.col(f"count_{TEST}_{a}")
            pooled = F.sqrt(F.try_divide((n1 - 1) * F.col(f"var_{TRAIN}_{a}") + (n2 - 1) * F.col(f"var_{TEST}_{a}"), n1 + n2 - 2))
            d = F.try_divide(F.col(f"mean_{TEST}_{a}") - F.col(f"mean_{TRAIN}_{a}"), pooled)
            cells[f"{g}_{a}_shift_d"] = F.when((n1 >= least) & (n2 >= least) & (pooled >= 1e-12), d).otherwise(0.0)
        df = _lookup(df, g, stats.select("__level", *[e.alias(n) for n, e in cells.items()]))
        names += cells
    return frame.adding(df.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names}), *names)


@dataclass(frozen=True)
class GroupPlan:
    """Which groups, aggregated columns and functions remain below a cap, and why."""

    groups: tuple[str, ...]
    aggs: tuple[str, ...]
    funcs: tuple[str, ...]
    reduction: str


def capped_plan(frame: SplitFrame, groups: tuple[str, ...], aggs: tuple[str, ...], funcs: tuple[str, ...], cap: int = 300) -> GroupPlan:
    """Reduce in a fixed order until at most cap features remain.

    All; the mean alone; the aggregated columns ranked (encoder outputs by name, then by variance
    in train); the groups of the most levels dropped.
    """
    if len(groups) * len(aggs) * len(funcs) <= cap:
        return GroupPlan(groups, aggs, funcs, "none")
    funcs = ("mean",)
    if len(groups) * len(aggs) <= cap:
        return GroupPlan(groups, aggs, funcs, "mean_only")
    encoded = sorted(a for a in aggs if a in frame.features)
    rest = [a for a in aggs if a not in encoded]
    spread = frame.train.agg(*[F.coalesce(F.var_pop(F.col(a).cast("double")), F.lit(0.0)).alias(a) for a in rest]).first() if rest else {}
    ranked = (*encoded, *sorted(rest, key=lambda a: (-spread[a], a)))
    if cap // len(groups) >= 1:
        return GroupPlan(groups, ranked[: cap // len(groups)], funcs, "ranked_aggs")
    levels = frame.train.agg(*[F.count_distinct(level(g)).alias(g) for g in groups]).first()
    kept = sorted(groups, key=lambda g: (levels[g], g))[:cap]
    return GroupPlan(tuple(g for g in groups if g in kept), ranked[:1], funcs, "dropped_groups")


def targeted_plan(
    frame: SplitFrame, top: int = 3, filter_aggs: bool = False, threshold: float = 0.1, funcs: tuple[str, ...] = ("mean", "count"), most: int = 30
) -> list[tuple[str, str, str]]:
    """(group, column, function) of the groups that shift most by the chi-squared statistic.

    The cap is looked at before each function, as the features are laid out.
    """
    ranked = {r["column"]: r["statistic"] for r in chi2_statistic(split_counts(frame)).collect()}
    groups = sorted(frame.spec.cat, key=lambda c: (-ranked.get(c, 0.0), frame.spec.cat.index(c)))[:top]
    aggs = list(frame.spec.num)
    if filter_aggs:
        tails = {r["column"]: ks_tail(r["ks"], r["n_train"], r["n_test"]) for r in ks(frame).collect()}
        aggs = [a for a in aggs if tails.get(a, 1.0) < threshold] or aggs
    out = []
    for g in groups:
        for a in aggs:
            for f in funcs:
                if a != g and len(out) < most:
                    out.append((g, a, f))
    return out


def targeted(frame: SplitFrame, variant: str = "combined", **options) -> SplitFrame:
    """The aggregates of targeted_plan; a missing one is the global aggregate (of the split, if separate)."""
    plan = targeted_plan(frame, **options)
    for g in dict.fromkeys(g for g, _, _ in plan):
        own = [(a, f) for h, a, f in plan if h == g]
        for f in dict.fromkeys(f for _, f in own):
            columns = tuple(a for a, k in own if k == f)
            frame = grouped(frame, (g,), columns, (f,), variant, fallback="global" if variant == "combined" else "per_split")
    return frame
