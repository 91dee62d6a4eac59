"""Choosing columns by shift, by importance, or by both, and voting over folds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.frame import SPLIT, TARGET, TEST, TRAIN, SplitFrame
from driftloom.functions.two_sample import chi2_normalised, chi2_statistic, chi2_tail, cramers_v, ks, ks_tail, split_counts


@dataclass(frozen=True)
class Selection:
    """Chosen categoricals and numerics, and the score of every column."""

    cat: tuple[str, ...]
    num: tuple[str, ...]
    scores: dict[str, float]


def _chosen(frame: SplitFrame, names: list[str], scores: dict[str, float]) -> Selection:
    return Selection(tuple(c for c in frame.spec.cat if c in names), tuple(c for c in frame.spec.num if c in names), scores)


def _top(scores: dict[str, float], k: int) -> list[str]:
    """The k greatest; ties keep the order of the declaration."""
    return sorted(scores, key=lambda c: -scores[c])[:k]


def shift_scores(frame: SplitFrame, comparable: bool = False) -> tuple[dict[str, float], dict[str, float]]:
    """Score and p value by column: KS for numerics, and for categoricals the chi-squared statistic
    per degree of freedom, or Cramer's V, which is comparable with KS. One row a column is collected."""
    spark, scores, tails = frame.df.sparkSession, {}, {}
    if frame.spec.cat:
        counts = split_counts(frame).persist()
        own = cramers_v(counts).withColumnRenamed("cramers_v", "score") if comparable else chi2_normalised(counts)
        found = {r["column"]: float(r["score"]) for r in own.collect()}
        p = {r["column"]: chi2_tail(spark, r["statistic"], r["df"]) for r in chi2_statistic(counts).collect()}
        counts.unpersist()
        scores |= {c: found.get(c, 0.0) for c in frame.spec.cat}
        tails |= {c: p.get(c, 1.0) for c in frame.spec.cat}
    if frame.spec.num:
        rows = {r["column"]: r for r in ks(frame).collect()}
        for c in frame.spec.num:
            r = rows.get(c)
            scores[c] = float(r["ks"]) if r else 0.0
            tails[c] = ks_tail(r["ks"], r["n_train"], r["n_test"]) if r else 1.0
    return scores, tails


def select_all(frame: SplitFrame) -> Selection:
    return Selection(frame.spec.cat, frame.spec.num, {c: 1.0 for c in (*frame.spec.cat, *frame.spec.num)})


def select_shifted(
    frame: SplitFrame, top: int | None = None, fraction: float | None = None, p_value: float | None = None, least: int = 1, comparable: bool = False
) -> Selection:
    """The most shifted columns: a number, a fraction, or those below a p value."""
    scores, tails = shift_scores(frame, comparable)
    if top is not None:
        names = _top(scores, top)
    elif fraction is not None:
        names = _top(scores, max(least, int(len(scores) * fraction)))
    else:
        names = [c for c in scores if tails[c] < (0.05 if p_value is None else p_value)]
    if len(names) < least:
        names = _top(scores, least)
    return _chosen(frame, names, scores)


def select_cumulative(scores: dict[str, float], ratio: float = 0.9, least: int = 3) -> list[str]:
    """The fewest columns, by falling score, that hold the ratio of the total; all if nothing shifts."""
    order = _top(scores, len(scores))
    total = sum(scores.values())
    if total < 1e-6:
        return order
    running, k = 0.0, 0
    for c in order:
        running += scores[c]
        k += 1
        if running >= ratio * total:
            break
    return order[: max(min(least, len(order)), k)]


def importances(frame: SplitFrame, label: Column, seed: int = 0, trees: int = 60, depth: int = 6, classification: bool = True) -> dict[str, float]:
    """Importances of label codes and numerics in a random forest for the label."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from driftloom.operators.encode import label_codes
    from driftloom.operators.scale import impute_median

    coded = label_codes(impute_median(frame) if frame.spec.num else frame)
    names = {f"{c}_code": c for c in frame.spec.cat} | {c: c for c in frame.spec.num}
    rows = coded.df.withColumn("__y", label.cast("double")).where("__y is not null")
    rows = VectorAssembler(inputCols=list(names), outputCol="__x").transform(rows.select("__y", *[F.col(c).cast("double") for c in names]))
    learner = RandomForestClassifier if classification else RandomForestRegressor
    model = learner(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(rows)
    return dict(zip(names.values(), map(float, model.featureImportances.toArray()), strict=True))


def select_domain(frame: SplitFrame, top: int | None = None, fraction: float = 0.3, sample: int | None = 30_000, seed: int = 0) -> Selection:
    """The columns by which a model tells the splits apart."""
    if sample:
        parts = [frame.df.where(F.col(SPLIT) == s).orderBy(F.xxhash64(*frame.ids, F.lit(seed)), *frame.ids).limit(sample) for s in (TRAIN, TEST)]
        frame = replace(frame, df=parts[0].unionByName(parts[1]))
    scores = importances(frame, F.col(SPLIT) == TEST, seed)
    return _chosen(frame, _top(scores, top or max(1, int(len(scores) * fraction))), scores)


def select_combined(frame: SplitFrame, shifted: float = 0.5, important: float = 0.5, combination: str = "intersection", seed: int = 0) -> Selection:
    """Columns that shift and matter for the target; without any, the most shifted ones."""
    shift, _ = shift_scores(frame, comparable=True)
    matter = importances(replace(frame, df=frame.train), F.col(TARGET), seed, classification=frame.spec.task == "classification")
    n = len(shift)
    a, b = set(_top(shift, max(1, int(n * shifted)))), set(_top(matter, max(1, int(n * important))))
    names = list(a & b if combination == "intersection" else a | b) or list(a)
    rank = lambda s: {c: k / n for k, c in enumerate(_top(s, n))}
    rs, ri = rank(shift), rank(matter)
    return _chosen(frame, names, {c: (1 - rs[c]) * (1 - ri[c]) for c in shift})


def select_votes(frame: SplitFrame, base: Callable[[SplitFrame], Selection], fold: Column, folds: int = 5, aggregation: str = "majority") -> Selection:
    """Votes of a selector over the folds of train, each with all of test."""
    votes: dict[str, int] = {}
    for k in range(folds):
        own = replace(frame, df=frame.df.where((F.col(SPLIT) == TEST) | (fold == k)))
        picked = base(own)
        for c in (*picked.cat, *picked.num):
            votes[c] = votes.get(c, 0) + 1
    need = {"majority": folds / 2 + 1e-9, "intersection": folds, "union": 1}[aggregation]
    every = (*frame.spec.cat, *frame.spec.num)
    return _chosen(frame, [c for c, v in votes.items() if v >= need], {c: votes.get(c, 0) / folds for c in every})


def selective(frame: SplitFrame, method: Callable[[SplitFrame], SplitFrame], selection: Selection) -> SplitFrame:
    """Run a method on the chosen columns alone; the others pass, categoricals with their codes."""
    from driftloom.operators.encode import label_codes

    cat, num = (selection.cat, selection.num) if selection.cat or selection.num else (frame.spec.cat, frame.spec.num)
    inner = method(replace(frame, spec=replace(frame.spec, cat=cat, num=num)))
    others = tuple(c for c in frame.spec.cat if c not in cat)
    out = replace(inner, spec=replace(frame.spec, cat=others, num=()))
    out = label_codes(out) if others else out
    return replace(out, spec=frame.spec)


SELECTORS: dict[str, Callable[[SplitFrame], Selection]] = {
    "all": select_all,
    "shift_top5": lambda f: select_shifted(f, top=5),
    "shift_top10": lambda f: select_shifted(f, top=10),
    "shift_top30pct": lambda f: select_shifted(f, fraction=0.3),
    "shift_significant": lambda f: select_shifted(f, p_value=0.05),
    "domain_clf_top30pct": lambda f: select_domain(f, fraction=0.3),
    "domain_clf_top50pct": lambda f: select_domain(f, fraction=0.5),
    "combined_intersection": select_combined,
    "combined_union": lambda f: select_combined(f, 0.3, 0.3, "union"),
    "shift_v2_top5": lambda f: select_shifted(f, top=5, comparable=True),
    "shift_v2_top10": lambda f: select_shifted(f, top=10, comparable=True),
    "shift_v2_top30pct": lambda f: select_shifted(f, fraction=0.3, comparable=True),
    "shift_v2_significant": lambda f: select_shifted(f, p_value=0.05, comparable=True),
}


def _fold(frame: SplitFrame) -> Column:
    return F.pmod(F.xxhash64(*frame.ids), F.lit(5))


for _base, _how in (("shift_top5", "majority"), ("shift_top10", "majority"), ("shift_v2_top5", "majority"), ("shift_v2_top10", "majority"), ("shift_top10", "intersection"), ("combined_intersection", "majority")):
    SELECTORS[f"oof_{_base}_{_how}"] = lambda f, base=_base, how=_how: select_votes(f, SELECTORS[base], _fold(f), aggregation=how)
