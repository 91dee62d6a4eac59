"""Encodings of categories: codes, frequencies, frequency ratios and target encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.frame import MISSING, SPLIT, TARGET, TEST, TRAIN, SplitFrame, attach, level, melt_levels
from driftloom.functions.two_sample import chi2_statistic, chi2_tail


def _in(split: str) -> Column:
    return F.col(SPLIT) == split


def level_counts(frame: SplitFrame) -> DataFrame:
    """column, value, n_train, n_test, y_sum, y_n: one pass for every categorical.

    Persisted, as the lookup of each column reads it; its rows are the distinct levels.
    """
    return melt_levels(frame).groupBy("column", "value").agg(
        F.count(F.when(_in(TRAIN), 1)).alias("n_train"),
        F.count(F.when(_in(TEST), 1)).alias("n_test"),
        F.sum(F.when(_in(TRAIN), F.col(TARGET))).alias("y_sum"),
        F.count(F.when(_in(TRAIN), F.col(TARGET))).alias("y_n"),
    ).persist()


def sizes(counts: DataFrame) -> DataFrame:
    """Adds to the counts of a column its totals: rows of both splits and levels."""
    w = Window.partitionBy("column")
    return counts.withColumns(
        {
            "all_train": F.sum("n_train").over(w),
            "all_test": F.sum("n_test").over(w),
            "levels": F.count(F.lit(1)).over(w),
            "y_all": F.sum("y_sum").over(w),
            "y_count": F.sum("y_n").over(w),
        }
    )


def label_codes(frame: SplitFrame, train_only: bool = False, unseen: int = -1, min_frequency: float | None = None) -> SplitFrame:
    """`{c}_code`: place of the level among the sorted ones; of train alone, unseen levels get `unseen`.

    With min_frequency, levels below that share of the rows are one level (sorted last) and a
    missing one gets the greatest code plus one.
    """
    if not frame.spec.cat:
        return frame
    counts = sizes(level_counts(frame))
    if train_only:
        counts = counts.where("n_train > 0")
    if min_frequency is not None:
        n, total = F.col("n_train") + F.col("n_test"), F.col("all_train") + F.col("all_test")
        group = F.when(F.col("value") == MISSING, 2).when(n < F.lit(min_frequency) * total, 1).otherwise(0)
        key = F.when(group == 0, F.col("value")).otherwise("")
        codes = counts.withColumn("code", F.dense_rank().over(Window.partitionBy("column").orderBy(group, key)) - 1)
    else:
        codes = counts.withColumn("code", F.dense_rank().over(Window.partitionBy("column").orderBy("value")) - 1)
    df = frame.df
    for c in frame.spec.cat:
        df = attach(df, codes, c, {f"{c}_code": F.col("code").cast("int")}, {f"{c}_code": F.lit(unseen)} if train_only else None)
    return frame.adding(df, *[f"{c}_code" for c in frame.spec.cat])


def frequency(frame: SplitFrame, variant: str = "combined") -> SplitFrame:
    """Share of a level: `combined` over both splits, `separate` in each, `train_only` in train."""
    counts = sizes(level_counts(frame))
    joint = (F.col("n_train") + F.col("n_test")) / (F.col("all_train") + F.col("all_test"))
    train, test = F.try_divide("n_train", "all_train"), F.try_divide("n_test", "all_test")
    df, names = frame.df, []
    for c in frame.spec.cat:
        own = {
            "combined": {f"{c}_freq_joint": joint},
            "separate": {f"{c}_freq_train": train, f"{c}_freq_test": test},
            "train_only": {f"{c}_freq_train": train},
        }[variant]
        df = attach(df, counts, c, own, {n: F.lit(0.0) for n in own})
        names += own
    return frame.adding(df, *names)


def frequency_ratio(frame: SplitFrame, use_log: bool = True, alpha: float = 1.0) -> SplitFrame:
    """`{c}_freq_ratio`: smoothed share in test over that in train, as a logarithm or clipped."""
    counts = sizes(level_counts(frame))
    share = lambda n, total: (F.col(n) + alpha) / (F.col(total) + alpha * F.col("levels"))
    ratio = share("n_test", "all_test") / share("n_train", "all_train")
    value = F.ln(ratio) if use_log else F.greatest(F.lit(0.01), F.least(F.lit(100.0), ratio))
    df = frame.df
    for c in frame.spec.cat:
        df = attach(df, counts, c, {f"{c}_freq_ratio": value})
    return frame.adding(df, *[f"{c}_freq_ratio" for c in frame.spec.cat])


def frequency_ratio_v2(frame: SplitFrame, mode: str = "both", gated: bool = True, threshold: float = 0.05, adaptive: bool = True, alpha: float = 1.0) -> SplitFrame:
    """Log ratio and difference of shares; a column without a significant shift is zero throughout."""
    counts = sizes(level_counts(frame))
    a = 1.0 / F.col("levels") if adaptive else F.lit(alpha)
    share = lambda n, total: (F.col(n) + a) / (F.col(total) + a * F.col("levels"))
    ratio = F.ln(share("n_test", "all_test") / share("n_train", "all_train"))
    diff = share("n_test", "all_test") - share("n_train", "all_train")
    open_for = {c: 1.0 for c in frame.spec.cat}
    if gated:  # one row per column reaches the driver
        for r in chi2_statistic(counts).collect():
            open_for[r["column"]] = float(chi2_tail(frame.df.sparkSession, r["statistic"], r["df"]) < threshold)
    df, names = frame.df, []
    for c in frame.spec.cat:
        own = {}
        if mode in ("ratio", "both"):
            own[f"{c}_freq_ratio_v2"] = ratio * open_for[c]
        if mode in ("diff", "both"):
            own[f"{c}_freq_diff"] = diff * open_for[c]
        df = attach(df, counts, c, own)
        names += own
    return frame.adding(df, *names)


def _adjustment(mode: str, cap: float | None, f_train: Column, f_test: Column, mean_test: Column) -> Column:
    if mode == "ratio":
        out = (f_test + 1e-6) / (f_train + 1e-6)
    elif mode == "absolute":
        out = (f_test + 1e-6) / (mean_test + 1e-6)
    elif mode == "diff":
        out = F.abs(f_test - f_train) + 1.0
    else:
        raise ValueError(f"unknown regularisation {mode!r}")
    return F.least(out, F.lit(float(cap))) if cap is not None else out


def _with_test_share(counts: DataFrame) -> DataFrame:
    w = Window.partitionBy("column")
    f_test = F.try_divide("n_test", "all_test")
    return sizes(counts).withColumn("f_test", F.coalesce(f_test, F.lit(0.0))).withColumn(
        "mean_test", F.coalesce(F.avg(F.when(F.col("n_test") > 0, F.col("f_test"))).over(w), F.lit(0.0))
    )


def target_encoding(frame: SplitFrame, mode: str = "ratio", base: float = 10.0, cap: float | None = None, invert: bool = False) -> SplitFrame:
    """`{c}_target_enc`: level means pulled to the global mean, the more the level shifts.

    mode `standard` keeps the strength at base (train statistics alone).
    """
    counts = _with_test_share(level_counts(frame))
    mean = F.try_divide("y_all", "y_count")
    if mode == "standard":
        m = F.lit(float(base))
    else:
        adjust = _adjustment(mode, cap, F.coalesce(F.try_divide("n_train", "all_train"), F.lit(0.0)), F.col("f_test"), F.col("mean_test"))
        m = F.lit(base) / F.greatest(adjust, F.lit(1e-6)) if invert else F.lit(base) * adjust
    encoded = (F.coalesce("y_sum", F.lit(0.0)) + m * mean) / (F.col("y_n") + m)
    df = frame.df
    for c in frame.spec.cat:
        df = attach(df, counts, c, {f"{c}_target_enc": encoded})
    return frame.adding(df, *[f"{c}_target_enc" for c in frame.spec.cat])


def target_encoding_oof(
    frame: SplitFrame, fold: Column, mode: str = "ratio", base: float = 10.0, cap: float | None = None, invert: bool = False
) -> SplitFrame:
    """`{c}_target_enc_oof`: train rows from the other folds, test rows from all of train.

    Totals less the own fold's sums: one pass, not one per fold. The global mean and the shares
    in test stay those of all data.
    """
    melted = frame.df.withColumn("__fold", F.when(_in(TRAIN), fold.cast("int")).otherwise(-1))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), level(c).alias("value")) for c in frame.spec.cat])
    by_fold = (
        melted.select(SPLIT, TARGET, "__fold", F.inline(pairs))
        .groupBy("column", "value", "__fold")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(TARGET).alias("y"), F.count(TARGET).alias("yn"))
        .persist()
    )
    train = F.col("__fold") >= 0
    counts = by_fold.groupBy("column", "value").agg(
        F.coalesce(F.sum(F.when(train, F.col("n"))), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum(F.when(~train, F.col("n"))), F.lit(0)).alias("n_test"),
        F.sum(F.when(train, F.col("y"))).alias("y_sum"),
        F.coalesce(F.sum(F.when(train, F.col("yn"))), F.lit(0)).alias("y_n"),
    )
    counts = _with_test_share(counts)
    in_fold = by_fold.where(train).groupBy("column", "__fold").agg(F.sum("n").alias("fold_rows"))
    folds = in_fold.select("column", "__fold", "fold_rows")
    none = counts.select("column").distinct().select("column", F.lit(-1).alias("__fold"), F.lit(0).alias("fold_rows"))
    own = by_fold.where(train).select("column", "value", "__fold", F.col("n").alias("own_n"), F.col("y").alias("own_y"), F.col("yn").alias("own_yn"))
    stats = counts.join(folds.unionByName(none), "column").join(own, ["column", "value", "__fold"], "left")
    left = lambda total, part: F.coalesce(F.col(total), F.lit(0)) - F.coalesce(F.col(part), F.lit(0))
    f_train = F.coalesce(F.try_divide(left("n_train", "own_n"), left("all_train", "fold_rows")), F.lit(0.0))
    mean = F.try_divide("y_all", "y_count")
    adjust = _adjustment(mode, cap, f_train, F.col("f_test"), F.col("mean_test"))
    m = F.lit(base) / F.greatest(adjust, F.lit(1e-6)) if invert else F.lit(base) * adjust
    stats = stats.withColumn("enc", (left("y_sum", "own_y") + m * mean) / (left("y_n", "own_yn") + m))
    df = melted
    for c in frame.spec.cat:
        one = stats.where(F.col("column") == c).select(F.col("value").alias("__level"), F.col("__fold").alias("__f"), F.col("enc").alias(f"{c}_target_enc_oof"))
        df = df.join(one, (level(c) == F.col("__level")) & (F.col("__fold") == F.col("__f")), "left").drop("__level", "__f")
    return frame.adding(df.drop("__fold"), *[f"{c}_target_enc_oof" for c in frame.spec.cat])
