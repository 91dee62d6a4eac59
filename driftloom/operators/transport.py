"""One-dimensional optimal transport: how far a value lies from its rank's value in the other split."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.frame import SPLIT, TEST, TRAIN, SplitFrame, melt_numbers
from driftloom.functions.two_sample import ks, ks_tail
from driftloom.operators.encode import label_codes
from driftloom.operators.lineage import written
from driftloom.operators.running import running
from driftloom.operators.scale import impute_median


def displacements(frame: SplitFrame, columns: tuple[str, ...]) -> DataFrame:
    """column, split, value, disp of every distinct value.

    A value's rank (the average over ties) over n + 1 is a position among the other split's
    sorted values, clamped to its ends and interpolated. Ranks are sums of counts, run along ranges
    of values, so no task sorts a column. Positions meet values by one equi-join on the integer
    rank; only distinct values are looked up.
    """
    counts = melt_numbers(frame, columns).groupBy("column", F.col(SPLIT).alias("split"), "value").agg(F.count(F.lit(1)).alias("n"))
    other = F.when(F.col("split") == TRAIN, TEST).otherwise(TRAIN)
    ranked = running(counts, ["column", "split"], "value", ["n"])
    ranked = written(ranked.select("column", "split", "value", "n", "next", F.col("before_n").alias("before"), F.col("all_n").alias("total")), "ranked")
    totals = written(ranked.groupBy("column", other.alias("split")).agg(F.first("total").alias("others")), "totals")  # a row for each column and split
    asked = ranked.join(F.broadcast(totals), ["column", "split"]).withColumn(
        "position", (F.col("before") + (F.col("n") + 1) / 2) / (F.col("total") + 1) * (F.col("others") + 1)
    )
    asked = asked.withColumn("position", F.greatest(F.lit(1.0), F.least(F.col("others").cast("double"), F.col("position"))))
    asked = asked.select("column", "split", "value", "position", F.floor("position").cast("long").alias("lo"))
    last = F.col("before") + F.col("n")
    places = ranked.select(
        "column", other.alias("split"), F.explode(F.sequence(F.col("before") + 1, last)).alias("lo"), F.col("value").alias("v_lo"), last.alias("last"), "next"
    )
    met = asked.join(places.hint("merge"), ["column", "split", "lo"])
    v_hi = F.when(F.col("lo") < F.col("last"), F.col("v_lo")).otherwise(F.coalesce("next", "v_lo"))
    value = F.col("v_lo") + (F.col("position") - F.col("lo")) * (v_hi - F.col("v_lo"))
    return written(met.select("column", "split", "value", (value - F.col("value")).alias("disp")), "displacements")


def _medians(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """split and __m_<c>, the exact median in each split, from sums of counts: no task holds a column's values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = df.select(SPLIT, F.inline(pairs)).where("value is not null").groupBy("column", SPLIT, "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, ["column", SPLIT], "value", ["n"])
    # the values at the two middle places, counted from 0
    low, high = F.floor((F.col("all_n") - 1) / 2), F.ceil((F.col("all_n") - 1) / 2)
    has = lambda place: (F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n"))
    middle = lambda c: (F.max(F.when((F.col("column") == c) & has(low), F.col("value"))) + F.max(F.when((F.col("column") == c) & has(high), F.col("value")))) / 2
    return ranked.where(has(low) | has(high)).groupBy(SPLIT).agg(*[middle(c).alias(f"__m_{c}") for c in columns])


def _attach(df: DataFrame, found: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    for c in columns:
        # as many as there are distinct values, so never broadcast
        own = found.where(F.col("column") == c).select(F.col("split").alias("__s"), F.col("value").alias("__v"), F.col("disp").alias(f"ot_disp_{c}")).hint("merge")
        df = df.join(own, (F.col(SPLIT) == F.col("__s")) & (F.col(c) == F.col("__v")), "left").drop("__s", "__v")
    return df


def _magnitude(columns: list[Column]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + c * c
    return F.sqrt(total)


def displacement(frame: SplitFrame, magnitude: bool = True) -> SplitFrame:
    """`ot_disp_{c}` of every column, label codes among them, and their length."""
    if frame.spec.cat:
        coded = label_codes(frame)
        df = coded.df.withColumns({f"{c}_code": F.col(f"{c}_code").cast("double") for c in frame.spec.cat})
        frame = replace(frame, df=df, spec=replace(frame.spec, cat=(), num=(*[f"{c}_code" for c in frame.spec.cat], *frame.spec.num)))
    columns = frame.spec.num
    df = frame.df
    if not df.where(" or ".join(f"`{c}` is null" for c in columns)).isEmpty():
        middle = written(_medians(df, columns), "medians")  # one row per split
        df = df.join(F.broadcast(middle), SPLIT, "left")
        df = df.withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}"), F.lit(0.0)) for c in columns}).drop(*[f"__m_{c}" for c in columns])
    filled = replace(frame, df=df)
    df = _attach(df, displacements(filled, columns), columns)
    names = [f"ot_disp_{c}" for c in columns]
    if magnitude:
        df = df.withColumn("ot_disp_magnitude", _magnitude([F.col(n) for n in names]))
        names.append("ot_disp_magnitude")
    return frame.adding(df, *names)


def displacement_v2(
    frame: SplitFrame, mode: str = "selective_and_summary", threshold: float = 0.05, top: int | None = None, absolute: bool = False, columns: tuple[str, ...] | None = None
) -> SplitFrame:
    """Displacements of the numerics that shift, over the interquartile range, and their summaries."""
    frame = impute_median(frame)
    if columns is None:
        rows = {r["column"]: r for r in ks(frame).collect()}
        order = sorted(rows, key=lambda c: -rows[c]["ks"])
        picked = [c for c in order if ks_tail(rows[c]["ks"], rows[c]["n_train"], rows[c]["n_test"]) < threshold] or order[:5]
        columns = tuple(picked[:top] if top else picked)
    if not columns:
        return frame
    df = _attach(frame.df, displacements(frame, columns), columns)
    spread = frame.df.agg(*[F.expr(f"percentile(`{c}`, 0.75) - percentile(`{c}`, 0.25)").alias(f"__q_{c}") for c in columns])
    df = df.crossJoin(F.broadcast(spread))  # one row
    scaled = {}
    for c in columns:
        raw = F.abs(F.col(f"ot_disp_{c}")) if absolute else F.col(f"ot_disp_{c}")
        scaled[f"ot_disp_{c}"] = raw / F.when(F.col(f"__q_{c}") > 0, F.col(f"__q_{c}")).otherwise(1.0)
    df = df.withColumns(scaled).drop(*spread.columns)
    cells = [F.col(n) for n in scaled]
    names = list(scaled) if mode in ("selective", "selective_and_summary") else []
    if mode in ("summary_only", "selective_and_summary"):
        total = F.lit(0.0)
        for c in cells:
            total = total + F.abs(c)
        most = F.greatest(*[F.abs(c) for c in cells]) if len(cells) > 1 else F.abs(cells[0])
        df = df.withColumns({"ot_mean_abs_disp": total / len(cells), "ot_max_abs_disp": most, "ot_disp_magnitude": _magnitude(cells)})
        names += ["ot_mean_abs_disp", "ot_max_abs_disp", "ot_disp_magnitude"]
    return frame.adding(df, *names)
