"""Slices along time: splits with a gap, ends of the history, and windows moved through it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.frame import SPLIT, TEST, TRAIN, SplitFrame


def split_with_gap(df: DataFrame, time: str, train_before: str | Column, test_from: str | Column) -> DataFrame:
    """Rows before the first and from the second boundary, with their split; those between go."""
    a, b = (F.lit(x).cast(df.schema[time].dataType) if isinstance(x, str) else x for x in (train_before, test_from))
    out = df.withColumn(SPLIT, F.when(F.col(time) < a, TRAIN).when(F.col(time) >= b, TEST))
    return out.where(F.col(SPLIT).isNotNull())


def place_in_time(df: DataFrame, time: str, ids: list[str], name: str = "place", descending: bool = False) -> DataFrame:
    """The 1-based place of every row of a split in time, ties by id.

    Counts by time value are summed first; rows are ranked inside one time value alone, so no
    task sorts a whole split.
    """
    counts = df.groupBy(SPLIT, time).agg(F.count(F.lit(1)).alias("__n"))
    order = F.col(time).desc() if descending else F.col(time).asc()
    before = F.sum("__n").over(Window.partitionBy(SPLIT).orderBy(order)) - F.col("__n")
    before = counts.select(F.col(SPLIT).alias("__s"), F.col(time).alias("__t"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(SPLIT, time).orderBy(*[F.col(i).desc() if descending else F.col(i).asc() for i in ids]))
    joined = df.withColumn("__own", own).join(before, (F.col(SPLIT) == F.col("__s")) & (F.col(time) == F.col("__t")))
    return joined.withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before", "__s", "__t")


def earliest_latest(df: DataFrame, time: str, ids: list[str], first: int, last: int) -> DataFrame:
    """The first rows of train and the last ones of test."""
    train = place_in_time(df.where(F.col(SPLIT) == TRAIN), time, ids).where(F.col("place") <= first)
    test = place_in_time(df.where(F.col(SPLIT) == TEST), time, ids, descending=True).where(F.col("place") <= last)
    return train.unionByName(test).drop("place")


def default_sizes(n_train: int, n_test: int) -> tuple[int, int]:
    """Window sizes: a third of train in 2500 to 8000, half of test in 1000 to 5000, at most what is there."""
    bounded = lambda n, low, high, there: min(max(low, min(high, n)), there)
    return bounded(n_train // 3, 2500, 8000, n_train), bounded(n_test // 2, 1000, 5000, n_test)


@dataclass(frozen=True)
class Windows:
    """Starts (0-based places in train) of windows of n_train rows; the last n_test rows are the test."""

    starts: tuple[int, ...]
    n_train: int
    n_test: int


def gap_windows(n_train_total: int, n_test_total: int, n_train: int, n_test: int, positions: int = 10) -> Windows:
    """Evenly spaced windows from the oldest to the newest."""
    if min(n_train, n_test, positions) <= 0:
        raise ValueError("sizes and positions must be positive")
    n_train, n_test = min(n_train, n_train_total), min(n_test, n_test_total)
    room = n_train_total - n_train
    starts = sorted({int(room * i / (positions - 1)) if positions > 1 else 0 for i in range(positions)}) if room > 0 else [0]
    return Windows(tuple(starts), n_train, n_test)


def in_windows(df: DataFrame, time: str, ids: list[str], plan: Windows) -> DataFrame:
    """Every train row once for each window that holds it (window, place), and the test rows of each."""
    train = place_in_time(df.where(F.col(SPLIT) == TRAIN), time, ids)
    starts = F.array(*[F.lit(s).cast("long") for s in plan.starts])
    held = F.filter(starts, lambda s: (F.col("place") > s) & (F.col("place") <= s + plan.n_train))
    train = train.withColumn("window", F.explode(held))
    test = place_in_time(df.where(F.col(SPLIT) == TEST), time, ids, descending=True).where(F.col("place") <= plan.n_test)
    return train.unionByName(test.withColumn("window", F.explode(starts)))


def window_frame(frame: SplitFrame, rows: DataFrame, window: int) -> SplitFrame:
    """The frame of one window, for any diagnostic."""
    return SplitFrame(rows.where(F.col("window") == window).drop("window", "place"), frame.spec, frame.ids)


def choose_windows(scores: DataFrame) -> DataFrame:
    """kind, window: the newest, the oldest, and the one of the greatest score; scores has window, score."""
    ends = scores.agg(F.max("window").alias("near"), F.min("window").alias("far"), F.max_by("window", F.struct(F.col("score"), -F.col("window"))).alias("maxdiff"))
    return ends.select(F.expr("stack(3, 'near', near, 'far', far, 'maxdiff', maxdiff) AS (kind, window)"))


def write_versions(frame: SplitFrame, rows: DataFrame, time: str, plan: Windows, choice: DataFrame, write) -> list[tuple[str, int]]:
    """Write each chosen window once, under its first name; a window that reaches into the time of test is refused.

    choice has kind and window (see choose_windows); write(kind, rows) stores the rows of one.
    """
    from driftloom.frame import ContractError

    done: dict[int, str] = {}
    for r in sorted(choice.collect(), key=lambda r: ("near", "far", "maxdiff").index(r["kind"])):  # three rows
        if r["window"] in done:
            continue
        own = rows.where(F.col("window") == r["window"])
        ends = own.agg(F.max(F.when(F.col(SPLIT) == TRAIN, F.col(time))).alias("a"), F.min(F.when(F.col(SPLIT) == TEST, F.col(time))).alias("b")).first()
        if ends["a"] >= ends["b"]:
            raise ContractError("train reaches into the time of test")
        write(r["kind"], own)
        done[r["window"]] = r["kind"]
    return [(k, w) for w, k in done.items()]
