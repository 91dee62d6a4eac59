"""The pair of splits as one DataFrame, its declared features, and the guard around test labels."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT, TARGET, WEIGHT = "__split", "__target", "__weight"
SRC_SPLIT, SRC_ID, ROLE = "__src_split", "__src_id", "__role"
TRAIN, TEST = "train", "test"
MISSING = "nan"
RESERVED = (SPLIT, TARGET, WEIGHT, SRC_SPLIT, SRC_ID, ROLE)
TASKS = ("classification", "regression")


class ContractError(ValueError):
    """The data do not match their declaration."""


@dataclass(frozen=True)
class FeatureSpec:
    """Declared categorical and numeric features; the declaration wins over physical types."""

    cat: tuple[str, ...] = ()
    num: tuple[str, ...] = ()
    task: str = "classification"
    time: str | None = None

    def check(self, df: DataFrame) -> None:
        """Fail unless the lists are disjoint, present and numerics are numeric."""
        declared = [*self.cat, *self.num]
        if self.task not in TASKS:
            raise ContractError(f"unknown task {self.task!r}")
        if len(set(declared)) != len(declared):
            raise ContractError("a feature is declared twice")
        if lacking := [c for c in declared if c not in df.columns]:
            raise ContractError(f"declared features are missing: {lacking}")
        if reserved := [c for c in declared if c in RESERVED]:
            raise ContractError(f"reserved names: {reserved}")
        types = {f.name: f.dataType for f in df.schema}
        if wrong := [c for c in self.num if not isinstance(types[c], (T.NumericType, T.BooleanType))]:
            raise ContractError(f"declared numeric, physically not: {wrong}")


@dataclass(frozen=True)
class SplitFrame:
    """Both splits in one DataFrame: ids, SPLIT, features, and TARGET, which is null on test rows."""

    df: DataFrame
    spec: FeatureSpec
    ids: tuple[str, ...]
    features: tuple[str, ...] = ()
    prescaled: bool = False
    meta: dict = field(default_factory=dict)

    @property
    def train(self) -> DataFrame:
        return self.df.where(F.col(SPLIT) == TRAIN)

    @property
    def test(self) -> DataFrame:
        return self.df.where(F.col(SPLIT) == TEST)

    def adding(self, df: DataFrame, *features: str, **changes) -> SplitFrame:
        """The same frame over df, with new feature columns declared numeric."""
        return replace(self, df=df, features=(*self.features, *features), **changes)

    def output(self) -> DataFrame:
        """Ids, split and the features that methods added."""
        weight = [WEIGHT] if WEIGHT in self.df.columns else []
        return self.df.select(*self.ids, F.col(SPLIT).alias("split"), *self.features, *weight)


class LabelGuard:
    """Holds the test labels apart; only evaluate() reads them, and it hides them once."""

    def __init__(self) -> None:
        self._labels: DataFrame | None = None

    def hide(self, df: DataFrame, ids: tuple[str, ...], target: str, is_train: Column) -> DataFrame:
        if self._labels is not None:
            raise ContractError("labels were hidden already")
        self._labels = df.where(~is_train).select(*ids, F.col(target).cast("double").alias("__truth"))
        return df.withColumn(TARGET, F.when(is_train, F.col(target).cast("double"))).drop(target)

    def truth(self, predictions: DataFrame, ids: tuple[str, ...]) -> DataFrame:
        """Predictions of test rows with their labels."""
        if self._labels is None:
            raise ContractError("no labels were hidden")
        return predictions.join(self._labels, list(ids))


def level(column: str) -> Column:
    """A category as text; a missing one is a level of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def number(column: str) -> Column:
    """A numeric as double, NaN as null."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def bind(df: DataFrame, ids: list[str], spec: FeatureSpec, is_train: Column, target: Column | None = None) -> SplitFrame:
    """One frame from a table, a pure split predicate and a declaration."""
    spec.check(df)
    label = F.when(is_train, target.cast("double")) if target is not None else F.lit(None).cast("double")
    keep = [c for c in ([spec.time] if spec.time else []) if c not in ids]
    out = df.select(
        *ids,
        *keep,
        F.when(is_train, TRAIN).otherwise(TEST).alias(SPLIT),
        label.alias(TARGET),
        *[level(c).alias(c) for c in spec.cat if c not in ids],
        *[number(c).alias(c) for c in spec.num if c not in ids],
    )
    return SplitFrame(out, spec, tuple(ids))


def melt_levels(frame: SplitFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """column, value, split, target: all categoricals in one long table, so one shuffle serves them all."""
    columns = columns or frame.spec.cat
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), level(c).alias("value")) for c in columns])
    return frame.df.select(SPLIT, TARGET, F.inline(pairs))


def melt_numbers(frame: SplitFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """column, value, split of every non-null numeric."""
    columns = columns or frame.spec.num
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return frame.df.select(SPLIT, F.inline(pairs)).where("value is not null")


def attach(df: DataFrame, stats: DataFrame, column: str, features: dict[str, Column], fallback: dict[str, Column] | None = None) -> DataFrame:
    """Look features up by the level of a column; stats has column, value and what features need.

    No side is forced to be broadcast: the planner does so when the statistics are small.
    """
    own = stats.where(F.col("column") == column).select(F.col("value").alias("__level"), *[e.alias(n) for n, e in features.items()])
    joined = df.withColumn("__key", level(column)).join(own, F.col("__key") == F.col("__level"), "left").drop("__key", "__level")
    return joined.withColumns({n: F.coalesce(F.col(n), f) for n, f in (fallback or {}).items()})
