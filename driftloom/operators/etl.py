"""Preparation of raw tables: typed aggregates, update joins, column rules and time parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numeric, text and date columns by the last letter of their name.
NUMERIC_SUFFIX, TEXT_SUFFIX, DATE_SUFFIX = ("P", "A", "T", "L"), ("M",), ("D",)


def conditional_windows(
    rows: DataFrame, key: str, age: Column, conditions: dict[str, Column], quantity: str, amount: str, windows: tuple[int, ...]
) -> DataFrame:
    """Per key the count, quantity and amount of rows under each condition, overall and younger than each window.

    One aggregate with partial sums before the shuffle, whatever the number of cells.
    """
    cells = [F.sum(amount).alias("total_spend")]
    for name, holds in conditions.items():
        for tag, keep in [("", holds), *[(f"_{d}", holds & (age < d)) for d in windows]]:
            cells += [
                F.count(F.when(keep, F.col(amount))).alias(f"has_bought_{name}{tag}"),
                F.coalesce(F.sum(F.when(keep, F.col(quantity))), F.lit(0.0)).alias(f"has_bought_{name}_q{tag}"),
                F.coalesce(F.sum(F.when(keep, F.col(amount))), F.lit(0.0)).alias(f"has_bought_{name}_a{tag}"),
            ]
    return rows.groupBy(key).agg(*cells)


def suffix_aggregates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Aggregates by the last letter of each column's name: numbers and dates max, min, mean, std;
    text first and last by the order (nulls skipped) and the number of distinct values."""
    cells = []
    for c in rows.columns:
        if c in (key, order):
            continue
        if c[-1] in NUMERIC_SUFFIX + DATE_SUFFIX:
            value = F.col(c).cast("double") if c[-1] in NUMERIC_SUFFIX else F.datediff(F.col(c), F.lit("1970-01-01")).cast("double")
            cells += [f(value).alias(f"{n}_{c}") for n, f in (("max", F.max), ("min", F.min), ("mean", F.avg), ("std", F.stddev_samp))]
        elif c[-1] in TEXT_SUFFIX:
            there = F.when(F.col(c).isNotNull(), F.col(order))
            cells += [F.max_by(c, there).alias(f"last_{c}"), F.min_by(c, there).alias(f"first_{c}"), F.count_distinct(c).alias(f"n_unique_{c}")]
    return rows.groupBy(key).agg(*cells)


def update_join(rows: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """Overwrite columns where the fix has a value."""
    named = fixes.select(key, *[F.col(c).alias(f"__new_{c}") for c in fixes.columns if c != key])
    joined = rows.join(named, key, "left")
    return joined.select(*[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if f"__new_{c}" in named.columns else F.col(c) for c in rows.columns])


def drop_unless_listed(rows: DataFrame, bad: Column, listed: DataFrame, key: str) -> DataFrame:
    """Rows that are not bad, or whose key is listed."""
    flag = listed.select(key).distinct().withColumn("__listed", F.lit(True))
    return rows.join(flag, key, "left").where(~bad | F.col("__listed").isNotNull()).drop("__listed")


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def column_rules(rows: DataFrame, most_null: float = 0.95, most_levels: int = 50, id_share: float | None = None) -> list[str]:
    """The columns that stay: not all null or nearly so, not constant, no text of too many values or like an id."""
    cells = []
    for f in rows.schema:
        cells += [F.avg(F.col(f.name).isNull().cast("double")).alias(f"null_{f.name}"), F.count_distinct(f.name).alias(f"n_{f.name}")]
    r = rows.agg(F.count(F.lit(1)).alias("rows"), *cells).first()  # one row
    keep = []
    for f in rows.schema:
        share, n = r[f"null_{f.name}"] or 0.0, r[f"n_{f.name}"]
        text = isinstance(f.dataType, T.StringType)
        like_id = id_share is not None and text and n >= id_share * r["rows"]
        if share <= most_null and n > 1 and not (text and n > most_levels and id_share is None) and not like_id:
            keep.append(f.name)
    return keep


def binary_columns(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns of exactly two distinct values."""
    r = rows.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    return [c for c in columns if r[c] == 2]


def recode_binary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """0 for the smaller of two values, 1 for the other, null stays."""
    ends = rows.agg(*[F.min(c).alias(f"__lo_{c}") for c in columns])  # one row
    return rows.crossJoin(F.broadcast(ends)).withColumns({c: (F.col(c) != F.col(f"__lo_{c}")).cast("int") for c in columns}).drop(*ends.columns)


def sentinel_to_null(rows: DataFrame, columns: list[str], sentinel) -> DataFrame:
    return rows.withColumns({c: F.when(F.col(c) != F.lit(sentinel), F.col(c)) for c in columns})


def retype(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers as text categories, whole ones without a decimal point."""
    return rows.withColumns({c: F.col(c).cast("long").cast("string") for c in columns})


def coerce(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers where they can be read, null elsewhere."""
    return rows.withColumns({c: F.col(c).try_cast("double") for c in columns})


def time_parts(rows: DataFrame, time: str, prefix: str = "") -> DataFrame:
    """Weekday (Monday 0), day, day of year, month, year, hour, minute, minute of the day."""
    t = F.col(time)
    return rows.withColumns(
        {
            f"{prefix}day_of_week": F.weekday(t),
            f"{prefix}day_of_month": F.dayofmonth(t),
            f"{prefix}day_of_year": F.dayofyear(t),
            f"{prefix}month": F.month(t),
            f"{prefix}year": F.year(t),
            f"{prefix}hour": F.hour(t),
            f"{prefix}minute": F.minute(t),
            f"{prefix}minute_of_day": F.hour(t) * 60 + F.minute(t),
        }
    )


def chain_left(base: DataFrame, sides: list[DataFrame], key: str) -> DataFrame:
    """Left joins of many side tables on one key; the planner keeps one partitioning through the chain."""
    for side in sides:
        base = base.join(side, key, "left")
    return base


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name, columns that a part lacks null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def exact_sample(rows: DataFrame, n: int, ids: list[str], seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), the same ones for a seed."""
    return rows.orderBy(F.xxhash64(*ids, F.lit(seed)), *ids).limit(n)


def bootstrap(rows: DataFrame, ids: list[str], n: int, seed: int = 0, cell_rows: int = 100_000) -> DataFrame:
    """n rows drawn with replacement: random places joined to dense ones, ranked in cells of about cell_rows."""
    spark = rows.sparkSession
    total = rows.count()
    cells = max(1, -(-total // cell_rows))
    cell = F.pmod(F.xxhash64(*ids), F.lit(cells))
    counts = rows.groupBy(cell.alias("__c")).count()  # one row for each cell
    before = F.sum("count").over(Window.orderBy("__c")) - F.col("count")
    own = F.row_number().over(Window.partitionBy("__c").orderBy(*ids))
    placed = rows.withColumn("__c", cell).withColumn("__own", own).join(counts.select("__c", before.alias("__b")), "__c")
    placed = placed.withColumn("__place", F.col("__own") + F.col("__b") - 1).drop("__c", "__own", "__b")
    draws = spark.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("__place"))
    return draws.join(placed, "__place").drop("__place")


def file_contract(rows: DataFrame) -> DataFrame:
    """rows and an order-free fingerprint of all cells, to compare two tables."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in rows.columns]
    h = F.xxhash64(F.concat_ws("\u0001", *cells)).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("fingerprint"))


def inner_suffixed(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """An inner equi-join; columns that both sides have get a suffix each."""
    shared = {c for c in left.columns if c in right.columns and c != key}
    own = left.select(*[F.col(c).alias(c + suffixes[0]) if c in shared else F.col(c) for c in left.columns])
    other = right.select(*[F.col(c).alias(c + suffixes[1]) if c in shared else F.col(c) for c in right.columns])
    return own.join(other, key)


def sanitised(names: list[str]) -> list[str]:
    """Names of letters, digits and underscores alone, told apart by a number where they meet."""
    import re

    out: list[str] = []
    for name in names:
        plain = re.sub(r"[^0-9A-Za-z_]+", "_", name).strip("_") or "column"
        new, k = plain, 1
        while new in out:
            new, k = f"{plain}_{k}", k + 1
        out.append(new)
    return out


def preview(rows: DataFrame, order: list[str], n: int = 50) -> DataFrame:
    """The first n rows, to look at."""
    return rows.orderBy(*order).limit(n)
