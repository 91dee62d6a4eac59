"""Where queries are registered, the views they run on, and the SQL of those views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.frame import FeatureSpec, SplitFrame, bind

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BENCH: list[str] = []


def query(name: str, sql: str | None = None, bench: bool = False):
    """Register a query, with the DuckDB SQL of its result where SQL has one."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        if bench:
            BENCH.append(name)
        return f

    return put


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, since sums depend on the order of rows; a negative zero becomes zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def r6(expression: str) -> str:
    return f"(round({expression}, 6) + 0.0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LI_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
LI_CATS = ("l_returnflag", "l_linestatus", "l_linenumber")
LI_NUMS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LI_TRAIN = "l_shipdate < TIMESTAMP '1999-01-01'"
LI_SQL = f"li AS (SELECT *, CASE WHEN {LI_TRAIN} THEN 'train' ELSE 'test' END AS split FROM lineitem)"


def lineitems(spark: SparkSession, sf_dir: str, cats=LI_CATS, nums=LI_NUMS, target: str | None = None) -> SplitFrame:
    train = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    label = F.expr(target).cast("double") if target else None
    return bind(table(spark, sf_dir, "lineitem"), LI_KEYS, FeatureSpec(tuple(cats), tuple(nums)), train, label)


ORD_CATS = ("o_orderstatus", "o_orderpriority", "c_mktsegment", "c_nationkey")
ORD_NUMS = ("o_totalprice", "c_acctbal")
ORD_SQL = """ord AS (
  SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderpriority, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
         o_totalprice, c_acctbal, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS split,
         CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END AS label
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def orders(spark: SparkSession, sf_dir: str, cats=ORD_CATS, nums=ORD_NUMS) -> SplitFrame:
    train = F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    return bind(order_rows(spark, sf_dir), ["o_orderkey"], FeatureSpec(tuple(cats), tuple(nums)), train, (F.col("o_totalprice") > 250000).cast("double"))


EV_CATS, EV_NUMS = ("event_type", "user_id"), ("value",)
EV_SQL = """ev AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type, value, CASE WHEN ts < TIMESTAMP '2024-01-22' THEN 'train' ELSE 'test' END AS split
  FROM events)"""


def event_frame(spark: SparkSession, sf_dir: str, cats=EV_CATS, nums=EV_NUMS, target: str | None = None) -> SplitFrame:
    train = F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz")
    label = F.expr(target).cast("double") if target else None
    return bind(table(spark, sf_dir, "events"), ["event_id"], FeatureSpec(tuple(cats), tuple(nums)), train, label)


def vectors(spark: SparkSession, sf_dir: str, dims: int) -> SplitFrame:
    """The first dims coordinates of the embeddings as numerics; even ids train."""
    rows = table(spark, sf_dir, "embeddings")
    cells = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)]
    wide = rows.select(F.col("vec_id"), F.col("label").alias("label"), *cells)
    return bind(wide, ["vec_id"], FeatureSpec((), tuple(f"e{i}" for i in range(dims))), F.col("vec_id") % 2 == 0, F.col("label").cast("double"))


def emb_sql(dims: int) -> str:
    cells = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(dims))
    return f"emb AS (SELECT vec_id, label, CASE WHEN vec_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, {cells} FROM embeddings)"
