"""What the families of queries share: rounding, daily bars, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import imbalance
from ..functions.windows import along, rolling
from ..operators import bars as B
from ..sources.tables import DAY, tape

WEEK = 7 * DAY
MONTH = 28 * DAY


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, so that the order of a sum doesn't show."""
    name = c if isinstance(c, str) else None
    x = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return x.alias(name) if name else x


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each stream: six stats of the mid and both sides' volume."""
    return B.bars(tape(spark, sf_dir), DAY, *B.six_stats("mid", "seq"), *B.side_stats())


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with a score (rolling flow imbalance), forward moves and a period."""
    w = along("stream", by="bar")
    rows = daily(spark, sf_dir).withColumn("imb", imbalance("buy_qty", "sell_qty"))
    rows = rows.withColumn("score", rolling("imb", 4, 2, w)).withColumn("fwd", F.lead("close", 1).over(w) - F.col("close"))
    return rows.withColumn("ret", F.col("fwd") / F.col("close")).withColumn("period", F.floor(F.col("bar") / MONTH).cast("long"))


_PRICE = "l_extendedprice / l_quantity"
TAPE = f"""tape AS (
  SELECT l_returnflag AS stream, CAST(epoch(l_shipdate) AS BIGINT) AS ts, {_PRICE} AS price, l_quantity AS qty,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS side, {_PRICE} * (1 - l_discount / 300) AS bid, {_PRICE} * (1 + l_tax / 700) AS ask,
    ({_PRICE} * (1 - l_discount / 300) + {_PRICE} * (1 + l_tax / 700)) / 2 AS mid,
    ((CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey AS seq,
    CAST(epoch(l_shipdate) AS BIGINT) // 86400 * 86400 AS bar
  FROM lineitem)"""

DAILY = f"""{TAPE},
daily AS (
  SELECT stream, bar, count(mid) AS samples, arg_min(mid, seq) AS open, arg_max(mid, seq) AS close, min(mid) AS min,
    quantile_cont(mid, 0.5) AS median, max(mid) AS max,
    count(*) FILTER (side = 1) AS buy_samples, coalesce(sum(qty) FILTER (side = 1), 0.0) AS buy_qty,
    CASE WHEN coalesce(sum(qty) FILTER (side = 1), 0) > 1e-6 THEN sum(qty * price) FILTER (side = 1) / sum(qty) FILTER (side = 1) ELSE 0.0 END AS buy_vwap,
    count(*) FILTER (side = -1) AS sell_samples, coalesce(sum(qty) FILTER (side = -1), 0.0) AS sell_qty,
    CASE WHEN coalesce(sum(qty) FILTER (side = -1), 0) > 1e-6 THEN sum(qty * price) FILTER (side = -1) / sum(qty) FILTER (side = -1) ELSE 0.0 END AS sell_vwap
  FROM tape GROUP BY stream, bar)"""

SCORED = f"""{DAILY},
imbs AS (SELECT *, (buy_qty - sell_qty) / (buy_qty + sell_qty + 1e-9) AS imb FROM daily),
scored0 AS (
  SELECT *, CASE WHEN count(imb) OVER w4 >= 2 THEN avg(imb) OVER w4 END AS score, lead(close) OVER w - close AS fwd
  FROM imbs WINDOW w AS (PARTITION BY stream ORDER BY bar), w4 AS (PARTITION BY stream ORDER BY bar ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
scored AS (SELECT *, fwd / close AS ret, bar // 2419200 AS period FROM scored0)"""


def rsql(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
