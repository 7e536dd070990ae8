"""Labels of what follows a bar, and the classes' spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import clip, direction
from ..functions.windows import contiguous, diff, first_touch, rolling


def forward_delta(close: str, h: int, w: WindowSpec) -> Column:
    return F.lead(close, h).over(w) - F.col(close)


def direction_label(close: str, h: int, threshold: float, w: WindowSpec) -> Column:
    return direction(forward_delta(close, h, w), threshold)


def vol_normalised(close: str, ts: str, h: int, step: int, n: int, least: int, w: WindowSpec, most: float = 5.0) -> Column:
    """Forward return over the rolling deviation of one-bar returns, clipped; null unless bars are contiguous and the deviation above 0."""
    one = diff(close, 1, w) / F.lag(close).over(w)
    vol = F.nullif(rolling(one, n, least, w, F.stddev_samp), F.lit(0.0))
    return F.when(contiguous(ts, 0, h, step, w), clip(forward_delta(close, h, w) / F.col(close) / vol, -most, most))


def touch(close: str, h: int, theta: float, w: WindowSpec) -> tuple[Column, Column]:
    """Whether the largest rise, and the largest fall, within h bars reaches theta."""
    ahead = w.rowsBetween(1, h)
    up = F.max(close).over(ahead) / F.col(close) - 1 >= theta
    down = F.min(close).over(ahead) / F.col(close) - 1 <= -theta
    return up.cast("int"), down.cast("int")


def barriers(close: str, h: int, theta: float, w: WindowSpec) -> tuple[Column, Column]:
    """First bar that touches the upper, and the lower barrier (h + 1: never)."""
    up = first_touch(close, h, lambda x: x / F.col(close) - 1 >= theta, w)
    down = first_touch(close, h, lambda x: x / F.col(close) - 1 <= -theta, w)
    return up, down


def triple_barrier(rows: DataFrame, close: str, h: int, theta: float, w: WindowSpec) -> DataFrame:
    """k_up, k_down, and labels that are 1 for the barrier touched strictly first; neither on a tie."""
    up, down = barriers(close, h, theta, w)
    marked = rows.withColumn("k_up", up).withColumn("k_down", down)
    return marked.withColumn("touch_up", (F.col("k_up") < F.col("k_down")).cast("int")).withColumn("touch_down", (F.col("k_down") < F.col("k_up")).cast("int"))


def class_spread(rows: DataFrame, label: str, delta: str) -> DataFrame:
    """Rows and share of each class with the mean, deviation and range of its delta: two small aggregations."""
    by = rows.groupBy(label).agg(F.count("*").alias("n"), F.avg(delta).alias("mean_delta"), F.stddev_samp(delta).alias("std_delta"), F.min(delta).alias("min_delta"), F.max(delta).alias("max_delta"))
    return by.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).withColumn("share", F.col("n") / F.col("total")).drop("total")  # one row of a total


def mean_by_class(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """One row per feature: its mean in each class, and whether the means are monotone."""
    long = rows.select(F.col(label).alias("label"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])).alias("p")).select("label", "p.feature", "p.x")
    means = long.groupBy("feature").agg(*[F.avg(F.when(F.col("label") == k, F.col("x"))).alias(n) for n, k in (("mean_down", -1), ("mean_flat", 0), ("mean_up", 1))])
    up = (F.col("mean_down") < F.col("mean_flat")) & (F.col("mean_flat") < F.col("mean_up"))
    down = (F.col("mean_down") > F.col("mean_flat")) & (F.col("mean_flat") > F.col("mean_up"))
    return means.withColumn("monotone", F.coalesce(up | down, F.lit(False)))
