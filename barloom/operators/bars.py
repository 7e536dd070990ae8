"""Bars from trades and samples: one row per key and tumbling window.

``order`` is a column or struct that orders the rows of a bar. Each family is one grouped
aggregation; families that need neighbours inside a bar add one window over (keys, bar).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket, ratio
from ..functions.windows import islands

SIDES = (("buy", 1), ("sell", -1))


def with_bar(rows: DataFrame, width: int, ts: str = "ts") -> DataFrame:
    return rows.withColumn("bar", bucket(ts, width))


def six_stats(c: str, order: str, prefix: str = "") -> list[Column]:
    """samples, open, close, min, median, max of a series."""
    x = F.col(c)
    return [
        F.count(x).alias(f"{prefix}samples"),
        F.min_by(x, order).alias(f"{prefix}open"),
        F.max_by(x, order).alias(f"{prefix}close"),
        F.min(x).alias(f"{prefix}min"),
        F.percentile(x, F.lit(0.5)).alias(f"{prefix}median"),
        F.max(x).alias(f"{prefix}max"),
    ]


def side_stats() -> list[Column]:
    """Samples, quantity and VWAP of either side; a VWAP without quantity is 0."""
    out = []
    for name, s in SIDES:
        mine = F.col("side") == s
        q = F.coalesce(F.sum(F.when(mine, F.col("qty"))), F.lit(0.0))
        pq = F.coalesce(F.sum(F.when(mine, F.col("qty") * F.col("price"))), F.lit(0.0))
        out += [F.count(F.when(mine, 1)).alias(f"{name}_samples"), q.alias(f"{name}_qty"), ratio(pq, q).alias(f"{name}_vwap")]
    return out


def bars(rows: DataFrame, width: int, *aggregates: Column, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    return with_bar(rows, width).groupBy(*keys, "bar").agg(*aggregates)


def _inside(keys: tuple[str, ...], order: str):
    return Window.partitionBy(*keys, "bar").orderBy(order)


def moves(rows: DataFrame, width: int, c: str = "mid", order: str = "seq", keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Each sample with its move from the one before in the bar, and that move's sign (null for none)."""
    w = _inside(keys, order)
    out = with_bar(rows, width).withColumn("move", F.col(c) - F.lag(c).over(w))
    return out.withColumn("sign", F.nullif(F.signum("move"), F.lit(0.0)).cast("int"))


def mid_volatility(rows: DataFrame, width: int, c: str = "mid", order: str = "seq", keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Population deviation, realised variance and direction flips; all 0 below three samples."""
    w = _inside(keys, order)
    moved = moves(rows, width, c, order, keys)
    turned = moved.withColumn("before", F.last("sign", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    enough = F.count(c) >= 3
    return turned.groupBy(*keys, "bar").agg(
        F.count(c).alias("samples"),
        F.when(enough, F.stddev_pop(c)).otherwise(0.0).alias("mid_std"),
        F.when(enough, F.sum(F.col("move") * F.col("move"))).otherwise(0.0).alias("mid_rv"),
        F.when(enough, F.count(F.when(F.col("sign") != F.col("before"), 1))).otherwise(0).alias("mid_flips"),
    )


def sufficient(rows: DataFrame, width: int, c: str = "mid", order: str = "seq", keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """What merging bars needs: count, sum, M2, open, close, rv, flips, first and last move's sign, squared quantities."""
    w = _inside(keys, order)
    moved = moves(rows, width, c, order, keys)
    turned = moved.withColumn("before", F.last("sign", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    signed = F.col("sign").isNotNull()
    return turned.groupBy(*keys, "bar").agg(
        F.count(c).alias("samples"),
        F.sum(c).alias("mid_sum"),
        (F.var_pop(c) * F.count(c)).alias("mid_m2"),
        F.min_by(c, order).alias("mid_open"),
        F.max_by(c, order).alias("mid_close"),
        F.coalesce(F.sum(F.col("move") * F.col("move")), F.lit(0.0)).alias("rv"),
        F.count(F.when(F.col("sign") != F.col("before"), 1)).alias("flips"),
        F.coalesce(F.min_by("sign", F.when(signed, F.col(order))), F.lit(0)).alias("first_sign"),
        F.coalesce(F.max_by("sign", F.when(signed, F.col(order))), F.lit(0)).alias("last_sign"),
        *[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("qty") * F.col("qty"))), F.lit(0.0)).alias(f"{name}_sumsq") for name, s in SIDES],
    )


def trade_sequence(rows: DataFrame, width: int, order: str = "seq", keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """First and last side, the first largest trade, and counts and volumes of the early and late half.

    The early half holds n // 2 trades; a lone trade is early.
    """
    w = _inside(keys, order)
    numbered = with_bar(rows, width).withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*keys, "bar")))
    early = F.col("k") <= F.greatest(F.floor(F.col("n") / 2), F.lit(1))
    out = [
        F.min_by("side", "k").alias("first_side"),
        F.max_by("side", "k").alias("last_side"),
        F.max("qty").alias("largest_qty"),
        F.max_by("side", F.struct(F.col("qty"), -F.col("k"))).alias("largest_side"),
    ]
    for half, is_in in (("early", early), ("late", ~early)):
        for name, s in SIDES:
            mine = is_in & (F.col("side") == s)
            out += [F.count(F.when(mine, 1)).alias(f"{half}_{name}_count"), F.coalesce(F.sum(F.when(mine, F.col("qty"))), F.lit(0.0)).alias(f"{half}_{name}_qty")]
    return numbered.groupBy(*keys, "bar").agg(*out)


def size_quantiles() -> list[Column]:
    """Median and 0.9 quantile of trade sizes by side, 0 for a side without trades."""
    out = []
    for name, s in SIDES:
        q = F.percentile(F.when(F.col("side") == s, F.col("qty")), F.array(F.lit(0.5), F.lit(0.9)))
        out += [F.coalesce(q[0], F.lit(0.0)).alias(f"{name}_size_median"), F.coalesce(q[1], F.lit(0.0)).alias(f"{name}_size_p90")]
    return out


def burst(rows: DataFrame, width: int, batch_us: int, us: str = "us", keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Largest volume of either side in one short batch: two levels of aggregation, the first cheap to combine."""
    cut = with_bar(rows, width).withColumn("batch", F.floor(F.col(us) / batch_us))
    sums = [F.coalesce(F.sum(F.when(F.col("side") == s, F.col("qty"))), F.lit(0.0)).alias(name) for name, s in SIDES]
    return cut.groupBy(*keys, "bar", "batch").agg(*sums).groupBy(*keys, "bar").agg(*[F.max(name).alias(f"{name}_burst") for name, _ in SIDES])


def runs(rows: DataFrame, width: int, order: str = "seq", keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Largest run of one side's consecutive volume, and the volume of a bar's first and last run."""
    w = _inside(keys, order)
    changed = F.col("side") != F.coalesce(F.lag("side").over(w), F.lit(0))
    marked = with_bar(rows, width).withColumn("changed", changed).withColumn("run", islands(F.col("changed"), w))
    summed = marked.groupBy(*keys, "bar", "run").agg(F.first("side").alias("side"), F.sum("qty").alias("qty"))
    best = [F.coalesce(F.max(F.when(F.col("side") == s, F.col("qty"))), F.lit(0.0)).alias(f"{name}_sweep") for name, s in SIDES]
    return summed.groupBy(*keys, "bar").agg(
        *best,
        F.min_by("side", "run").alias("lead_side"),
        F.min_by("qty", "run").alias("lead_qty"),
        F.max_by("side", "run").alias("tail_side"),
        F.max_by("qty", "run").alias("tail_qty"),
        F.count("*").alias("n_runs"),
    )


def wall_stats(rows: DataFrame, width: int, qty: str, dist: str, keys: tuple[str, ...]) -> DataFrame:
    """Median and largest wall, median distance, count and sum over samples with a wall; medians and maximum are 0, 0 and -1 without any."""
    there = F.col(dist) >= 0
    return with_bar(rows, width).groupBy(*keys, "bar").agg(
        F.coalesce(F.percentile(F.when(there, F.col(qty)), F.lit(0.5)), F.lit(0.0)).alias("wall_median"),
        F.coalesce(F.max(F.when(there, F.col(qty))), F.lit(0.0)).alias("wall_max"),
        F.coalesce(F.percentile(F.when(there, F.col(dist)), F.lit(0.5)), F.lit(-1.0)).alias("wall_dist"),
        F.count(F.when(there, F.col(qty))).alias("wall_count"),
        F.coalesce(F.sum(F.when(there, F.col(qty))), F.lit(0.0)).alias("wall_sum"),
    )


def optional_stats(rows: DataFrame, width: int, kinds: dict[str, str], value: str = "value", kind: str = "kind", order: str = "seq", keys: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates of typed messages: "sum", "max" (0 if none), "median" (-1 if none) or "ocm" (open, close, median)."""
    out = []
    for k, how in kinds.items():
        x = F.when(F.col(kind) == k, F.col(value))
        at = F.when(F.col(kind) == k, F.col(order))
        median = F.coalesce(F.percentile(x, F.lit(0.5)), F.lit(-1.0))
        if how in ("sum", "max"):
            out.append(F.coalesce((F.sum if how == "sum" else F.max)(x), F.lit(0.0)).alias(f"{k}_{how}"))
        elif how == "median":
            out += [median.alias(f"{k}_median"), F.count(x).alias(f"{k}_count"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{k}_sum")]
        else:
            out += [F.coalesce(F.min_by(x, at), F.lit(-1.0)).alias(f"{k}_open"), F.coalesce(F.max_by(x, at), F.lit(-1.0)).alias(f"{k}_close"), median.alias(f"{k}_median"), F.count(x).alias(f"{k}_count")]
    return with_bar(rows, width).groupBy(*keys, "bar").agg(*out)


def paired(left: DataFrame, right: DataFrame, names: tuple[str, str], on: str = "bar") -> DataFrame:
    """Bars present in both markets, columns prefixed by market."""
    a, b = (df.select(on, *[F.col(c).alias(f"{n}_{c}") for c in df.columns if c != on]) for df, n in zip((left, right), names, strict=True))
    return a.join(b, on)


def unpaired(left: DataFrame, right: DataFrame, on: str = "bar") -> DataFrame:
    """Bars of the left market that the right one lacks."""
    return left.join(right.select(on).distinct(), on, "left_anti")


def with_optional(pair: DataFrame, optional: DataFrame, on: str = "bar", missing: float = -1.0) -> DataFrame:
    """Paired bars with an optional stream's columns, ``missing`` where it has no bar or no value."""
    return pair.join(optional, on, "left").na.fill(missing, [c for c in optional.columns if c != on])
