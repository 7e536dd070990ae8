"""Merging narrow bars into wider ones. Rows: keys, bar (start of the narrow bar), and its columns.

Sums and extremes are exact; medians merge as weighted medians of medians. Flips and runs of merged
bars come from a few ordered pieces of each narrow bar, so no raw trades are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import islands

ADDITIVE = ("_samples", "_sum", "_sumsq", "_count", "_qty")


def widened(bars: DataFrame, width: int) -> DataFrame:
    return bars.withColumn("out", (F.floor(F.col("bar") / width) * width).cast("long"))


def infer_interval(bars: DataFrame, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """The commonest step between bars, the smallest among equals."""
    step = F.col("bar") - F.lag("bar").over(Window.partitionBy(*keys).orderBy("bar"))
    return bars.select(*keys, step.alias("step")).groupBy(*keys).agg(F.mode("step", True).alias("interval"), F.count("step").alias("steps"))


def check_multiple(source: int, target: int) -> int:
    """How many source bars fill a target bar; an error unless a whole number above 1."""
    if target <= source or target % source:
        raise ValueError(f"{target} s is no multiple above 1 of {source} s")
    return target // source


def additive(bars: DataFrame, width: int, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Sums of columns whose name says that they add up; any other column is an error."""
    rest = [c for c in bars.columns if c not in (*keys, "bar")]
    if odd := [c for c in rest if not c.endswith(ADDITIVE)]:
        raise ValueError(f"no rule to merge {odd}")
    return widened(bars, width).groupBy(*keys, "out").agg(*[F.sum(c).alias(c) for c in rest])


def coverage(bars: DataFrame, width: int, factor: int, keys: tuple[str, ...] = ("stream",), require_full: bool = False) -> DataFrame:
    """How many bars each wide bar has, and whether it is full."""
    out = widened(bars, width).groupBy(*keys, "out").agg(F.count("*").alias("n_bars")).withColumn("full", F.col("n_bars") >= factor)
    return out.filter("full") if require_full else out


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """Lower weighted median: the first value whose running weight reaches half; null without positive weight."""
    positive = rows.filter((F.col(weight) > 0) & F.col(value).isNotNull())
    total = F.sum(weight).over(Window.partitionBy(*keys))
    so_far = F.sum(weight).over(Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    return positive.select(*keys, F.col(value).alias("_v"), total.alias("_t"), so_far.alias("_c")).filter("_c >= 0.5 * _t").groupBy(*keys).agg(F.min("_v").alias(name))


def series_block(bars: DataFrame, width: int, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Open of the first bar, close of the last, extremes, samples, and the median weighted by samples."""
    wide = widened(bars, width)
    block = wide.groupBy(*keys, "out").agg(F.sum("samples").alias("samples"), F.min_by("open", "bar").alias("open"), F.max_by("close", "bar").alias("close"), F.min("min").alias("min"), F.max("max").alias("max"))
    return block.join(weighted_median(wide, [*keys, "out"], "median", "samples", "median"), [*keys, "out"], "left")


def vwap(bars: DataFrame, width: int, sides: tuple[str, ...] = ("buy", "sell"), keys: tuple[str, ...] = ("stream",), guard: float = 1e-9) -> DataFrame:
    out: list[Column] = []
    for s in sides:
        q = F.sum(f"{s}_qty")
        out += [q.alias(f"{s}_qty"), F.when(q > guard, F.sum(F.col(f"{s}_qty") * F.col(f"{s}_vwap")) / q).otherwise(0.0).alias(f"{s}_vwap")]
    return widened(bars, width).groupBy(*keys, "out").agg(*out)


def variance(bars: DataFrame, width: int, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Exact merged count, mean, M2 and population deviation from samples, mid_sum and mid_m2."""
    wide = widened(bars, width)
    mean = F.sum("mid_sum").over(Window.partitionBy(*keys, "out")) / F.sum("samples").over(Window.partitionBy(*keys, "out"))
    own = F.col("mid_sum") / F.col("samples")
    spread = F.col("mid_m2") + F.col("samples") * (own - F.col("mean")) * (own - F.col("mean"))
    merged = wide.filter("samples > 0").withColumn("mean", mean).groupBy(*keys, "out").agg(F.sum("samples").alias("samples"), F.first("mean").alias("mean"), F.sum(spread).alias("mid_m2"))
    return merged.withColumn("mid_std", F.sqrt(F.col("mid_m2") / F.col("samples")))


def realised_variance(bars: DataFrame, width: int, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Sum of the bars' variances and of the squared steps from one bar's close to the next one's open."""
    w = Window.partitionBy(*keys, "out").orderBy("bar")
    step = F.col("mid_open") - F.lag("mid_close").over(w)
    return widened(bars, width).withColumn("step", step).groupBy(*keys, "out").agg((F.sum("rv") + F.coalesce(F.sum(F.col("step") * F.col("step")), F.lit(0.0))).alias("rv"))


def flips(bars: DataFrame, width: int, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Merged flips and first and last signs from three ordered signs a bar: the step into it, its first, its last."""
    w = Window.partitionBy(*keys, "out").orderBy("bar")
    step = F.signum(F.col("mid_open") - F.lag("mid_close").over(w)).cast("int")
    wide = widened(bars, width).withColumn("step", F.coalesce(step, F.lit(0)))
    slots = wide.select(*keys, "out", "bar", "flips", F.posexplode(F.array("step", "first_sign", "last_sign")).alias("slot", "raw")).withColumn("sign", F.nullif("raw", F.lit(0)))
    before = F.last("sign", ignorenulls=True).over(Window.partitionBy(*keys, "out").orderBy("bar", "slot").rowsBetween(Window.unboundedPreceding, -1))
    at = F.when(F.col("sign").isNotNull(), F.struct("bar", "slot"))
    return (
        slots.withColumn("before", before)
        .groupBy(*keys, "out")
        .agg(
            (F.count(F.when((F.col("slot") < 2) & (F.col("sign") != F.col("before")), 1)) + F.sum(F.when(F.col("slot") == 0, F.col("flips")))).alias("flips"),
            F.coalesce(F.min_by("sign", at), F.lit(0)).alias("first_sign"),
            F.coalesce(F.max_by("sign", at), F.lit(0)).alias("last_sign"),
        )
    )


def stitched_runs(bars: DataFrame, width: int, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Merged sweeps and first and last runs, from each bar's lead and tail run; a one-run bar is one piece."""
    wide = widened(bars, width)
    lead = F.struct(F.col("lead_side").alias("side"), F.col("lead_qty").alias("qty"))
    tail = F.struct(F.col("tail_side").alias("side"), F.col("tail_qty").alias("qty"))
    pieces = wide.select(*keys, "out", "bar", F.posexplode(F.when(F.col("n_runs") == 1, F.array(lead)).otherwise(F.array(lead, tail))).alias("slot", "p")).select(*keys, "out", "bar", "slot", "p.side", "p.qty")
    w = Window.partitionBy(*keys, "out").orderBy("bar", "slot")
    changed = (F.col("side") != F.coalesce(F.lag("side").over(w), F.lit(0))) | (F.col("slot") == 1)
    summed = pieces.withColumn("changed", changed).withColumn("run", islands(F.col("changed"), w)).groupBy(*keys, "out", "run").agg(F.first("side").alias("side"), F.sum("qty").alias("qty"))
    ends = summed.groupBy(*keys, "out").agg(
        *[F.coalesce(F.max(F.when(F.col("side") == s, F.col("qty"))), F.lit(0.0)).alias(f"{n}_stitch") for n, s in (("buy", 1), ("sell", -1))],
        F.min_by("side", "run").alias("lead_side"),
        F.min_by("qty", "run").alias("lead_qty"),
        F.max_by("side", "run").alias("tail_side"),
        F.max_by("qty", "run").alias("tail_qty"),
    )
    inner = wide.groupBy(*keys, "out").agg(F.max("buy_sweep").alias("buy_sweep"), F.max("sell_sweep").alias("sell_sweep"))
    joined = inner.join(ends, [*keys, "out"])
    return joined.select(*keys, "out", F.greatest("buy_sweep", "buy_stitch").alias("buy_sweep"), F.greatest("sell_sweep", "sell_stitch").alias("sell_sweep"), "lead_side", "lead_qty", "tail_side", "tail_qty")


def halves(bars: DataFrame, width: int, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Early and late counts and volumes by side after a merge: halves are cut at half of the merged trades, in proportion.

    A lone trade is late here.
    """
    parts = ("buy_count", "buy_qty", "sell_count", "sell_qty")
    wide = widened(bars, width)
    piece = lambda h: F.struct(
        (F.col(f"{h}_buy_count") + F.col(f"{h}_sell_count")).alias("cnt"), *[F.col(f"{h}_{c}").alias(c) for c in parts]
    )
    rows = wide.select(*keys, "out", "bar", F.posexplode(F.array(piece("early"), piece("late"))).alias("slot", "p")).select(*keys, "out", "bar", "slot", "p.*")
    w = Window.partitionBy(*keys, "out")
    before = F.coalesce(F.sum("cnt").over(w.orderBy("bar", "slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    half = F.floor(F.sum("cnt").over(w) / 2)
    take = F.least(F.col("cnt"), F.greatest(half - before, F.lit(0)))
    share = rows.withColumn("share", F.when(F.col("cnt") > 0, take / F.col("cnt")).otherwise(0.0))
    out = []
    for c in parts:
        out += [F.sum(F.col("share") * F.col(c)).alias(f"early_{c}"), F.sum((1 - F.col("share")) * F.col(c)).alias(f"late_{c}")]
    return share.groupBy(*keys, "out").agg(*out)


def sequence_ends(bars: DataFrame, width: int, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """First and last side and the first largest trade over a wide bar."""
    return widened(bars, width).groupBy(*keys, "out").agg(
        F.min_by("first_side", "bar").alias("first_side"),
        F.max_by("last_side", "bar").alias("last_side"),
        F.max("largest_qty").alias("largest_qty"),
        F.max_by("largest_side", F.struct(F.col("largest_qty"), -F.col("bar"))).alias("largest_side"),
    )


def sizes(bars: DataFrame, width: int, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Trade-size medians and 0.9 quantiles, each as the weighted median of the bars', 0 without trades."""
    wide = widened(bars, width)
    out = wide.select(*keys, "out").distinct()
    for s in ("buy", "sell"):
        for q in ("median", "p90"):
            got = weighted_median(wide, [*keys, "out"], f"{s}_size_{q}", f"{s}_samples", f"{s}_size_{q}")
            out = out.join(got, [*keys, "out"], "left")
    return out.na.fill(0.0)


def walls(bars: DataFrame, width: int, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Largest wall, and median wall and distance weighted by the samples with a wall; 0, 0 and -1 without any."""
    wide = widened(bars, width)
    there = F.when(F.col("wall_count") > 0, F.col("wall_max"))
    out = wide.groupBy(*keys, "out").agg(F.sum("wall_count").alias("wall_count"), F.sum("wall_sum").alias("wall_sum"), F.max(there).alias("wall_max"))
    for c in ("wall_median", "wall_dist"):
        out = out.join(weighted_median(wide, [*keys, "out"], c, "wall_count", c), [*keys, "out"], "left")
    return out.na.fill(0.0, ["wall_max", "wall_median"]).na.fill(-1.0, ["wall_dist"])


def optional(bars: DataFrame, width: int, name: str, keys: tuple[str, ...] = (), maxima: tuple[str, ...] = ()) -> DataFrame:
    """Open and close of the bars that have samples, and the median weighted by their count; -1 without any.

    ``maxima`` are columns of which the largest is kept.
    """
    wide = widened(bars, width)
    there = F.when(F.col(f"{name}_count") > 0, F.col("bar"))
    ends = wide.groupBy(*keys, "out").agg(
        F.coalesce(F.min_by(F.when(F.col(f"{name}_count") > 0, F.col(f"{name}_open")), there), F.lit(-1.0)).alias(f"{name}_open"),
        F.coalesce(F.max_by(F.when(F.col(f"{name}_count") > 0, F.col(f"{name}_close")), there), F.lit(-1.0)).alias(f"{name}_close"),
        *[F.max(c).alias(c) for c in maxima],
    )
    middle = weighted_median(wide, [*keys, "out"], f"{name}_median", f"{name}_count", f"{name}_median")
    return ends.join(middle, [*keys, "out"], "left").na.fill(-1.0, [f"{name}_median"])


def candles(bars: DataFrame, width: int, price: str = "hybrid", keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Open, high, low, close, volume and count from bars priced by close ("mid"), VWAP ("vwap"), or VWAP within and close at the ends ("hybrid").

    A bar without trades has no VWAP and falls back to its close.
    """
    volume = F.col("buy_qty") + F.col("sell_qty")
    deal = F.when(volume > 0, (F.col("buy_qty") * F.col("buy_vwap") + F.col("sell_qty") * F.col("sell_vwap")) / volume).otherwise(F.col("close"))
    inner = F.col("close") if price == "mid" else deal
    edge = deal if price == "vwap" else F.col("close")
    rows = widened(bars, width).withColumn("inner", inner).withColumn("edge", edge).withColumn("volume", volume)
    first, last = F.min_by("edge", "bar"), F.max_by("edge", "bar")
    return rows.groupBy(*keys, "out").agg(
        first.alias("open"), F.greatest(F.max("inner"), first, last).alias("high"), F.least(F.min("inner"), first, last).alias("low"), last.alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n")
    )


def resample_right(rows: DataFrame, width: int, value: str, keys: tuple[str, ...] = ("stream",), ts: str = "bar") -> DataFrame:
    """Last value of each window that is closed and labelled on the right: a row on the edge belongs to the window it ends."""
    return rows.groupBy(*keys, (F.ceil(F.col(ts) / width) * width).cast("long").alias("label")).agg(F.max_by(value, ts).alias(value))
