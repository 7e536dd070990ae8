"""As-of joins, candle comparison and the halo that lets one long stream be cut into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backward(left: DataFrame, right: DataFrame, value: str, keys: list[str], stale: int, ts: str = "ts", name: str | None = None) -> DataFrame:
    """The latest right value at or before each left row, null if older than ``stale`` seconds.

    Union and last-known value: one shuffle on the keys, no join blow-up however the sides lie.
    """
    name = name or value
    cols = [c for c in left.columns if c not in keys and c != ts]
    a = left.select(*keys, ts, F.struct(*cols).alias("_row") if cols else F.lit(None).cast("struct<x:int>").alias("_row"), F.lit(1).alias("_left"), F.lit(None).cast("long").alias("_at"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.filter(F.col(value).isNotNull()).groupBy(*keys, ts).agg(F.max(value).alias(value))
    b = b.select(*keys, ts, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_left"), F.col(ts).cast("long").alias("_at"), F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy(ts, "_left").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("_at", F.last("_at", True).over(w)).withColumn("_v", F.last("_v", True).over(w)).filter("_left = 1")
    fresh = F.when(F.col(ts) - F.col("_at") <= stale, F.col("_v"))
    return seen.select(*keys, ts, *([F.col(f"_row.{c}") for c in cols]), fresh.alias(name), F.when(fresh.isNotNull(), F.col("_at")).alias(f"{name}_ts"))


def nearest(rows: DataFrame, value: str, keys: list[str], back: int, tolerance: int, name: str, ts: str = "ts", order: str | None = None) -> DataFrame:
    """Each row with the value nearest to ``back`` seconds earlier, within the tolerance; of equally far times the later one.

    Two one-sided looks over the union of rows and targets. Of rows of one time, ``order`` tells which is nearest: the last
    of them from behind, the first from ahead. Without it times are unique within the keys.
    """
    targets = rows.withColumn("_at", F.col(ts) - back).withColumn("_target", F.lit(1))
    known = rows.select(*keys, F.col(ts).alias("_at"), F.lit(0).alias("_target"), F.col(ts).alias("_ts"), F.col(value).alias("_v"), *([F.col(order).alias("_o")] if order else []))
    both = targets.withColumn("_ts", F.lit(None).cast("long")).withColumn("_v", F.lit(None).cast(rows.schema[value].dataType)).unionByName(known, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("_at", "_target", *([F.col("_o")] if order else [])).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.col("_at").desc(), "_target", *([F.col("_o").desc()] if order else [])).rowsBetween(Window.unboundedPreceding, 0)
    pair = F.when(F.col("_target") == 0, F.struct("_ts", "_v"))
    seen = both.withColumn("_b", F.last(pair, True).over(before)).withColumn("_a", F.last(pair, True).over(after)).filter("_target = 1")
    gap_b, gap_a = F.col("_at") - F.col("_b._ts"), F.col("_a._ts") - F.col("_at")
    chosen = F.when((gap_a <= tolerance) & (gap_b.isNull() | (gap_a <= gap_b)), F.col("_a")).when(gap_b <= tolerance, F.col("_b"))
    return seen.withColumn("_c", chosen).select(*rows.columns, F.col("_c._v").alias(name), F.col("_c._ts").alias(f"{name}_ts"))


def chunked(rows: DataFrame, ts: str, chunk: int, back: int, ahead: int = 0) -> DataFrame:
    """Rows dealt to chunks of time, with a halo of ``back`` and ``ahead`` seconds around each.

    Adds ``chunk`` and ``halo``; windows over (keys, chunk) see what they need, and rows with halo true
    are dropped afterwards. So one instrument's history runs on many tasks.
    """
    first = F.floor((F.col(ts) - ahead) / chunk)
    last = F.floor((F.col(ts) + back) / chunk)
    dealt = rows.withColumn("chunk", F.explode(F.sequence(first, last)))
    return dealt.withColumn("halo", F.col("chunk") != F.floor(F.col(ts) / chunk))


def compared(own: DataFrame, other: DataFrame, on: list[str], volume: bool = True) -> DataFrame:
    """One row per price field: median, mean, p95 and largest distance in basis points."""
    both = own.join(other.select(*on, *[F.col(c).alias(f"{c}_other") for c in ("open", "high", "low", "close")]), on)
    fields = F.array(*[F.struct(F.lit(c).alias("field"), (F.abs(F.col(c) - F.col(f"{c}_other")) / F.col(f"{c}_other") * 1e4).alias("bps")) for c in ("open", "high", "low", "close")])
    return both.select(F.explode(fields).alias("x")).groupBy("x.field").agg(
        F.count("*").alias("n"), F.percentile("x.bps", F.lit(0.5)).alias("median_bps"), F.avg("x.bps").alias("mean_bps"), F.percentile("x.bps", F.lit(0.95)).alias("p95_bps"), F.max("x.bps").alias("max_bps")
    )


def gaps(rows: DataFrame, ts: str, step: int, long_gap: int, keys: tuple[str, ...], chunk: int = 86_400) -> DataFrame:
    """Breaks of the cadence: how many, how many long ones, missing time, the longest, and coverage.

    Gaps inside a chunk of time are found in that chunk; the gap between two chunks comes from their
    ends, a row a chunk. So one stream's history is never sorted in one task.
    """
    cut = rows.select(*keys, F.col(ts).alias("_t"), F.floor(F.col(ts) / chunk).alias("_c"))
    gap = F.col("_t") - F.lag("_t").over(Window.partitionBy(*keys, "_c").orderBy("_t"))

    def told(g: str) -> list:
        x = F.col(g)
        return [F.count(F.when(x > step, 1)).alias("breaks"), F.count(F.when(x >= long_gap, 1)).alias("long_gaps"), F.coalesce(F.sum(F.when(x > step, x - step)), F.lit(0)).alias("missing_sec"), F.max(x).alias("longest_gap")]

    inside = cut.withColumn("_g", gap).groupBy(*keys, "_c").agg(F.count("*").alias("n"), F.min("_t").alias("_a"), F.max("_t").alias("_z"), *told("_g"))
    between = F.col("_a") - F.lag("_z").over(Window.partitionBy(*keys).orderBy("_c"))
    edge = inside.withColumn("_e", between)
    whole = edge.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum("breaks") + F.count(F.when(F.col("_e") > step, 1))).alias("breaks"),
        (F.sum("long_gaps") + F.count(F.when(F.col("_e") >= long_gap, 1))).alias("long_gaps"),
        (F.sum("missing_sec") + F.coalesce(F.sum(F.when(F.col("_e") > step, F.col("_e") - step)), F.lit(0))).alias("missing_sec"),
        F.greatest(F.max("longest_gap"), F.max("_e")).alias("longest_gap"),
        (F.max("_z") - F.min("_a") + step).alias("_span"),
    )
    return whole.withColumn("coverage_pct", F.col("n") * step * 100.0 / F.col("_span")).drop("_span")
