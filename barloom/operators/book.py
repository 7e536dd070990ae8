"""Order books in batch form: the state after a message, its best prices, bands, walls, and flows.

A change row has key, side ("bid" or "ask"), price, qty (0 deletes the level) and seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import islands


def state_at(changes: DataFrame, keys: list[str], until: Column | None = None) -> DataFrame:
    """Levels with quantity after the last change (up to ``until``): one aggregation, combined before the shuffle."""
    rows = changes if until is None else changes.filter(F.col("seq") <= until)
    last = rows.groupBy(*keys, "side", "price").agg(F.max_by("qty", "seq").alias("qty"))
    return last.filter("qty > 0")


def best(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Best bid and ask with their quantities."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    return levels.groupBy(*keys).agg(
        F.max(F.when(bid, F.col("price"))).alias("best_bid"),
        F.max_by("qty", F.when(bid, F.col("price"))).alias("bid_qty"),
        F.min(F.when(ask, F.col("price"))).alias("best_ask"),
        F.min_by("qty", F.when(ask, F.col("price"))).alias("ask_qty"),
    )


def _near(levels: DataFrame, keys: list[str]) -> DataFrame:
    b = best(levels, keys)
    bid = F.col("side") == "bid"
    touch = F.when(bid, F.col("best_bid")).otherwise(F.col("best_ask"))
    away = F.when(bid, touch - F.col("price")).otherwise(F.col("price") - touch) / touch * 100
    return levels.join(b, keys).withColumn("pct", away)


def bands(levels: DataFrame, keys: list[str], steps: list[float], tolerance: float = 1e-6) -> DataFrame:
    """Liquidity within each percentage of the best price: a bucket by level and a running sum, not a scan per step."""
    step = F.coalesce(*[F.when(F.col("pct") <= s + tolerance, F.lit(k)) for k, s in enumerate(steps)])
    sums = _near(levels, keys).withColumn("step", step).filter("step is not null").groupBy(*keys, "step").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("qty"))), F.lit(0.0)).alias(s) for s in ("bid", "ask")])
    grid = levels.select(*keys).distinct().withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(len(steps))])))
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(sums, [*keys, "step"], "left").na.fill(0.0, ["bid", "ask"])
    out = full.withColumn("bid_liq", F.sum("bid").over(w)).withColumn("ask_liq", F.sum("ask").over(w))
    return out.withColumn("pct", F.element_at(F.array(*[F.lit(s) for s in steps]), F.col("step") + 1)).select(*keys, "pct", "bid_liq", "ask_liq")


def walls(levels: DataFrame, keys: list[str], within_pct: float) -> DataFrame:
    """The largest level near the touch on either side and its distance in percent of the mid; 0 and -1 without one.

    Of equal levels the closest to the touch counts.
    """
    near = _near(levels, keys).withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2).filter(F.col("pct") <= within_pct)
    out = []
    for s in ("bid", "ask"):
        mine = F.col("side") == s
        out += [
            F.coalesce(F.max(F.when(mine, F.col("qty"))), F.lit(0.0)).alias(f"{s}_wall_qty"),
            F.coalesce(F.max_by(F.abs(F.col("price") - F.col("mid")) / F.col("mid") * 100, F.when(mine, F.struct(F.col("qty"), -F.col("pct")))), F.lit(-1.0)).alias(f"{s}_wall_dist"),
        ]
    return levels.select(*keys).distinct().join(near.groupBy(*keys).agg(*out), keys, "left").na.fill(0.0, ["bid_wall_qty", "ask_wall_qty"]).na.fill(-1.0, ["bid_wall_dist", "ask_wall_dist"])


def microprice_deviation(bid: str, ask: str, bid_qty: str, ask_qty: str) -> Column:
    """Price weighted by the other side's quantity, less the mid."""
    total = F.col(bid_qty) + F.col(ask_qty)
    return F.when(total > 0, (F.col(bid_qty) * F.col(ask) + F.col(ask_qty) * F.col(bid)) / total - (F.col(bid) + F.col(ask)) / 2)


def order_flow(quotes: DataFrame, keys: tuple[str, ...], order: str, bid: str, ask: str, bid_qty: str, ask_qty: str) -> DataFrame:
    """Order-flow imbalance of each quote against the one before it; 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    lag = lambda c: F.lag(c).over(w)
    b = F.when(F.col(bid) >= lag(bid), F.col(bid_qty)).otherwise(0.0) - F.when(F.col(bid) <= lag(bid), lag(bid_qty)).otherwise(0.0)
    a = F.when(F.col(ask) <= lag(ask), F.col(ask_qty)).otherwise(0.0) - F.when(F.col(ask) >= lag(ask), lag(ask_qty)).otherwise(0.0)
    moved = (F.col(bid) != lag(bid)).cast("int"), (F.col(ask) != lag(ask)).cast("int")
    # a best price that moves away from the mid means that its old level is gone
    quotes = quotes.withColumn("bid_depleted", F.coalesce((F.col(bid) < lag(bid)).cast("int"), F.lit(0))).withColumn("ask_depleted", F.coalesce((F.col(ask) > lag(ask)).cast("int"), F.lit(0)))
    return quotes.withColumn("ofi", F.coalesce(b - a, F.lit(0.0))).withColumn("bid_moved", F.coalesce(moved[0], F.lit(0))).withColumn("ask_moved", F.coalesce(moved[1], F.lit(0)))


def add_cancel(changes: DataFrame, keys: tuple[str, ...], mid: str, near_pct: float, wide_pct: float) -> DataFrame:
    """Quantity added and cancelled by side, near the mid and in the wide band that includes it."""
    w = Window.partitionBy(*keys, "side", "price").orderBy("seq")
    delta = F.col("qty") - F.coalesce(F.lag("qty").over(w), F.lit(0.0))
    rows = changes.withColumn("_d", delta).withColumn("_p", F.abs(F.col("price") - F.col(mid)) / F.col(mid) * 100)
    out = []
    for band, pct in (("near", near_pct), ("wide", wide_pct)):
        for s in ("bid", "ask"):
            mine = (F.col("side") == s) & (F.col("_p") <= pct)
            out += [F.coalesce(F.sum(F.when(mine & (F.col("_d") > 0), F.col("_d"))), F.lit(0.0)).alias(f"add_{s}_{band}"), F.coalesce(F.sum(F.when(mine & (F.col("_d") < 0), -F.col("_d"))), F.lit(0.0)).alias(f"cancel_{s}_{band}")]
    return rows.groupBy(*keys).agg(*out)


def with_previous_mid(changes: DataFrame, mids: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Changes with mid, the last one of their book from before their message; null before the first, so that no band holds them.

    mids: keys, seq, mid. Union and last-known value over one sort, no join.
    """
    a = changes.withColumn("mid", F.lit(None).cast("double")).withColumn("_change", F.lit(1))
    b = mids.select(*keys, "seq", F.col("mid").cast("double").alias("mid")).withColumn("_change", F.lit(0))
    before = Window.partitionBy(*keys).orderBy("seq", F.col("_change").desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = a.unionByName(b, allowMissingColumns=True).withColumn("mid", F.last("mid", True).over(before))
    return known.filter("_change = 1").drop("_change")


def sequence_audit(diffs: DataFrame, keys: tuple[str, ...], order: str, first: str, last: str) -> DataFrame:
    """Each diff as start, ok, stale or gap against the last id seen so far, and the ids missed."""
    w = Window.partitionBy(*keys).orderBy(order)
    seen = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    status = F.when(seen.isNull(), "start").when(F.col(last) <= seen, "stale").when(F.col(first) <= seen + 1, "ok").otherwise("gap")
    return diffs.withColumn("status", status).withColumn("missed", F.when(status == "gap", F.col(first) - seen - 1).otherwise(0))


def id_gaps(trades: DataFrame, keys: tuple[str, ...], order: str, trade_id: str) -> DataFrame:
    """Trades whose id skips some, and how many."""
    before = F.lag(trade_id).over(Window.partitionBy(*keys).orderBy(order))
    return trades.withColumn("missed", F.col(trade_id) - before - 1).filter("missed > 0")


def runs_of(c: str, keys: tuple[str, ...], order: str) -> Column:
    w = Window.partitionBy(*keys).orderBy(order)
    return islands(F.col(c) != F.coalesce(F.lag(c).over(w), F.lit(-1)), w)
