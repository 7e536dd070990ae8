"""Bars from the trade tape, a second market and the message stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources.tables import DAY, messages, second_market, table, tape
from .shared import DAILY, TAPE, rounded, rsql

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query(f"WITH {TAPE} SELECT stream, bar, count(*) AS trades, round(sum(qty), 6) AS qty FROM tape GROUP BY ALL")
def bar_tumbling(spark, sf_dir):
    return rounded(B.bars(tape(spark, sf_dir), DAY, F.count("*").alias("trades"), F.sum("qty").alias("qty")))


@query(f"WITH {DAILY} SELECT stream, bar, samples, {rsql('open', 'close', 'min', 'median', 'max')} FROM daily")
def bar_ohlc_stats(spark, sf_dir):
    return rounded(B.bars(tape(spark, sf_dir), DAY, *B.six_stats("mid", "seq")))


@query(f"WITH {DAILY} SELECT stream, bar, buy_samples, sell_samples, {rsql('buy_qty', 'buy_vwap', 'sell_qty', 'sell_vwap')} FROM daily")
def bar_side_vwap(spark, sf_dir):
    return rounded(B.bars(tape(spark, sf_dir), DAY, *B.side_stats()))


@query(f"WITH {DAILY} SELECT stream, bar, round(close - open, 6) AS price_diff FROM daily")
def bar_price_diff(spark, sf_dir):
    return rounded(B.bars(tape(spark, sf_dir), DAY, (F.max_by("mid", "seq") - F.min_by("mid", "seq")).alias("price_diff")))


MOVES = f"""{TAPE},
moves AS (SELECT *, mid - lag(mid) OVER (PARTITION BY stream, bar ORDER BY seq) AS move FROM tape),
signs AS (SELECT *, CASE WHEN move > 0 THEN 1 WHEN move < 0 THEN -1 END AS sgn FROM moves),
turns AS (SELECT *, last_value(sgn IGNORE NULLS) OVER (PARTITION BY stream, bar ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM signs)"""


@query(f"""WITH {MOVES} SELECT stream, bar, count(*) AS samples, round(CASE WHEN count(*) >= 3 THEN stddev_pop(mid) ELSE 0 END, 6) AS mid_std,
  round(CASE WHEN count(*) >= 3 THEN sum(move * move) ELSE 0 END, 4) AS mid_rv FROM turns GROUP BY stream, bar""")
def bar_mid_vol(spark, sf_dir):
    got = B.mid_volatility(tape(spark, sf_dir), DAY)
    return got.select("stream", "bar", "samples", F.round("mid_std", 6).alias("mid_std"), F.round("mid_rv", 4).alias("mid_rv"))


@query(f"WITH {MOVES} SELECT stream, bar, CASE WHEN count(*) >= 3 THEN count(*) FILTER (sgn <> before) ELSE 0 END AS mid_flips FROM turns GROUP BY stream, bar")
def bar_flips(spark, sf_dir):
    return B.mid_volatility(tape(spark, sf_dir), DAY).select("stream", "bar", "mid_flips")


HALVES = f"""{TAPE},
numbered AS (SELECT *, row_number() OVER (PARTITION BY stream, bar ORDER BY seq) AS k, count(*) OVER (PARTITION BY stream, bar) AS n FROM tape),
halves AS (SELECT *, k <= greatest(n // 2, 1) AS early FROM numbered),
sequence AS (SELECT stream, bar, arg_min(side, k) AS first_side, arg_max(side, k) AS last_side, max(qty) AS largest_qty, arg_max(side, qty * 1e6 - k) AS largest_side,
  count(*) FILTER (early AND side = 1) AS early_buy_count, coalesce(sum(qty) FILTER (early AND side = 1), 0.0) AS early_buy_qty,
  count(*) FILTER (early AND side = -1) AS early_sell_count, coalesce(sum(qty) FILTER (early AND side = -1), 0.0) AS early_sell_qty,
  count(*) FILTER (NOT early AND side = 1) AS late_buy_count, coalesce(sum(qty) FILTER (NOT early AND side = 1), 0.0) AS late_buy_qty,
  count(*) FILTER (NOT early AND side = -1) AS late_sell_count, coalesce(sum(qty) FILTER (NOT early AND side = -1), 0.0) AS late_sell_qty
  FROM halves GROUP BY stream, bar)"""


@query(f"WITH {HALVES} SELECT stream, bar, early_buy_count, early_sell_count, late_buy_count, late_sell_count, {rsql('early_buy_qty', 'early_sell_qty', 'late_buy_qty', 'late_sell_qty')} FROM sequence")
def bar_trade_halves(spark, sf_dir):
    return rounded(B.trade_sequence(tape(spark, sf_dir), DAY).drop("first_side", "last_side", "largest_qty", "largest_side"))


@query(f"WITH {HALVES} SELECT stream, bar, first_side, last_side, round(largest_qty, 6) AS largest_qty, largest_side FROM sequence")
def bar_largest_trade(spark, sf_dir):
    return rounded(B.trade_sequence(tape(spark, sf_dir), DAY).select("stream", "bar", "first_side", "last_side", "largest_qty", "largest_side"))


SIZES = ", ".join(f"coalesce(quantile_cont(qty, {q}) FILTER (side = {s}), 0) AS {n}_size_{t}" for n, s in (("buy", 1), ("sell", -1)) for t, q in (("median", 0.5), ("p90", 0.9)))


@query(f"WITH {TAPE}, sizes AS (SELECT stream, bar, {SIZES} FROM tape GROUP BY stream, bar) SELECT stream, bar, {rsql('buy_size_median', 'buy_size_p90', 'sell_size_median', 'sell_size_p90')} FROM sizes")
def bar_size_quantiles(spark, sf_dir):
    return rounded(B.bars(tape(spark, sf_dir), DAY, *B.size_quantiles()))


def sided(spark, sf_dir):
    """Messages as trades: purchases buy, signups sell."""
    side = F.when(F.col("kind") == "purchase", 1).when(F.col("kind") == "signup", -1)
    return messages(spark, sf_dir).withColumn("side", side).withColumnRenamed("value", "qty")


@query("""WITH b AS (SELECT (epoch_us(ts) // 1000000) // 21600 * 21600 AS bar, epoch_us(ts) // 600000000 AS batch,
  coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS buy, coalesce(sum(value) FILTER (event_type = 'signup'), 0) AS sell FROM events GROUP BY ALL)
SELECT bar, round(max(buy), 6) AS buy_burst, round(max(sell), 6) AS sell_burst FROM b GROUP BY bar""")
def bar_burst_max(spark, sf_dir):
    return rounded(B.burst(sided(spark, sf_dir), 21_600, 600_000_000, keys=()))


RUNS = f"""{TAPE},
chg AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) OVER (PARTITION BY stream, bar ORDER BY seq) THEN 1 ELSE 0 END AS c FROM tape),
isl AS (SELECT *, sum(c) OVER (PARTITION BY stream, bar ORDER BY seq) AS run FROM chg),
runs0 AS (SELECT stream, bar, run, any_value(side) AS side, sum(qty) AS qty FROM isl GROUP BY ALL),
runs AS (SELECT stream, bar, coalesce(max(qty) FILTER (side = 1), 0.0) AS buy_sweep, coalesce(max(qty) FILTER (side = -1), 0.0) AS sell_sweep,
  arg_min(side, run) AS lead_side, arg_min(qty, run) AS lead_qty, arg_max(side, run) AS tail_side, arg_max(qty, run) AS tail_qty, count(*) AS n_runs FROM runs0 GROUP BY stream, bar)"""


@query(f"WITH {RUNS} SELECT stream, bar, {rsql('buy_sweep', 'sell_sweep')} FROM runs")
def bar_sweep_runs(spark, sf_dir):
    return rounded(B.runs(tape(spark, sf_dir), DAY).select("stream", "bar", "buy_sweep", "sell_sweep"))


@query(f"WITH {RUNS} SELECT stream, bar, lead_side, {rsql('lead_qty')}, tail_side, {rsql('tail_qty')}, n_runs FROM runs")
def bar_lead_tail_runs(spark, sf_dir):
    return rounded(B.runs(tape(spark, sf_dir), DAY).drop("buy_sweep", "sell_sweep"))


SUFFICIENT = f"""{MOVES},
suff AS (SELECT stream, bar, count(mid) AS samples, sum(mid) AS mid_sum, var_pop(mid) * count(mid) AS mid_m2, arg_min(mid, seq) AS mid_open, arg_max(mid, seq) AS mid_close,
  coalesce(sum(move * move), 0) AS rv, count(*) FILTER (sgn <> before) AS flips, coalesce(arg_min(sgn, seq) FILTER (sgn IS NOT NULL), 0) AS first_sign,
  coalesce(arg_max(sgn, seq) FILTER (sgn IS NOT NULL), 0) AS last_sign, coalesce(sum(qty * qty) FILTER (side = 1), 0.0) AS buy_sumsq, coalesce(sum(qty * qty) FILTER (side = -1), 0.0) AS sell_sumsq
  FROM turns GROUP BY stream, bar)"""


@query(f"WITH {SUFFICIENT} SELECT stream, bar, samples, flips, first_sign, last_sign, {rsql('mid_open', 'mid_close')}, {rsql('mid_sum', 'mid_m2', 'rv', 'buy_sumsq', 'sell_sumsq', digits=3)} FROM suff")
def bar_sufficient_stats(spark, sf_dir):
    got = B.sufficient(tape(spark, sf_dir), DAY)
    return got.select(*[F.round(c, 6 if c in ("mid_open", "mid_close") else 3).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


SECOND = "future AS (SELECT CAST(epoch(o_orderdate) AS BIGINT) // 86400 * 86400 AS bar, count(o_totalprice) AS samples, arg_min(o_totalprice, o_orderkey) AS open, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1)"
SPOT = "spot AS (SELECT bar, count(mid) AS samples, arg_min(mid, seq) AS open, arg_max(mid, seq) AS close FROM tape GROUP BY 1)"


def two_markets(spark, sf_dir):
    stats = lambda c: B.six_stats(c, "seq")[:3]
    return B.bars(tape(spark, sf_dir), DAY, *stats("mid"), keys=()), B.bars(second_market(spark, sf_dir), DAY, *stats("price"), keys=())


@query(f"""WITH {TAPE}, {SPOT}, {SECOND} SELECT s.bar, s.samples AS spot_samples, round(s.open, 6) AS spot_open, round(s.close, 6) AS spot_close,
  f.samples AS future_samples, round(f.open, 6) AS future_open, round(f.close, 6) AS future_close FROM spot s JOIN future f USING (bar)""")
def bar_market_pairing(spark, sf_dir):
    return rounded(B.paired(*two_markets(spark, sf_dir), ("spot", "future")))


@query(f"WITH {TAPE}, {SPOT}, {SECOND} SELECT bar, samples, {rsql('open', 'close')} FROM spot WHERE bar NOT IN (SELECT bar FROM future)")
def bar_skipped_anti(spark, sf_dir):
    return rounded(B.unpaired(*two_markets(spark, sf_dir)))


@query("""WITH e AS (SELECT (epoch_us(ts) // 1000000) // 3600 * 3600 AS bar, event_type AS k, value AS v, event_id AS seq FROM events)
SELECT bar, round(coalesce(sum(v) FILTER (k = 'purchase'), 0), 6) AS purchase_sum, round(coalesce(max(v) FILTER (k = 'error'), 0), 6) AS error_max,
  round(coalesce(quantile_cont(v, 0.5) FILTER (k = 'click'), -1), 6) AS click_median, count(v) FILTER (k = 'click') AS click_count, round(coalesce(sum(v) FILTER (k = 'click'), 0), 6) AS click_sum,
  round(coalesce(arg_min(v, seq) FILTER (k = 'view'), -1), 6) AS view_open, round(coalesce(arg_max(v, seq) FILTER (k = 'view'), -1), 6) AS view_close,
  round(coalesce(quantile_cont(v, 0.5) FILTER (k = 'view'), -1), 6) AS view_median, count(v) FILTER (k = 'view') AS view_count FROM e GROUP BY bar""")
def bar_optional_stats(spark, sf_dir):
    return rounded(B.optional_stats(messages(spark, sf_dir), 3600, {"purchase": "sum", "error": "max", "click": "median", "view": "ocm"}))


@query("""WITH e AS (SELECT (epoch_us(ts) // 1000000) // 86400 * 86400 AS bar, value AS qty, CASE WHEN event_type = 'error' THEN -1.0 ELSE (event_id % 30) / 100.0 END AS dist FROM events)
SELECT bar, round(coalesce(quantile_cont(qty, 0.5) FILTER (dist >= 0), 0), 6) AS wall_median, round(coalesce(max(qty) FILTER (dist >= 0), 0), 6) AS wall_max,
  round(coalesce(quantile_cont(dist, 0.5) FILTER (dist >= 0), -1), 6) AS wall_dist, count(qty) FILTER (dist >= 0) AS wall_count, round(coalesce(sum(qty) FILTER (dist >= 0), 0), 6) AS wall_sum FROM e GROUP BY bar""")
def bar_wall_stats(spark, sf_dir):
    dist = F.when(F.col("kind") == "error", -1.0).otherwise((F.col("seq") % 30) / 100.0)
    return rounded(B.wall_stats(messages(spark, sf_dir).withColumn("dist", dist), DAY, "value", "dist", ()))


@query(f"""WITH pair AS ({ORACLE['bar_market_pairing']}), o AS (SELECT CAST(epoch(o_orderdate) AS BIGINT) // 86400 * 86400 AS bar, max(o_totalprice) AS urgent_max, min(o_totalprice) AS urgent_min FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT pair.*, round(coalesce(urgent_max, -1), 6) AS urgent_max, round(coalesce(urgent_min, -1), 6) AS urgent_min FROM pair LEFT JOIN o USING (bar)""")
def bar_optional_pairing(spark, sf_dir):
    """Urgent orders are the optional stream: not every bar has one."""
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_totalprice").cast("double").alias("price"))
    urgent = B.bars(orders, DAY, F.max("price").alias("urgent_max"), F.min("price").alias("urgent_min"), keys=())
    return rounded(B.with_optional(bar_market_pairing(spark, sf_dir), urgent))
