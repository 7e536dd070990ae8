"""Daily bars merged into weeks and longer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import joins as J
from ..operators import merge as M
from ..sources.tables import DAY, second_market, tape
from .market import HALVES, SIZES
from .shared import DAILY, TAPE, WEEK, daily, rounded, rsql

QUERIES, ORACLE = {}, {}
OUT = "bar // 604800 * 604800 AS out"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query(f"""WITH {DAILY}, d AS (SELECT stream, bar - lag(bar) OVER (PARTITION BY stream ORDER BY bar) AS step FROM daily),
c AS (SELECT stream, step, count(*) AS n FROM d WHERE step IS NOT NULL GROUP BY ALL)
SELECT stream, arg_max(step, n * 1e12 - step) AS interval, CAST(sum(n) AS BIGINT) AS steps FROM c GROUP BY stream""")
def agg_infer_interval(spark, sf_dir):
    return M.infer_interval(daily(spark, sf_dir))


@query(f"WITH {DAILY} SELECT stream, {OUT}, CAST(sum(buy_samples) AS BIGINT) AS buy_samples, round(sum(buy_qty), 6) AS buy_qty, CAST(sum(sell_samples) AS BIGINT) AS sell_samples, round(sum(sell_qty), 6) AS sell_qty FROM daily GROUP BY ALL")
def agg_additive(spark, sf_dir):
    return rounded(M.additive(daily(spark, sf_dir).select("stream", "bar", "buy_samples", "buy_qty", "sell_samples", "sell_qty"), WEEK))


def weighted(value: str, weight: str, source: str, name: str) -> str:
    """SQL of the lower weighted median by (stream, out)."""
    return f"""{name}_c AS (SELECT stream, out, {value} AS v, sum({weight}) OVER (PARTITION BY stream, out) AS t, sum({weight}) OVER (PARTITION BY stream, out ORDER BY {value}) AS c FROM {source} WHERE {weight} > 0 AND {value} IS NOT NULL),
{name}_m AS (SELECT stream, out, min(v) AS {name} FROM {name}_c WHERE c >= 0.5 * t GROUP BY ALL)"""


WIDE = f"{DAILY}, wide AS (SELECT *, {OUT} FROM daily)"


@query(f"""WITH {WIDE}, {weighted('median', 'samples', 'wide', 'med')}, b AS (SELECT stream, out, CAST(sum(samples) AS BIGINT) AS samples, arg_min(open, bar) AS open, arg_max(close, bar) AS close, min(min) AS min, max(max) AS max FROM wide GROUP BY stream, out)
SELECT stream, out, samples, {rsql('open', 'close', 'min', 'max')}, round(med, 6) AS median FROM b LEFT JOIN med_m USING (stream, out)""")
def agg_series_block(spark, sf_dir):
    return rounded(M.series_block(daily(spark, sf_dir), WEEK))


@query(f"WITH {WIDE}, {weighted('buy_vwap', 'buy_qty', 'wide', 'vwap_median')} SELECT stream, out, {rsql('vwap_median')} FROM vwap_median_m")
def agg_weighted_median(spark, sf_dir):
    return rounded(M.weighted_median(M.widened(daily(spark, sf_dir), WEEK), ["stream", "out"], "buy_vwap", "buy_qty", "vwap_median"))


@query(f"WITH {WIDE} SELECT stream, out, {rsql('buy_qty', 'buy_vwap', 'sell_qty', 'sell_vwap')} FROM (SELECT stream, out, sum(buy_qty) AS buy_qty, CASE WHEN sum(buy_qty) > 1e-9 THEN sum(buy_qty * buy_vwap) / sum(buy_qty) ELSE 0 END AS buy_vwap, sum(sell_qty) AS sell_qty, CASE WHEN sum(sell_qty) > 1e-9 THEN sum(sell_qty * sell_vwap) / sum(sell_qty) ELSE 0 END AS sell_vwap FROM wide GROUP BY stream, out)")
def agg_vwap_merge(spark, sf_dir):
    return rounded(M.vwap(daily(spark, sf_dir), WEEK))


@query(f"WITH {TAPE}, t AS (SELECT *, {OUT} FROM tape) SELECT stream, out, count(*) AS samples, round(avg(mid), 4) AS mean, round(var_pop(mid) * count(*), 2) AS mid_m2, round(stddev_pop(mid), 4) AS mid_std FROM t GROUP BY stream, out")
def agg_chan_variance(spark, sf_dir):
    """The oracle computes it from raw trades: the merge is exact."""
    got = M.variance(B.sufficient(tape(spark, sf_dir), DAY), WEEK)
    return got.select("stream", "out", "samples", F.round("mean", 4).alias("mean"), F.round("mid_m2", 2).alias("mid_m2"), F.round("mid_std", 4).alias("mid_std"))


RAW = f"""{TAPE}, t AS (SELECT *, {OUT} FROM tape), mv AS (SELECT *, mid - lag(mid) OVER w AS move FROM t WINDOW w AS (PARTITION BY stream, out ORDER BY bar, seq)),
sg AS (SELECT *, CASE WHEN move > 0 THEN 1 WHEN move < 0 THEN -1 END AS sgn, row_number() OVER (PARTITION BY stream, out ORDER BY bar, seq) AS k FROM mv),
tn AS (SELECT *, last_value(sgn IGNORE NULLS) OVER (PARTITION BY stream, out ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sg)"""


@query(f"WITH {RAW} SELECT stream, out, round(coalesce(sum(move * move), 0), 2) AS rv FROM mv GROUP BY stream, out")
def agg_rv_boundary(spark, sf_dir):
    """The oracle takes raw trades of the wide bar."""
    return rounded(M.realised_variance(B.sufficient(tape(spark, sf_dir), DAY), WEEK), 2)


@query(f"WITH {RAW} SELECT stream, out, count(*) FILTER (sgn <> before) AS flips, coalesce(arg_min(sgn, k) FILTER (sgn IS NOT NULL), 0) AS first_sign, coalesce(arg_max(sgn, k) FILTER (sgn IS NOT NULL), 0) AS last_sign FROM tn GROUP BY stream, out")
def agg_flips_merge(spark, sf_dir):
    """The oracle takes raw trades of the wide bar."""
    return M.flips(B.sufficient(tape(spark, sf_dir), DAY), WEEK)


@query(f"""WITH {TAPE}, t AS (SELECT *, {OUT} FROM tape), chg AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) OVER (PARTITION BY stream, out ORDER BY bar, seq) THEN 1 ELSE 0 END AS c FROM t),
isl AS (SELECT *, sum(c) OVER (PARTITION BY stream, out ORDER BY bar, seq) AS run FROM chg), r AS (SELECT stream, out, run, any_value(side) AS side, sum(qty) AS qty FROM isl GROUP BY ALL)
SELECT stream, out, round(coalesce(max(qty) FILTER (side = 1), 0), 6) AS buy_sweep, round(coalesce(max(qty) FILTER (side = -1), 0), 6) AS sell_sweep, arg_min(side, run) AS lead_side, round(arg_min(qty, run), 6) AS lead_qty,
  arg_max(side, run) AS tail_side, round(arg_max(qty, run), 6) AS tail_qty FROM r GROUP BY stream, out""")
def agg_run_stitch(spark, sf_dir):
    """The oracle takes raw trades of the wide bar."""
    return rounded(M.stitched_runs(B.runs(tape(spark, sf_dir), DAY), WEEK))


@query(f"""WITH {HALVES}, w AS (SELECT *, {OUT} FROM sequence),
p AS (SELECT stream, out, bar, 0 AS slot, early_buy_count + early_sell_count AS cnt, early_buy_qty AS buy, early_sell_qty AS sell, early_buy_count AS nb, early_sell_count AS ns FROM w UNION ALL SELECT stream, out, bar, 1, late_buy_count + late_sell_count, late_buy_qty, late_sell_qty, late_buy_count, late_sell_count FROM w),
q AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY stream, out ORDER BY bar, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev, sum(cnt) OVER (PARTITION BY stream, out) // 2 AS half FROM p),
s AS (SELECT *, CASE WHEN cnt > 0 THEN least(cnt, greatest(half - prev, 0)) / cnt ELSE 0.0 END AS share FROM q)
SELECT stream, out, round(sum(share * buy), 6) AS early_buy_qty, round(sum((1 - share) * buy), 6) AS late_buy_qty, round(sum(share * sell), 6) AS early_sell_qty, round(sum((1 - share) * sell), 6) AS late_sell_qty,
  round(sum(share * nb), 6) AS early_buy_count, round(sum((1 - share) * nb), 6) AS late_buy_count, round(sum(share * ns), 6) AS early_sell_count, round(sum((1 - share) * ns), 6) AS late_sell_count FROM s GROUP BY stream, out""")
def agg_half_resplit(spark, sf_dir):
    return rounded(M.halves(B.trade_sequence(tape(spark, sf_dir), DAY), WEEK))


@query(f"WITH {HALVES}, w AS (SELECT *, {OUT} FROM sequence) SELECT stream, out, arg_min(first_side, bar) AS first_side, arg_max(last_side, bar) AS last_side, round(max(largest_qty), 6) AS largest_qty, arg_max(largest_side, largest_qty * 1e12 - bar) AS largest_side FROM w GROUP BY stream, out")
def agg_sequence_ends(spark, sf_dir):
    return rounded(M.sequence_ends(B.trade_sequence(tape(spark, sf_dir), DAY), WEEK))


@query(f"""WITH {TAPE}, s AS (SELECT stream, bar, {OUT}, count(*) FILTER (side = 1) AS bn, count(*) FILTER (side = -1) AS sn, {SIZES} FROM tape GROUP BY stream, bar),
{', '.join(weighted(f'{n}_size_{q}', f'{n[0]}n', 's', f'{n}_size_{q}') for n in ('buy', 'sell') for q in ('median', 'p90'))}
SELECT stream, out, {', '.join(f'round(coalesce({n}_size_{q}, 0), 6) AS {n}_size_{q}' for n in ('buy', 'sell') for q in ('median', 'p90'))}
FROM (SELECT DISTINCT stream, out FROM s) {' '.join(f'LEFT JOIN {n}_size_{q}_m USING (stream, out)' for n in ('buy', 'sell') for q in ('median', 'p90'))}""")
def agg_size_merge(spark, sf_dir):
    counts = [F.count(F.when(F.col("side") == s, 1)).alias(f"{n}_samples") for n, s in B.SIDES]
    return rounded(M.sizes(B.bars(tape(spark, sf_dir), DAY, *counts, *B.size_quantiles()), WEEK))


@query(f"WITH {DAILY} SELECT stream, {OUT}, count(*) AS n_bars, count(*) >= 7 AS full FROM daily GROUP BY ALL")
def agg_partial_windows(spark, sf_dir):
    return M.coverage(daily(spark, sf_dir), WEEK, 7)


@query(f"WITH {DAILY} SELECT stream, {OUT}, count(*) AS n_bars, true AS full FROM daily GROUP BY ALL HAVING count(*) >= 7")
def agg_require_full(spark, sf_dir):
    return M.coverage(daily(spark, sf_dir), WEEK, M.check_multiple(DAY, WEEK), require_full=True)


DEAL = "CASE WHEN buy_qty + sell_qty > 0 THEN (buy_qty * buy_vwap + sell_qty * sell_vwap) / (buy_qty + sell_qty) ELSE close END"


@query(f"""WITH {WIDE}, d AS (SELECT *, {DEAL} AS deal FROM wide)
SELECT stream, out, round(arg_min(close, bar), 6) AS open, round(greatest(max(deal), arg_min(close, bar), arg_max(close, bar)), 6) AS high, round(least(min(deal), arg_min(close, bar), arg_max(close, bar)), 6) AS low,
  round(arg_max(close, bar), 6) AS close, round(sum(buy_qty + sell_qty), 6) AS volume, count(*) AS n FROM d GROUP BY stream, out""")
def ohlcv_hybrid(spark, sf_dir):
    return rounded(M.candles(daily(spark, sf_dir), WEEK))


@query(f"""WITH {WIDE}, own AS (SELECT stream, out, arg_min(close, bar) AS open, max(close) AS high, min(close) AS low, arg_max(close, bar) AS close FROM wide GROUP BY stream, out),
r AS (SELECT *, ts // 604800 * 604800 AS out FROM tape), other AS (SELECT stream, out, arg_min(mid, bar * 1.0 + 0 * seq) AS x, max(mid) AS high, min(mid) AS low FROM r GROUP BY stream, out),
ends AS (SELECT stream, out, first(mid ORDER BY bar, seq) AS open, last(mid ORDER BY bar, seq) AS close FROM r GROUP BY stream, out),
b AS (SELECT unnest(['open', 'high', 'low', 'close']) AS field, unnest([abs(o.open - e.open) / e.open, abs(o.high - t.high) / t.high, abs(o.low - t.low) / t.low, abs(o.close - e.close) / e.close]) * 1e4 AS bps
  FROM own o JOIN other t USING (stream, out) JOIN ends e USING (stream, out))
SELECT field, count(*) AS n, round(quantile_cont(bps, 0.5), 4) AS median_bps, round(avg(bps), 4) AS mean_bps, round(quantile_cont(bps, 0.95), 4) AS p95_bps, round(max(bps), 4) AS max_bps FROM b GROUP BY field""")
def candle_compare_bps(spark, sf_dir):
    """Candles of daily closes against candles of every trade."""
    own = M.candles(daily(spark, sf_dir), WEEK, "mid")
    stats = B.six_stats("mid", "order")
    trades = tape(spark, sf_dir).withColumn("order", F.struct("ts", "seq"))
    other = B.bars(trades, WEEK, stats[1], stats[2], F.max("mid").alias("high"), F.min("mid").alias("low")).withColumnRenamed("bar", "out")
    return rounded(J.compared(own, other, ["stream", "out"]), 4)


@query(f"""WITH {WIDE}, o AS (SELECT CAST(epoch(o_orderdate) AS BIGINT) // 604800 * 604800 AS out, max(o_totalprice) AS high, min(o_totalprice) AS low, count(*) AS n FROM orders GROUP BY 1)
SELECT w.stream, w.out, round(max(w.max), 6) AS high, round(any_value(o.high), 6) AS other_high, any_value(o.n) AS other_n FROM wide w JOIN o USING (out) GROUP BY w.stream, w.out""")
def candle_equi_join(spark, sf_dir):
    own = M.widened(daily(spark, sf_dir), WEEK).groupBy("stream", "out").agg(F.max("max").alias("high"))
    other = B.bars(second_market(spark, sf_dir), WEEK, F.max("price").alias("other_high"), F.count("*").alias("other_n"), keys=()).withColumnRenamed("bar", "out")
    return rounded(own.join(other, "out").select("stream", "out", "high", "other_high", "other_n"))


@query("""WITH e AS (SELECT (epoch_us(ts) // 1000000) // 3600 * 3600 AS bar, value AS v, event_id AS seq FROM events WHERE event_type = 'view'),
b AS (SELECT bar, bar // 86400 * 86400 AS out, arg_min(v, seq) AS o, arg_max(v, seq) AS c, quantile_cont(v, 0.5) AS m, count(*) AS n FROM e GROUP BY bar),
k AS (SELECT out, m, sum(n) OVER (PARTITION BY out) AS t, sum(n) OVER (PARTITION BY out ORDER BY m) AS s FROM b), mm AS (SELECT out, min(m) AS m FROM k WHERE s >= 0.5 * t GROUP BY out),
days AS (SELECT DISTINCT (epoch_us(ts) // 1000000) // 86400 * 86400 AS out FROM events), x AS (SELECT out, arg_min(o, bar) AS o, arg_max(c, bar) AS c FROM b GROUP BY out),
h AS (SELECT (epoch_us(ts) // 1000000) // 3600 * 3600 AS bar, coalesce(max(value) FILTER (event_type = 'error'), 0) AS e FROM events GROUP BY 1), y AS (SELECT bar // 86400 * 86400 AS out, max(e) AS e FROM h GROUP BY 1)
SELECT out, round(y.e, 6) AS error_max, round(coalesce(o, -1), 6) AS view_open, round(coalesce(c, -1), 6) AS view_close, round(coalesce(mm.m, -1), 6) AS view_median FROM days LEFT JOIN x USING (out) LEFT JOIN mm USING (out) LEFT JOIN y USING (out)""")
def agg_optional_merge(spark, sf_dir):
    from ..sources.tables import messages

    hourly = B.optional_stats(messages(spark, sf_dir), 3600, {"view": "ocm", "error": "max"})
    return rounded(M.optional(hourly, DAY, "view", maxima=("error_max",)))


@query("""WITH e AS (SELECT (epoch_us(ts) // 1000000) AS ts FROM events), g AS (SELECT ts, ts - lag(ts) OVER (ORDER BY ts) AS gap FROM e)
SELECT 'events' AS stream, count(*) AS n, count(*) FILTER (gap > 300) AS breaks, count(*) FILTER (gap >= 900) AS long_gaps, CAST(coalesce(sum(gap - 300) FILTER (gap > 300), 0) AS BIGINT) AS missing_sec,
  max(gap) AS longest_gap, round(count(*) * 300 * 100.0 / (max(ts) - min(ts) + 300), 6) AS coverage_pct FROM g""")
def gap_report(spark, sf_dir):
    from ..sources.tables import messages

    return rounded(J.gaps(messages(spark, sf_dir).withColumn("stream", F.lit("events")), "ts", 300, 900, ("stream",)))


@query(f"""WITH e AS (SELECT (epoch_us(ts) // 1000000) // 3600 * 3600 AS bar, value AS qty, (event_id % 30) / 100.0 AS dist FROM events WHERE event_type <> 'error'),
hours AS (SELECT DISTINCT (epoch_us(ts) // 1000000) // 3600 * 3600 AS bar FROM events),
h AS (SELECT bar, quantile_cont(qty, 0.5) AS wall_median, max(qty) AS wall_max, quantile_cont(dist, 0.5) AS wall_dist, count(qty) AS wall_count, sum(qty) AS wall_sum FROM e GROUP BY bar),
wide AS (SELECT 'events' AS stream, bar // 86400 * 86400 AS out, wall_median, wall_max, wall_dist, coalesce(wall_count, 0) AS wall_count, coalesce(wall_sum, 0) AS wall_sum FROM hours LEFT JOIN h USING (bar)),
{weighted('wall_median', 'wall_count', 'wide', 'med')}, {weighted('wall_dist', 'wall_count', 'wide', 'far')},
b AS (SELECT stream, out, CAST(sum(wall_count) AS BIGINT) AS wall_count, sum(wall_sum) AS wall_sum, max(wall_max) AS wall_max FROM wide GROUP BY stream, out)
SELECT stream, out, wall_count, round(wall_sum, 6) AS wall_sum, round(coalesce(wall_max, 0), 6) AS wall_max, round(coalesce(med, 0), 6) AS wall_median, round(coalesce(far, -1), 6) AS wall_dist FROM b LEFT JOIN med_m USING (stream, out) LEFT JOIN far_m USING (stream, out)""")
def agg_wall_merge(spark, sf_dir):
    """Hourly walls to days; an error message stands for a sample without a wall."""
    from ..sources.tables import messages

    dist = F.when(F.col("kind") == "error", -1.0).otherwise((F.col("seq") % 30) / 100.0)
    rows = messages(spark, sf_dir).withColumn("dist", dist).withColumn("stream", F.lit("events"))
    return rounded(M.walls(B.wall_stats(rows, 3600, "value", "dist", ("stream",)), DAY))
