"""The feature catalogue by groups, over quarter-hour bars of the events table.

A bar's columns are sums over parts of its events, a rule for each name, so every family of columns is there, with nulls
where a bar has no such event and -1 where a sample is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bucket
from ..operators import catalogue as C
from ..sources.tables import table
from .shared import rounded

QUERIES, ORACLE = {}, {}
WIDTH = 900
EXTRA = ("spot_bid_close", "spot_ask_close", "opt_eth_mid_open", "opt_eth_mid_close", "opt_open_interest_sample", "opt_funding_rate_sample")
NAMES = sorted({n for sql in [*C.point_features("future", "spot", "0.05", "0.4").values(), *(x for _, x, _ in C.rolled_features("future").values())] for n in C.needs(sql)} | set(EXTRA))


#: A price by the same steps on the same numbers in both engines.
MEAN = "(100 + floor(round(sum(value), 2) * 100 / count(*)) / 5000)"


def column(k: int, name: str) -> str:
    """SQL of a column, alike in both engines: whole cents, so that the order of a sum doesn't show."""
    a, c = 2 + k % 4, 3 + k % 7
    total = f"round(sum(CASE WHEN event_id % {a} <> {k % a} THEN value * (1 + event_id % {c}) END), 2)"
    if "wall_dist" in name or name == "opt_funding_rate_sample":
        return f"CASE WHEN count(*) % 3 = 0 THEN CAST(-1 AS DOUBLE) ELSE {total} END"
    if name.startswith("spot_") and name.endswith("close"):
        return f"{MEAN} + 0.01" if "bid" in name else "max(value) / 50 + 100"
    return total


COLUMNS = {n: column(k, n) for k, n in enumerate(NAMES)}


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.col("event_type").alias("stream"), bucket(at, WIDTH).alias("ts"))
    return rows.groupBy("stream", "ts").agg(F.expr(MEAN).alias("close_price"), *[F.expr(sql).alias(n) for n, sql in COLUMNS.items()])


def features(spark: SparkSession, sf_dir: str, *names: str, digits: int = 5) -> DataFrame:
    return rounded(C.features(bars(spark, sf_dir), WIDTH).select("stream", "ts", *names), digits)


BARS = "b AS (SELECT event_type AS stream, epoch_us(ts) // 1000000 // 900 * 900 AS ts, " + MEAN + " AS close_price, " + ", ".join(f'{sql} AS "{n}"' for n, sql in COLUMNS.items()) + " FROM events GROUP BY ALL)"
W = "w AS (PARTITION BY stream ORDER BY ts)"
EPS = "1e-9"


def span(seconds: int) -> str:
    return f"w{seconds} AS (PARTITION BY stream ORDER BY ts RANGE BETWEEN {seconds - 1} PRECEDING AND CURRENT ROW)"


def rows(n: int) -> str:
    return f"r{n} AS (PARTITION BY stream ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SPANS = ", ".join([W, span(3600), span(14400), span(86400)])


def over(x: str, window: str, least: int, f: str = "avg") -> str:
    return f"CASE WHEN count({x}) OVER {window} >= {least} THEN {f}({x}) OVER {window} END"


def clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({low}, least({high}, {x})) END"


def z(x: str, seconds: int = 14400, least: int = 4) -> str:
    return clip(f"(({x}) - ({over(x, f'w{seconds}', least)})) / (({over(x, f'w{seconds}', least, 'stddev_samp')}) + {EPS})", -8, 8)


def part(x: str) -> str:
    """Ratio to the mean of four hours."""
    return clip(f"({x}) / (({over(x, 'w14400', 4)}) + {EPS})", 0, 10)


def imbal(a: str, b: str, eps: str = EPS) -> str:
    return f"({a} - {b}) / ({a} + {b} + {eps})"


def simple(name: str, doc: str, wanted: dict[str, str], before: str = "", source: str = "b", windows: str = SPANS, digits: int = 5) -> None:
    """Registers a group whose columns are SQL over the bars."""
    picked = ", ".join(f"round({sql}, {digits}) AS {n}" for n, sql in wanted.items())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features(spark, sf_dir, *wanted, digits=digits)

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    ORACLE[name] = f"WITH {BARS}{before} SELECT stream, ts, {picked} FROM {source} WINDOW {windows}"


liq = lambda side, step: f'"future_{side}_liq_{step}_median"'
flow = imbal("future_buy_qty", "future_sell_qty")
simple("feat_micro", "Spread of the averages, liquidation flag, stochastic, spread, samples.", {
    "vwap_spread": "future_buy_vwap - future_sell_vwap",
    "liq_flag": "CASE WHEN opt_long_force_exit_qty_sum + opt_short_force_exit_qty_sum > 0 THEN 1.0 ELSE 0.0 END",
    "stochastic": "CASE WHEN future_bid_max - future_bid_min > 0 THEN (future_bid_close - future_bid_min) / (future_bid_max - future_bid_min) ELSE 0.5 END",
    "spread_expansion": "future_spread_max - future_spread_open",
    "sample_imbalance": imbal("future_buy_samples", "future_sell_samples"),
})
simple("feat_flow_book", "Imbalances of flow and book, and their means over rows.", {
    "flow_imbalance": flow,
    "book_imbalance": imbal(liq("bid", "0.0"), liq("ask", "0.0")),
    "momentum": "future_price_diff",
    "book_imbal_deep": imbal(liq("bid", "0.05"), liq("ask", "0.05")),
    "flow_imbal_roll4": over(flow, "r4", 2),
    "flow_imbal_roll8": over(flow, "r8", 4),
    "book_imbal_roll4": over(imbal(liq("bid", "0.0"), liq("ask", "0.0")), "r4", 2),
    "book_imbal_roll8": over(imbal(liq("bid", "0.0"), liq("ask", "0.0")), "r8", 4),
}, windows=f"{rows(4)}, {rows(8)}")
simple("feat_cross_market", "Flow of one market times that of the other.", {"flow_agreement": f"{flow} * ({imbal('spot_buy_qty', 'spot_sell_qty')})"})
simple("feat_interest_size", "Change of open interest, mean trade sizes.", {
    "oi_change": "opt_open_interest_sample - lag(opt_open_interest_sample) OVER w",
    "size_imbalance": f"future_buy_qty / (future_buy_samples + {EPS}) - future_sell_qty / (future_sell_samples + {EPS})",
})
simple("feat_sub_bar", "Trades in a bar's halves, its first, last and largest trade.", {
    "trade_side_open": "future_first_trade_side",
    "trade_side_close": "future_last_trade_side",
    "trade_side_momentum": "future_last_trade_side - future_first_trade_side",
    "largest_trade_side": "future_largest_trade_side",
    "largest_trade_rel": f"future_largest_trade_qty / (future_buy_qty_early + future_buy_qty_late + future_sell_qty_early + future_sell_qty_late + {EPS})",
    "buy_accel": "future_buy_qty_late - future_buy_qty_early",
    "sell_accel": "future_sell_qty_late - future_sell_qty_early",
    "flow_accel": "(future_buy_qty_late - future_sell_qty_late) - (future_buy_qty_early - future_sell_qty_early)",
    "buy_count_accel": "future_buy_count_late - future_buy_count_early",
    "late_imbalance": imbal("future_buy_qty_late", "future_sell_qty_late"),
})
simple("feat_book_shape", "Touch against the deepest liquidity at hand.", {f"liq_conc_{s}": f"{liq(s, '0.0')} / ({liq(s, '0.4')} + {EPS})" for s in ("bid", "ask")})
net = lambda s, band="near": f"(future_add_{s}_{band}_sum - future_cancel_{s}_{band}_sum)"
ring = lambda kind, s: f"CASE WHEN future_{kind}_{s}_wide_sum - future_{kind}_{s}_near_sum > 0 THEN future_{kind}_{s}_wide_sum - future_{kind}_{s}_near_sum WHEN future_{kind}_{s}_wide_sum - future_{kind}_{s}_near_sum <= 0 THEN 0 END"
simple("feat_order_flow", "Order-flow imbalance, additions and cancellations near the mid and in the ring beyond.", {
    "ofi_z": z("future_ofi_sum"),
    "flow_net_near_z": z("near"),
    "cancel_imbal_near": imbal("future_cancel_bid_near_sum", "future_cancel_ask_near_sum"),
    "pull_add_bid": clip("ln(1 + future_cancel_bid_near_sum) - ln(1 + future_add_bid_near_sum)", -8, 8),
    "pull_add_ask": clip("ln(1 + future_cancel_ask_near_sum) - ln(1 + future_add_ask_near_sum)", -8, 8),
    "flow_net_widex_z": z("beyond"),
}, f", n AS (SELECT *, {net('bid')} - {net('ask')} AS near, (({ring('add', 'bid')}) - ({ring('cancel', 'bid')})) - (({ring('add', 'ask')}) - ({ring('cancel', 'ask')})) AS beyond FROM b)", "n")
gone = "(future_bid_depletion_count + future_ask_depletion_count)"
simple("feat_activity", "Micro deviation, realised volatility, flips, messages and depletions against their usual level.", {
    "micro_dev_z": z("future_micro_dev_close"),
    "mid_rv_norm": part("future_mid_rv"),
    "mid_flips_norm": part("future_mid_flips"),
    "msg_rate_norm": part("future_depth_msg_count"),
    "depl_imbal": imbal("future_bid_depletion_count", "future_ask_depletion_count", "1.0"),
    "depl_total_norm": part(gone),
})
simple("feat_tails", "Large trades against the median trade.", {f"{s}_tail_ratio": f"ln(1 + ({clip(f'future_{s}_size_p90 / (future_{s}_size_median + {EPS})', 0, 100)}))" for s in ("buy", "sell")})
zero = lambda c: f"(CASE WHEN future_ofi_sum IS NOT NULL THEN coalesce({c}, 0) ELSE {c} END)"
simple("feat_liquidation", "Liquidations; none is zero in bars of the era that counts them.", {
    "liq_cnt_log": f"ln(1 + {zero('opt_long_force_exit_cnt_sum')} + {zero('opt_short_force_exit_cnt_sum')})",
    "liq_imbal": imbal("coalesce(opt_long_force_exit_qty_sum, 0)", "coalesce(opt_short_force_exit_qty_sum, 0)"),
    "liq_notional_log": f"ln(1 + {zero('opt_long_force_exit_notional_sum')} + {zero('opt_short_force_exit_notional_sum')})",
    "liq_notional_max_log": f"ln(1 + {zero('opt_force_exit_notional_max')})",
})
simple("feat_walls", "Walls; one that isn't there stands at the band's edge.", {
    "wall_imbal": imbal("future_bid_wall_qty_median", "future_ask_wall_qty_median"),
    "bid_wall_dist": "CASE WHEN future_bid_wall_dist_median >= 0 THEN future_bid_wall_dist_median ELSE 0.3 END",
    "ask_wall_dist": "CASE WHEN future_ask_wall_dist_median >= 0 THEN future_ask_wall_dist_median ELSE 0.3 END",
    "wall_qty_norm": part("(future_bid_wall_qty_median + future_ask_wall_qty_median)"),
})
simple("feat_bursts", "One burst's or one side's run's share of the volume.", {f"{k}_{s}_rel": clip(f"{c.format(s)} / (future_{s}_qty + {EPS})", 0, 1) for k, c in (("batch", "future_max_batch_{}_qty"), ("sweep", "future_max_{}_run_qty")) for s in ("buy", "sell")})
simple("feat_funding", "The quarter hour before funding, and the rate in it.", {
    "near_funding": "CASE WHEN 28800 - ts % 28800 < 900 THEN 1.0 ELSE 0.0 END",
    "funding_pressure": "CASE WHEN opt_funding_rate_sample IS NULL OR opt_funding_rate_sample = -1 THEN 0.0 ELSE opt_funding_rate_sample END * CASE WHEN 28800 - ts % 28800 < 900 THEN 1.0 ELSE 0.0 END",
})
MOVE = ", m AS (SELECT *, abs(close_price - lag(close_price) OVER w) AS move FROM b WINDOW w AS (PARTITION BY stream ORDER BY ts)), v AS (SELECT *, CASE WHEN count(move) OVER r16 >= 4 THEN avg(move) OVER r16 END AS vol FROM m WINDOW " + rows(16) + ")"
simple("feat_volatility_norm", "Mean move of sixteen bars, against its mean of a day.", {"volatility": "vol", "vol_norm": f"CASE WHEN ({over('vol', 'r96', 1)}) <> 0 THEN vol / ({over('vol', 'r96', 1)}) END"}, MOVE, "v", rows(96), 7)

STEP = f", l AS (SELECT *, ln(close_price) AS lp, (close_price - (spot_bid_close + spot_ask_close) / 2) / ((spot_bid_close + spot_ask_close) / 2 + {EPS}) AS basis, CASE WHEN opt_eth_mid_open > 0 AND opt_eth_mid_close > 0 THEN ln(opt_eth_mid_close / opt_eth_mid_open) END AS eth FROM b), s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w = 900 THEN lp - lag(lp) OVER w END AS r1 FROM l WINDOW {W})"


def past(name: str, value: str, seconds: int) -> str:
    """CTE of a value nearest to so many seconds ago, 1800 off at most, of equals the later one."""
    return f"""{name} AS (SELECT x.stream, x.ts, CASE WHEN a.ts - (x.ts - {seconds}) <= 1800 AND (p.ts IS NULL OR a.ts - (x.ts - {seconds}) <= (x.ts - {seconds}) - p.ts) THEN a.{value} WHEN (x.ts - {seconds}) - p.ts <= 1800 THEN p.{value} END AS was
  FROM s x ASOF LEFT JOIN s p ON x.stream = p.stream AND x.ts - {seconds} >= p.ts ASOF LEFT JOIN s a ON x.stream = a.stream AND x.ts - {seconds} <= a.ts)"""


LOOKS = STEP + ", " + ", ".join([past("p1", "lp", 3600), past("p4", "lp", 14400), past("p24", "lp", 86400), past("pb", "basis", 3600)])
JOINED = f""", j0 AS (SELECT s.*, p1.was AS was1, p4.was AS was4, p24.was AS was24, s.basis - pb.was AS mom FROM s JOIN p1 USING (stream, ts) JOIN p4 USING (stream, ts) JOIN p24 USING (stream, ts) JOIN pb USING (stream, ts)),
j AS (SELECT *, {over('r1', 'w86400', 24, 'stddev_samp')} AS sigma, {over('r1', 'w3600', 2, 'stddev_samp')} AS vol1, {over('lp', 'w86400', 24, 'max')} AS hi, {over('lp', 'w86400', 24, 'min')} AS lo, {over('lp', 'w3600', 3)} AS ma1, {over('lp', 'w14400', 12)} AS ma4, {over('lp', 'w86400', 72)} AS ma24 FROM j0 WINDOW {SPANS})"""
unit = lambda n: f"(sigma * sqrt({n}) + {EPS})"
simple("feat_context", "Returns, gaps to means, volatility, range and basis of the last hours.", {
    **{f"ret_norm_{h}h": clip(f"(lp - was{h}) / {unit(4 * h)}", -8, 8) for h in (1, 4, 24)},
    **{f"ma_gap_{h}h": clip(f"(lp - ma{h}) / {unit(4 * h)}", -8, 8) for h in (1, 4, 24)},
    "vol_ratio_1h_24h": clip(f"vol1 / (sigma + {EPS})", 0, 5),
    "range_pos_24h": clip(f"(lp - lo) / (hi - lo + {EPS})", 0, 1),
    "basis_z_4h": z("basis", 14400, 8),
    "basis_mom_1h": clip(f"mom / (({over('mom', 'w14400', 8, 'stddev_samp')}) + {EPS})", -8, 8),
}, LOOKS + JOINED, "j")
late = "future_ofi_sum IS NOT NULL AND ts > since + 86400"
filled = lambda x: f"CASE WHEN ({x}) IS NULL AND {late} THEN 0.0 ELSE {x} END"
scaled = lambda x: f"({x} / (({over(x, 'w14400', 4, 'stddev_samp')}) + {EPS}))"
simple("feat_eth_ratio", "Another coin's return, what it leads by, the long-short ratio; neutral at 0 a day into the era.", {
    "eth_ret_z": filled(clip(scaled("eth"), -8, 8)),
    "eth_lead_gap": filled(clip(f"{scaled('eth')} - {scaled('r1')}", -8, 8)),
    "lsr_z": filled(z("opt_long_short_ratio_sample", 86400, 24)),
}, STEP + ", t AS (SELECT *, min(CASE WHEN future_ofi_sum IS NOT NULL THEN ts END) OVER (PARTITION BY stream) AS since FROM s)", "t")


def pnl_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By hour of day and direction: a trade for each bar, with the flow, until the next bar."""
    from ..functions.windows import along

    w = along("stream", by="ts")
    got = C.features(bars(spark, sf_dir), WIDTH).select("ts", F.signum("flow_imbalance").cast("int").alias("side"), (F.lead("close_price").over(w) - F.col("close_price")).alias("move"))
    pnl = got.filter("side <> 0 and move is not null").withColumn("pnl", F.col("side") * F.col("move"))
    hour = F.hour(F.timestamp_seconds("ts")).alias("hour")
    return pnl.groupBy(hour, "side").agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("pnl"), F.round(F.avg((F.col("pnl") > 0).cast("int")), 6).alias("win_rate"))


QUERIES["pnl_by_hour"] = pnl_by_hour
ORACLE["pnl_by_hour"] = f"""WITH {BARS}, t AS (SELECT ts, CAST(sign({flow}) AS INT) AS side, lead(close_price) OVER w - close_price AS move FROM b WINDOW {W}), p AS (SELECT *, side * move AS pnl FROM t WHERE side <> 0 AND move IS NOT NULL)
SELECT CAST(ts // 3600 % 24 AS INT) AS hour, side, count(*) AS n, round(sum(pnl), 4) AS pnl, round(avg(CAST(pnl > 0 AS INT)), 6) AS win_rate FROM p GROUP BY ALL"""
