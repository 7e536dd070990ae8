"""The feature catalogue: every derived column of a bar table, declared once.

A feature is an expression over bar columns, alone or inside a rolling frame. A feature whose columns
the table lacks comes out null, so files of older eras pass through the same plan. All frames share two
window specifications (by row, by seconds), so one sort by (keys, ts) serves them; the values "some
time ago" are as-of looks and add their own.

Bars bear the lead market's columns under ``lead`` and the other's under ``other``.
"""

from __future__ import annotations

import re
from math import sqrt

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import EPS, clip, filled_in_era, time_features
from ..functions.windows import along, rolling, rolling_time
from .joins import nearest

HOUR = 3600
DAY = 24 * HOUR
#: Percent from the mid where a wall that isn't there stands.
WALL_BAND = 0.3
#: Sums and the maximum of liquidations: none is zero, in bars of the era that counts them.
LIQUIDATIONS = ("opt_long_force_exit_cnt_sum", "opt_short_force_exit_cnt_sum", "opt_long_force_exit_notional_sum", "opt_short_force_exit_notional_sum", "opt_force_exit_notional_max")
#: Neutral at 0: filled inside the era, a day after it began.
NEUTRAL = ("eth_ret_z", "eth_lead_gap", "lsr_z")
NAME = re.compile(r"`([^`]+)`|\b((?:spot|future|opt)_\w+)\b")


def difference(a: str, b: str) -> str:
    return f"({a} - {b}) / ({a} + {b} + {EPS!r})"


def point_features(lead: str, other: str, deep: str | None, deepest: str | None) -> dict[str, str]:
    """SQL of the features that need one bar only; deep and deepest name liquidity steps."""
    q = lambda side, half="": f"{lead}_{side}_qty{half}"
    n = lambda side, half="": f"{lead}_{side}_count{half}"
    at = lambda side, step: f"`{lead}_{side}_liq_{step}_median`"
    flow = lambda kind, side, band: f"{lead}_{kind}_{side}_{band}_sum"
    all_halves = " + ".join(q(s, f"_{h}") for s in ("buy", "sell") for h in ("early", "late"))
    out = {
        "flow_imbalance": difference(q("buy"), q("sell")),
        "book_imbalance": difference(at("bid", "0.0"), at("ask", "0.0")),
        "momentum": f"{lead}_price_diff",
        "vwap_spread": f"{lead}_buy_vwap - {lead}_sell_vwap",
        "liq_flag": "if(coalesce(opt_long_force_exit_qty_sum + opt_short_force_exit_qty_sum, 0) > 0, 1D, 0D)",
        "stochastic": f"if({lead}_bid_max > {lead}_bid_min, try_divide({lead}_bid_close - {lead}_bid_min, {lead}_bid_max - {lead}_bid_min), 0.5D)",
        "spread_expansion": f"{lead}_spread_max - {lead}_spread_open",
        "sample_imbalance": difference(f"{lead}_buy_samples", f"{lead}_sell_samples"),
        "flow_agreement": f"{difference(q('buy'), q('sell'))} * ({difference(f'{other}_buy_qty', f'{other}_sell_qty')})",
        "size_imbalance": f"{q('buy')} / ({lead}_buy_samples + {EPS!r}) - {q('sell')} / ({lead}_sell_samples + {EPS!r})",
        "trade_side_open": f"{lead}_first_trade_side",
        "trade_side_close": f"{lead}_last_trade_side",
        "trade_side_momentum": f"{lead}_last_trade_side - {lead}_first_trade_side",
        "largest_trade_side": f"{lead}_largest_trade_side",
        "largest_trade_rel": f"{lead}_largest_trade_qty / ({all_halves} + {EPS!r})",
        "buy_accel": f"{q('buy', '_late')} - {q('buy', '_early')}",
        "sell_accel": f"{q('sell', '_late')} - {q('sell', '_early')}",
        "flow_accel": f"({q('buy', '_late')} - {q('sell', '_late')}) - ({q('buy', '_early')} - {q('sell', '_early')})",
        "buy_count_accel": f"{n('buy', '_late')} - {n('buy', '_early')}",
        "late_imbalance": difference(q("buy", "_late"), q("sell", "_late")),
        "cancel_imbal_near": difference(flow("cancel", "bid", "near"), flow("cancel", "ask", "near")),
        "pull_add_bid": _clipped(f"ln(1 + {flow('cancel', 'bid', 'near')}) - ln(1 + {flow('add', 'bid', 'near')})", -8, 8),
        "pull_add_ask": _clipped(f"ln(1 + {flow('cancel', 'ask', 'near')}) - ln(1 + {flow('add', 'ask', 'near')})", -8, 8),
        "depl_imbal": f"({lead}_bid_depletion_count - {lead}_ask_depletion_count) / ({lead}_bid_depletion_count + {lead}_ask_depletion_count + 1.0D)",
        "liq_cnt_log": "ln(1 + opt_long_force_exit_cnt_sum + opt_short_force_exit_cnt_sum)",
        "liq_imbal": difference("coalesce(opt_long_force_exit_qty_sum, 0D)", "coalesce(opt_short_force_exit_qty_sum, 0D)"),
        "liq_notional_log": "ln(1 + opt_long_force_exit_notional_sum + opt_short_force_exit_notional_sum)",
        "liq_notional_max_log": "ln(1 + opt_force_exit_notional_max)",
        "wall_imbal": difference(f"{lead}_bid_wall_qty_median", f"{lead}_ask_wall_qty_median"),
    }
    for side in ("bid", "ask"):
        out[f"{side}_wall_dist"] = f"if({lead}_{side}_wall_dist_median >= 0, {lead}_{side}_wall_dist_median, {WALL_BAND!r}D)"
        if deepest:
            out[f"liq_conc_{side}"] = f"{at(side, '0.0')} / ({at(side, deepest)} + {EPS!r})"
    if deep:
        out["book_imbal_deep"] = difference(at("bid", deep), at("ask", deep))
    for side in ("buy", "sell"):
        share = f"{q(side)} + {EPS!r}"
        out[f"{side}_tail_ratio"] = f"ln(1 + {_clipped(f'{lead}_{side}_size_p90 / ({lead}_{side}_size_median + {EPS!r})', 0, 100)})"
        out[f"batch_{side}_rel"] = _clipped(f"{lead}_max_batch_{side}_qty / ({share})", 0, 1)
        out[f"sweep_{side}_rel"] = _clipped(f"{lead}_max_{side}_run_qty / ({share})", 0, 1)
    return out


def rolled_features(lead: str) -> dict[str, tuple[str, str, int]]:
    """name: (z or ratio, SQL of the series, seconds of the frame)."""
    net = lambda side, band: f"{lead}_add_{side}_{band}_sum - {lead}_cancel_{side}_{band}_sum"
    past_near = lambda kind, side: _clipped(f"({lead}_{kind}_{side}_wide_sum - {lead}_{kind}_{side}_near_sum)", 0, 1e300)
    beyond = lambda side: f"({past_near('add', side)} - {past_near('cancel', side)})"
    return {
        "ofi_z": ("z", f"{lead}_ofi_sum", 4 * HOUR),
        "flow_net_near_z": ("z", f"({net('bid', 'near')}) - ({net('ask', 'near')})", 4 * HOUR),
        "flow_net_widex_z": ("z", f"{beyond('bid')} - {beyond('ask')}", 4 * HOUR),
        "micro_dev_z": ("z", f"{lead}_micro_dev_close", 4 * HOUR),
        "mid_rv_norm": ("ratio", f"{lead}_mid_rv", 4 * HOUR),
        "mid_flips_norm": ("ratio", f"{lead}_mid_flips", 4 * HOUR),
        "msg_rate_norm": ("ratio", f"{lead}_depth_msg_count", 4 * HOUR),
        "depl_total_norm": ("ratio", f"{lead}_bid_depletion_count + {lead}_ask_depletion_count", 4 * HOUR),
        "wall_qty_norm": ("ratio", f"{lead}_bid_wall_qty_median + {lead}_ask_wall_qty_median", 4 * HOUR),
        "lsr_z": ("z", "opt_long_short_ratio_sample", DAY),
    }


def _clipped(x: str, low: float, high: float) -> str:
    """SQL bounds that leave null alone."""
    return f"if({x} is null, null, greatest({float(low)}D, least({float(high)}D, {x})))"


def needs(sql: str) -> set[str]:
    return {a or b for a, b in NAME.findall(sql)}


def z(x: str, mean: Column, std: Column, most: float = 8.0) -> Column:
    return clip((F.col(x) - mean) / (std + F.lit(EPS)), -most, most)


def features(bars: DataFrame, width: int, keys: tuple[str, ...] = ("stream",), ts: str = "ts", close: str = "close_price", lead: str = "future", other: str = "spot", optional: tuple[str, ...] = ()) -> DataFrame:
    """keys, ts, close and every feature; bars: one row per key and time, ``width`` seconds each.

    optional names columns that may be missing without turning a feature null (read as null).
    """
    have = set(bars.columns)
    filled = bars
    for c, value in (("opt_long_force_exit_qty_sum", 0.0), ("opt_short_force_exit_qty_sum", 0.0), *((c, None) for c in optional)):
        if c not in have:
            filled, have = filled.withColumn(c, F.lit(value).cast("double")), have | {c}
    era = f"{lead}_ofi_sum"
    if era in have:
        filled = filled.withColumns({c: filled_in_era(c, era) for c in LIQUIDATIONS if c in have})
    step = lambda options: next((s for s in options if f"{lead}_bid_liq_{s}_median" in have), None)
    points = point_features(lead, other, step(("0.05", "0.04", "0.06")), step(("0.4", "0.3", "0.2", "0.1")))
    rolled = rolled_features(lead)
    null = F.lit(None).cast("double")
    put = lambda sql: F.expr(sql).cast("double") if needs(sql) <= have else null
    stock = f"{other}_bid_close", f"{other}_ask_close"
    eth = "opt_eth_mid_open", "opt_eth_mid_close"
    rows = filled.select(
        *keys,
        ts,
        close,
        F.log(close).alias("_lp"),
        *[put(sql).alias(name) for name, sql in points.items()],
        *[put(sql).alias(f"_{name}") for name, (_, sql, _) in rolled.items()],
        (put("opt_open_interest_sample")).alias("_oi"),
        put("coalesce(nullif(opt_funding_rate_sample, -1), 0D)").alias("_funding"),
        (F.col(era) if era in have else null).isNotNull().alias("_era"),
        ((F.col(close) - put(f"({stock[0]} + {stock[1]}) / 2")) / (put(f"({stock[0]} + {stock[1]}) / 2") + F.lit(EPS))).alias("_basis"),
        put(f"if({eth[0]} > 0 and {eth[1]} > 0, ln(try_divide({eth[1]}, {eth[0]})), null)").alias("_eth"),
        *[c.alias(n) for n, c in time_features(ts).items()],
    )
    w = along(*keys, by=ts)
    day, minute = DAY // width, max(1, 60 // width)
    prior = F.lag("_lp").over(w)
    rows = rows.withColumn("_r1", F.when(F.col(ts) - F.lag(ts).over(w) == width, F.col("_lp") - prior))
    rows = rows.withColumn("_move", F.abs(F.col(close) - F.lag(close).over(w)))
    for name, hours in (("1h", 1), ("4h", 4), ("24h", 24)):
        rows = nearest(rows, "_lp", list(keys), hours * HOUR, 2 * width, f"_lp_{name}", ts).drop(f"_lp_{name}_ts")
    rows = nearest(rows, "_basis", list(keys), HOUR, 2 * width, "_basis_1h", ts).drop("_basis_1h_ts")
    over = lambda c, sec, least, f=F.avg: rolling_time(c, sec, least, w, f)
    rows = rows.select(
        "*",
        over("_r1", DAY, day // 4, F.stddev_samp).alias("_sigma"),
        over("_r1", HOUR, day // 48, F.stddev_samp).alias("_vol1h"),
        over("_lp", DAY, day // 4, F.max).alias("_hi"),
        over("_lp", DAY, day // 4, F.min).alias("_lo"),
        *[over("_lp", h * HOUR, int(h * day / 24 * 0.75)).alias(f"_ma_{n}") for n, h in (("1h", 1), ("4h", 4), ("24h", 24))],
        over("_basis", 4 * HOUR, day // 12).alias("_b_ma"),
        over("_basis", 4 * HOUR, day // 12, F.stddev_samp).alias("_b_sd"),
        (F.col("_basis") - F.col("_basis_1h")).alias("_b_mom"),
        over("_eth", 4 * HOUR, day // 24, F.stddev_samp).alias("_eth_sd"),
        rolling("_eth", minute, minute, w, F.sum).alias("_eth12"),
        rolling("_r1", minute, minute, w, F.sum).alias("_r12"),
        rolling("_move", 16, 4, w).alias("volatility"),
        F.min(F.when(F.col("_era"), F.col(ts))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_since"),
        *_by_rows(w),
    )
    rows = rows.select("*", over("_b_mom", 4 * HOUR, day // 12, F.stddev_samp).alias("_b_mom_sd"), over("_eth12", 4 * HOUR, day // 24, F.stddev_samp).alias("_eth12_sd"), over("_r12", 4 * HOUR, day // 24, F.stddev_samp).alias("_r12_sd"), rolling("volatility", day, max(1, day // 60), w).alias("_vol_day"))
    unit = lambda h: F.col("_sigma") * F.lit(sqrt(h * day / 24)) + F.lit(EPS)
    last = {
        **{f"ret_norm_{n}": clip((F.col("_lp") - F.col(f"_lp_{n}")) / unit(h), -8.0, 8.0) for n, h in (("1h", 1), ("4h", 4), ("24h", 24))},
        **{f"ma_gap_{n}": clip((F.col("_lp") - F.col(f"_ma_{n}")) / unit(h), -8.0, 8.0) for n, h in (("1h", 1), ("4h", 4), ("24h", 24))},
        "vol_ratio_1h_24h": clip(F.col("_vol1h") / (F.col("_sigma") + F.lit(EPS)), 0.0, 5.0),
        "range_pos_24h": clip((F.col("_lp") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(EPS)), 0.0, 1.0),
        "basis_z_4h": z("_basis", F.col("_b_ma"), F.col("_b_sd")),
        "basis_mom_1h": clip(F.col("_b_mom") / (F.col("_b_mom_sd") + F.lit(EPS)), -8.0, 8.0),
        "eth_ret_z": clip(F.col("_eth") / (F.col("_eth_sd") + F.lit(EPS)), -8.0, 8.0),
        "eth_lead_gap": clip(F.col("_eth12") / (F.col("_eth12_sd") + F.lit(EPS)) - F.col("_r12") / (F.col("_r12_sd") + F.lit(EPS)), -8.0, 8.0),
        "oi_change": F.col("_oi") - F.lag("_oi").over(w),
        "vol_norm": F.when(F.col("_vol_day") != 0, F.col("volatility") / F.col("_vol_day")),
        "near_funding": (F.pmod(F.col(ts), F.lit(8 * HOUR)) > 8 * HOUR - 900).cast("double"),
        "funding_pressure": F.col("_funding") * (F.pmod(F.col(ts), F.lit(8 * HOUR)) > 8 * HOUR - 900).cast("double"),
    }
    for name, (how, _, sec) in rolled.items():
        least = day // 4 if sec == DAY else day // 24
        mean = over(f"_{name}", sec, least)
        last[name] = z(f"_{name}", mean, over(f"_{name}", sec, least, F.stddev_samp)) if how == "z" else clip(F.col(f"_{name}") / (mean + F.lit(EPS)), 0.0, 10.0)
    late = F.col("_era") & (F.col(ts) > F.col("_since") + DAY)
    for name in NEUTRAL:
        last[name] = F.coalesce(last[name], F.when(late, F.lit(0.0)))
    done = rows.select("*", *[c.alias(n) for n, c in last.items()])
    return done.select(*[c for c in done.columns if not c.startswith("_")])


def _by_rows(w: WindowSpec) -> list[Column]:
    return [rolling(f, n, n // 2, w).alias(f"{short}_roll{n}") for f, short in (("flow_imbalance", "flow_imbal"), ("book_imbalance", "book_imbal")) for n in (4, 8)]
