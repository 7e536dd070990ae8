"""Trading rules on bars: exits, resting orders, positions, equity, triggers.

Rules that look a fixed number of bars ahead are unrolled leads over one sort. Rules whose next step
depends on the last (non-overlapping trades, the overlay machine, exponential means) run per key in
time order on Arrow batches.
"""

from __future__ import annotations



import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import hashed
from ..functions.windows import first_touch, islands, last_known, running

BPS = 10_000.0


def endpoint_bps(close: str, side: Column, h: int, fee_bps: float, w: WindowSpec) -> Column:
    """Net result in basis points of entering now and leaving h bars on."""
    return side * (F.lead(close, h).over(w) / F.col(close) - 1) * BPS - fee_bps


def _ahead(close: str, k: Column, h: int, w: WindowSpec) -> Column:
    """The close k bars on, 1 <= k <= h."""
    return F.coalesce(*[F.when(k == j, F.lead(close, j).over(w)) for j in range(1, h + 1)])


def tp_sl(rows: DataFrame, close: str, side: Column, h: int, tp: float, sl: float, taker_bps: float, maker_bps: float, w: WindowSpec) -> DataFrame:
    """Leaves at the limit when a close reaches the target (maker), at the close that breaches the stop (taker), else at the end.

    Adds k_tp, k_sl, exit_k, exit_reason and net_bps; the stop wins a tie. Null where fewer than h bars follow.
    """
    gain = lambda x: side * (x / F.col(close) - 1)
    marked = rows.withColumn("k_tp", first_touch(close, h, lambda x: gain(x) >= tp, w)).withColumn("k_sl", first_touch(close, h, lambda x: gain(x) <= -sl, w))
    k = F.least("k_tp", "k_sl", F.lit(h))
    reason = F.when((F.col("k_sl") <= F.col("k_tp")) & (F.col("k_sl") <= h), "sl").when(F.col("k_tp") <= h, "tp").otherwise("time")
    marked = marked.withColumn("exit_k", k).withColumn("exit_reason", reason).withColumn("_x", _ahead(close, F.col("exit_k"), h, w)).withColumn("_end", F.lead(close, h).over(w))
    net = F.when(F.col("exit_reason") == "tp", F.lit(tp * BPS - taker_bps - maker_bps)).otherwise(gain(F.col("_x")) * BPS - 2 * taker_bps)
    return marked.withColumn("net_bps", F.when(F.col("_end").isNotNull(), net)).drop("_x", "_end")


def maker_fill(rows: DataFrame, close: str, side: Column, h: int, wait: int, delay: int, delta: float, tp: float, sl: float, maker_bps: float, taker_bps: float, w: WindowSpec) -> DataFrame:
    """A resting order ``delta`` better than the trigger's close fills on the first close through it within ``wait`` bars after ``delay``.

    The target counts strictly after the fill, the stop from the fill on; the horizon starts at the
    trigger. Adds k_fill (null if unfilled), filled, exit_k, exit_reason and net_bps.
    """
    limit = F.col("_limit")
    rows = rows.withColumn("_limit", F.col(close) * (1 - side * delta))
    last = min(delay + wait, h)
    fill = first_touch(close, last, lambda x: side * (x / limit - 1) <= 0, w, delay + 1)
    marked = rows.withColumn("k_fill", F.when(fill <= last, fill))
    gain = lambda x: side * (x / limit - 1)
    k = F.col("k_fill")
    ks = range(1, h + 1)
    tps = [F.when((F.lit(j) > k) & (gain(F.lead(close, j).over(w)) >= tp), F.lit(j)) for j in ks]
    sls = [F.when((F.lit(j) >= k) & (gain(F.lead(close, j).over(w)) <= -sl), F.lit(j)) for j in ks]
    marked = marked.withColumn("_tp", F.coalesce(F.least(*tps), F.lit(h + 1))).withColumn("_sl", F.coalesce(F.least(*sls), F.lit(h + 1)))
    reason = F.when(k.isNull(), "unfilled").when((F.col("_sl") <= F.col("_tp")) & (F.col("_sl") <= h), "sl").when(F.col("_tp") <= h, "tp").otherwise("time")
    marked = marked.withColumn("exit_reason", reason).withColumn("exit_k", F.when(k.isNotNull(), F.least("_tp", "_sl", F.lit(h))))
    marked = marked.withColumn("_x", _ahead(close, F.col("exit_k"), h, w)).withColumn("_end", F.lead(close, h).over(w))
    net = F.when(F.col("exit_reason") == "tp", F.lit(tp * BPS - 2 * maker_bps)).otherwise(gain(F.col("_x")) * BPS - maker_bps - taker_bps)
    done = F.col("_end").isNotNull()
    return marked.withColumn("filled", F.when(done, k.isNotNull())).withColumn("net_bps", F.when(done & k.isNotNull(), net)).drop("_tp", "_sl", "_x", "_end", "_limit")


def hysteresis(rows: DataFrame, score: str, enter: float, leave: float, next_ok: Column, w: WindowSpec) -> DataFrame:
    """Position of +1 above ``enter``, -1 below its negative, 0 inside ``leave``, else held; flat where the next bar isn't contiguous."""
    s = F.col(score)
    raw = F.when(s >= enter, 1).when(s <= -enter, -1).when(F.abs(s) <= leave, 0)
    held = rows.withColumn("_raw", raw).withColumn("_held", F.coalesce(last_known("_raw", w), F.lit(0)))
    flat = held.withColumn("position", F.when(next_ok, F.col("_held")).otherwise(0)).drop("_raw", "_held")
    return flat.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0))))


def episodes(rows: DataFrame, position: str, pnl: str, keys: tuple[str, ...], ts: str) -> DataFrame:
    """One row per stretch of one non-zero position: side, bars, pnl."""
    w = Window.partitionBy(*keys).orderBy(ts)
    changed = F.col(position) != F.coalesce(F.lag(position).over(w), F.lit(0))
    numbered = rows.withColumn("_run", islands(changed, w)).filter(F.col(position) != 0)
    return numbered.groupBy(*keys, "_run").agg(F.min(ts).alias("start"), F.first(position).alias("side"), F.count("*").alias("bars"), F.sum(pnl).alias("pnl")).drop("_run")


def equity(rows: DataFrame, pnl: str, w: WindowSpec) -> DataFrame:
    """Running total, its peak (0 at least) and the drawdown below it."""
    out = rows.withColumn("equity", running(pnl, w))
    return out.withColumn("peak", F.greatest(F.lit(0.0), running("equity", w, F.max))).withColumn("drawdown", F.col("equity") - F.col("peak"))


def trade_stats(rows: DataFrame, pnl: str, keys: list[str]) -> DataFrame:
    """Trades, win rate, mean win and loss, profit factor, Sharpe by trade, break-even win rate."""
    win, lose = F.col(pnl) > 0, F.col(pnl) < 0
    got = rows.filter(F.col(pnl).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(pnl).alias("total"),
        F.avg(win.cast("int")).alias("win_rate"),
        F.avg(F.when(win, F.col(pnl))).alias("avg_win"),
        F.avg(F.when(lose, F.col(pnl))).alias("avg_loss"),
        F.sum(F.when(win, F.col(pnl)).otherwise(0.0)).alias("_gain"),
        F.sum(F.when(lose, -F.col(pnl)).otherwise(0.0)).alias("_loss"),
        F.avg(pnl).alias("_mean"),
        F.stddev_pop(pnl).alias("_std"),
    )
    return (
        got.withColumn("profit_factor", F.when(F.col("_loss") > 0, F.col("_gain") / F.col("_loss")))
        .withColumn("sharpe", F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std")))
        .withColumn("breakeven", -F.col("avg_loss") / (F.col("avg_win") - F.col("avg_loss")))
        .drop("_gain", "_loss", "_mean", "_std")
    )


def streaks(rows: DataFrame, pnl: str, keys: tuple[str, ...], ts: str) -> DataFrame:
    """Longest runs of wins and of losses; a zero result ends either."""
    w = Window.partitionBy(*keys).orderBy(ts)
    kind = F.signum(pnl).cast("int")
    marked = rows.filter(F.col(pnl).isNotNull()).withColumn("_k", kind)
    runs = marked.withColumn("_run", islands(F.col("_k") != F.coalesce(F.lag("_k").over(w), F.lit(9)), w)).groupBy(*keys, "_run").agg(F.first("_k").alias("_k"), F.count("*").alias("_n"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_k") == 1, F.col("_n"))), F.lit(0)).alias("longest_win"), F.coalesce(F.max(F.when(F.col("_k") == -1, F.col("_n"))), F.lit(0)).alias("longest_loss"))


def sweep(rows: DataFrame, confidence: str, pnl: str, price: str, thresholds: list[float], maker_bps: float, taker_bps: float) -> DataFrame:
    """Results above each confidence threshold, gross and with either fee: one pass over rows times thresholds."""
    each = rows.filter(F.col(pnl).isNotNull()).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).filter(F.col(confidence) >= F.col("threshold"))
    fee = lambda b: F.sum(F.col(pnl) - F.col(price) * (b / BPS))
    return each.groupBy("threshold").agg(F.count("*").alias("n"), F.sum(pnl).alias("gross"), fee(maker_bps).alias("net_maker"), fee(taker_bps).alias("net_taker"), F.avg((F.col(pnl) > 0).cast("int")).alias("win_rate"))


def trailing_thresholds(rows: DataFrame, score: str, day: str, step: int, window: int, rate: float, least: int, keys: list[str]) -> DataFrame:
    """For each day the (1 - rate) quantile of the scores of the days before it: the last ``window`` of them, or all if those scores are too few.

    Days are ``step`` apart in the day column. A score is dealt to the ``window`` days after it, so the
    join is by equality and rows grow by that factor alone. Only days short of scores look at all the past.
    """
    days = rows.select(*keys, F.col(day).alias("_d")).distinct()
    past = rows.filter(F.col(score).isNotNull()).select(*keys, F.col(day).alias("_p"), F.col(score).alias("_s"))
    q = F.lit(1 - rate)
    dealt = past.select(*keys, "_s", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("_k"), "_p").select(*keys, "_s", (F.col("_p") + F.col("_k") * step).alias("_d"))
    close = dealt.join(days, [*keys, "_d"], "left_semi").groupBy(*keys, "_d").agg(F.count("*").alias("n_near"), F.percentile("_s", q).alias("_near"))
    known = days.join(close, [*keys, "_d"], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    short = known.filter(F.col("n_near") < least).select(*keys, "_d")
    # joined on the keys alone, since every earlier score counts: few days are short
    on = [short[k] == past[k] for k in keys]
    far = short.join(past, [*on, past["_p"] < short["_d"]]).groupBy(*[short[k] for k in keys], "_d").agg(F.percentile("_s", q).alias("_all"))
    joined = known.join(far, [*keys, "_d"], "left")
    return joined.select(*keys, F.col("_d").alias(day), "n_near", F.when(F.col("n_near") >= least, F.col("_near")).otherwise(F.col("_all")).alias("threshold"))


def frozen_trigger(rows: DataFrame, part: str, score: str, rate: float, keys: list[str], low: bool = False) -> DataFrame:
    """Test rows in the score's tail, whose bound is a quantile of the validation rows alone.

    The upper tail starts at the (1 - rate) quantile; ``low`` takes the lower tail up to the rate quantile.
    """
    edge = rows.filter(F.col(part) == "val").groupBy(*keys).agg(F.percentile(score, F.lit(rate if low else 1 - rate)).alias("threshold"))
    hit = F.col(score) <= F.col("threshold") if low else F.col(score) >= F.col("threshold")
    return rows.filter(F.col(part) == "test").join(edge, keys).filter(hit)


def by_key_in_order(rows: DataFrame, keys: tuple[str, ...], order: str, step, schema: str, columns: list[str]) -> DataFrame:
    """Runs step(frame of one key in order) -> frame for each key; for rules that can't be unrolled."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(pdf.sort_values(order, kind="stable"))

    return rows.select(*keys, *columns).groupBy(*keys).applyInPandas(run, schema)


def non_overlapping(rows: DataFrame, keys: tuple[str, ...], ts: str, busy_until: str, value: str) -> DataFrame:
    """Greedy trades: a trigger counts if its time isn't before the end of the last that counted. Rows are triggers only."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        until, took = -np.inf, []
        for t, end in zip(pdf[ts], pdf[busy_until], strict=True):
            took.append(t >= until)
            if took[-1]:
                until = end
        return pdf[took]

    types = {c: t for c, t in rows.dtypes}
    columns = [ts, busy_until, value]
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, *columns))
    return by_key_in_order(rows, keys, ts, step, schema, columns)


def ewm(rows: DataFrame, keys: tuple[str, ...], ts: str, value: str, spans: dict[str, int]) -> DataFrame:
    """Exponential means with weight 2 / (span + 1), the first value as start."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.copy()
        for name, span in spans.items():
            out[name] = pdf[value].ewm(span=span, adjust=False).mean()
        return out

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in (*keys, ts, value)), *(f"{n} double" for n in spans)])
    return by_key_in_order(rows, keys, ts, step, schema, [ts, value])


def cross_signal(rows: DataFrame, fast: str, slow: str, warm: int, ts: str, hole: int, keys: tuple[str, ...]) -> DataFrame:
    """+1 where the fast mean is above the slow one, -1 below; null while warming up at the start and after a hole."""
    w = Window.partitionBy(*keys).orderBy(ts)
    broke = F.col(ts) - F.lag(ts).over(w) > hole
    marked = rows.withColumn("_run", islands(F.coalesce(broke, F.lit(True)), w))
    age = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(ts))
    return marked.withColumn("signal", F.when(age > warm, F.signum(F.col(fast) - F.col(slow)).cast("int"))).drop("_run")


def overlay(rows: DataFrame, keys: tuple[str, ...], ts: str, base: str, score: str, price: str, step: int, k: float, resume: float, cooldown: int, persist: int, long_only: bool = True, veto: bool = True) -> DataFrame:
    """Holds the base position unless the score is against it; adds position and the turnover of either cause.

    The score is against a direction at -k or beyond. ``persist`` such bars in a row end a position and bar its direction; so
    does one where a position would open (veto). A barred direction opens again once ``cooldown`` bars are over and the
    score is above -k * resume, and is free as soon as the base asks for another. A bar that the next one doesn't follow
    at ``step`` seconds is left flat, and what was barred stays so. turn_base and turn_overlay are in units of the price.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, barred, rest, streak = 0, 0, 0, 0
        follows = np.append(np.diff(pdf[ts].to_numpy()) == step, False)
        out: list[tuple[int, float, float]] = []
        for want, s, p, ok in zip(pdf[base], pdf[score], pdf[price], follows, strict=True):
            want = 0 if pd.isna(want) else max(int(want), 0) if long_only else int(want)
            pull = math.nan if pd.isna(s) else s * want
            barred = barred if want == barred else 0
            rest = max(rest - 1, 0)
            against = want != 0 and pull <= -k
            held = at != 0 and want == at
            streak = streak + 1 if held and against else 0
            goal, quick = want, False
            if held and streak >= persist:
                goal, quick, barred, rest, streak = 0, True, at, cooldown, 0
            elif at == 0 and want != 0 and barred == want:
                quick = rest == 0 and pull > -k * resume
                goal, barred = (want, 0) if quick else (0, barred)
            elif at == 0 and veto and against:
                goal, barred = 0, want
            goal, quick = (goal, quick) if ok else (0, False)
            moved = abs(goal - at) * p
            out.append((goal, 0.0 if quick else moved, moved if quick else 0.0))
            at = goal
        return pdf.assign(**dict(zip(("position", "turn_base", "turn_overlay"), zip(*out, strict=True), strict=True))) if out else pdf

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in (*keys, ts, base, score, price)), "position int, turn_base double, turn_overlay double"])
    return by_key_in_order(rows, keys, ts, run, schema, [ts, base, score, price])


def circular_shift(rows: DataFrame, keys: list[str], ts: str, value: str, shift: int, name: str) -> DataFrame:
    """A control: each row with the value ``shift`` rows on, round the end."""
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    moved = numbered.select(*keys, F.pmod(F.col("_k") - shift, F.col("_n")).alias("_k"), F.col(value).alias(name))
    return numbered.drop("_n").join(moved, [*keys, "_k"]).drop("_k")


def gate(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Adds each test and whether all hold; an unknown test fails."""
    out = rows
    for name, test in tests.items():
        out = out.withColumn(name, F.coalesce(test, F.lit(False)))
    ok = F.lit(True)
    for name in tests:
        ok = ok & F.col(name)
    return out.withColumn("passed", ok)


def equity_metrics(rows: DataFrame, pnl: str, keys: list[str], ts: str, start: float, bars_a_year: float) -> DataFrame:
    """Final equity from a starting capital, largest drawdown in percent of its peak, annual Sharpe, Calmar."""
    w = Window.partitionBy(*keys).orderBy(ts)
    curve = rows.filter(F.col(pnl).isNotNull()).withColumn("_e", F.lit(start) + running(pnl, w))
    curve = curve.withColumn("_p", F.greatest(F.lit(start), running("_e", w, F.max)))
    got = curve.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(pnl).alias("total"), F.max((F.col("_p") - F.col("_e")) / F.col("_p") * 100).alias("max_drawdown_pct"), F.avg(pnl).alias("_m"), F.stddev_pop(pnl).alias("_s"))
    out = got.withColumn("sharpe", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(F.lit(bars_a_year))))
    return out.withColumn("calmar", F.when(F.col("max_drawdown_pct") > 0, F.col("total") / F.lit(start) * 100 / F.col("max_drawdown_pct"))).drop("_m", "_s")


def routed(maker: DataFrame, taker: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Hybrid routing: the taker's result where the quick score agrees with the side, else the maker's."""
    both = maker.select(*keys, "side", F.col("net_bps").alias("maker_bps"), "filled").join(taker.select(*keys, F.col(score).alias("_q"), F.col("net_bps").alias("taker_bps")), keys)
    take = F.col("_q") * F.col("side") > 0
    return both.withColumn("route", F.when(take, "taker").otherwise("maker")).withColumn("net_bps", F.when(take, F.col("taker_bps")).otherwise(F.col("maker_bps"))).drop("_q")


def even_sample(rows: DataFrame, keys: list[str], ts: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key at an even step: a report's sample."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("_k", F.row_number().over(w.orderBy(ts)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(most)))
    return numbered.filter(F.col("_k") % step == 0).drop("_k", "_n")


def weighted_sample(rows: DataFrame, weight: str, n: int, id_col: str, seed: int = 0, groups: int = 64) -> DataFrame:
    """n draws of rows by weight with replacement, seeded by hashes: columns draw, id and weight.

    Rows are dealt to groups by a hash of their id; a draw picks a group by its total, then a row of it by the running
    weight, so no order over all rows is made.
    """
    group = F.floor(hashed(F.lit(seed), F.lit("g"), F.col(id_col)) * groups).cast("int")
    live = rows.filter(F.col(weight) > 0).select(id_col, F.col(weight).alias("w"), group.alias("g"))
    until = F.sum("w").over(Window.partitionBy("g").orderBy(id_col))
    placed = live.withColumn("hi", until).withColumn("lo", F.col("hi") - F.col("w"))
    totals = live.groupBy("g").agg(F.sum("w").alias("t")).withColumn("end", F.sum("t").over(Window.orderBy("g")))  # a row a group
    whole = totals.agg(F.max("end").alias("all"))
    draws = rows.sparkSession.range(n).select((F.col("id") + 1).alias("draw"))
    aimed = draws.withColumn("u", hashed(F.lit(seed), F.lit("d"), F.col("draw"))).join(F.broadcast(whole)).withColumn("x", F.col("u") * F.col("all"))
    picked = aimed.join(F.broadcast(totals), (F.col("x") >= F.col("end") - F.col("t")) & (F.col("x") < F.col("end")))
    within = picked.select("draw", "g", (F.col("x") - (F.col("end") - F.col("t"))).alias("y"))
    met = within.join(placed, "g").filter("y >= lo and y < hi")
    return met.select("draw", id_col, F.col("w").alias(weight))
