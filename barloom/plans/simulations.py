"""Trading rules over daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import along
from ..operators import simulation as X
from ..operators import stats as T
from ..sources.tables import DAY
from ..workers import reachable
from .features import first
from .shared import MONTH, SCORED, rounded, rsql, scored

QUERIES, ORACLE = {}, {}
TAKER, MAKER = 5.0, 2.0
#: Positions are long above this score and short below its negative.
AT = 0.15


def by_bar():
    return along("stream", by="bar")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def sided(spark, sf_dir):
    side = F.when(F.col("score") >= AT, 1).when(F.col("score") <= -AT, -1)
    return scored(spark, sf_dir).withColumn("side", side)


SIDED = f"{SCORED}, sided AS (SELECT *, CASE WHEN score >= 0.15 THEN 1 WHEN score <= -0.15 THEN -1 END AS side FROM scored)"
W = "WINDOW w AS (PARTITION BY stream ORDER BY bar)"


@query(f"WITH {SIDED} SELECT stream, bar, side, round(side * (lead(close, 3) OVER w / close - 1) * 10000 - 10, 4) AS net_bps FROM sided QUALIFY side IS NOT NULL {W}".replace(f"QUALIFY side IS NOT NULL {W}", f"{W} QUALIFY side IS NOT NULL"))
def sim_endpoint_bps(spark, sf_dir):
    rows = sided(spark, sf_dir).withColumn("net_bps", X.endpoint_bps("close", F.col("side"), 3, 2 * TAKER, by_bar()))
    return rounded(rows.filter("side is not null").select("stream", "bar", "side", "net_bps"), 4)


H, TP, SL = 6, 0.2, 0.15
AHEAD = lambda k, h=H: "CASE " + " ".join(f"WHEN {k} = {j} THEN lead(close, {j}) OVER w" for j in range(1, h + 1)) + " END"
TPSL = f"""{SIDED}, k AS (SELECT *, {first(H, f'side * ($x / close - 1) >= {TP}')} AS k_tp, {first(H, f'side * ($x / close - 1) <= -{SL}')} AS k_sl FROM sided {W}),
e AS (SELECT *, least(k_tp, k_sl, {H}) AS exit_k, CASE WHEN k_sl <= k_tp AND k_sl <= {H} THEN 'sl' WHEN k_tp <= {H} THEN 'tp' ELSE 'time' END AS exit_reason FROM k),
x AS (SELECT *, {AHEAD('exit_k')} AS px, lead(close, {H}) OVER w AS pend FROM e {W}),
tpsl AS (SELECT *, CASE WHEN pend IS NOT NULL THEN CASE WHEN exit_reason = 'tp' THEN {TP} * 10000 - 7 ELSE side * (px / close - 1) * 10000 - 10 END END AS net_bps FROM x WHERE side IS NOT NULL)"""


def exits(spark, sf_dir, tp=TP, sl=SL):
    return X.tp_sl(sided(spark, sf_dir), "close", F.col("side"), H, tp, sl, TAKER, MAKER, by_bar()).filter("side is not null")


@query(f"WITH {TPSL} SELECT stream, bar, side, exit_k, exit_reason, round(net_bps, 4) AS net_bps FROM tpsl")
def sim_tp_sl(spark, sf_dir):
    return rounded(exits(spark, sf_dir).select("stream", "bar", "side", "exit_k", "exit_reason", "net_bps"), 4)


WAIT, DELAY, DELTA = 3, 0, 0.01
def maker_sql(wait: int, delay: int, delta: float) -> str:
    """CTEs up to ``maker``: orders that rest ``delta`` better than the trigger's close."""
    last = min(delay + wait, H)
    touch = ", ".join(f"CASE WHEN side * ((lead(close, {j}) OVER w) / lim - 1) <= 0 THEN {j} END" for j in range(delay + 1, last + 1))
    touch = f"least({touch})" if last - delay > 1 else touch
    return f"""{SIDED}, l AS (SELECT *, close * (1 - side * {delta}) AS lim FROM sided),
g AS (SELECT *, {touch} AS k_fill FROM l {W}),
t AS (SELECT *, coalesce(least({', '.join(f'CASE WHEN {j} > k_fill AND side * ((lead(close, {j}) OVER w) / lim - 1) >= {TP} THEN {j} END' for j in range(1, H + 1))}), {H + 1}) AS k_tp,
  coalesce(least({', '.join(f'CASE WHEN {j} >= k_fill AND side * ((lead(close, {j}) OVER w) / lim - 1) <= -{SL} THEN {j} END' for j in range(1, H + 1))}), {H + 1}) AS k_sl FROM g {W}),
e AS (SELECT *, CASE WHEN k_fill IS NULL THEN 'unfilled' WHEN k_sl <= k_tp AND k_sl <= {H} THEN 'sl' WHEN k_tp <= {H} THEN 'tp' ELSE 'time' END AS exit_reason, CASE WHEN k_fill IS NOT NULL THEN least(k_tp, k_sl, {H}) END AS exit_k FROM t),
x AS (SELECT *, {AHEAD('exit_k')} AS px, lead(close, {H}) OVER w AS pend FROM e {W}),
maker AS (SELECT *, CASE WHEN pend IS NOT NULL THEN k_fill IS NOT NULL END AS filled, CASE WHEN pend IS NOT NULL AND k_fill IS NOT NULL THEN CASE WHEN exit_reason = 'tp' THEN {TP} * 10000 - 4 ELSE side * (px / lim - 1) * 10000 - 7 END END AS net_bps FROM x WHERE side IS NOT NULL)"""


MAKERSQL = maker_sql(WAIT, DELAY, DELTA)


def orders(spark, sf_dir):
    return X.maker_fill(sided(spark, sf_dir), "close", F.col("side"), H, WAIT, DELAY, DELTA, TP, SL, MAKER, TAKER, by_bar()).filter("side is not null")


@query(f"WITH {MAKERSQL} SELECT stream, bar, side, k_fill, CAST(filled AS INT) AS filled, exit_k, exit_reason, round(net_bps, 4) AS net_bps FROM maker")
def sim_maker_fill(spark, sf_dir):
    return rounded(orders(spark, sf_dir).select("stream", "bar", "side", "k_fill", F.col("filled").cast("int").alias("filled"), "exit_k", "exit_reason", "net_bps"), 4)


@query(f"""WITH {MAKERSQL} SELECT stream, count(filled) AS triggers, round(avg(CAST(filled AS INT)), 6) AS fill_rate, round(avg(net_bps), 4) AS mean_net, round(coalesce(sum(net_bps), 0) / count(filled), 4) AS ev_per_trigger,
  round(avg(CASE WHEN filled THEN CAST(exit_reason = 'tp' AS INT) END), 6) AS hit_filled, round(avg(CASE WHEN NOT filled THEN side * (pend / close - 1) * 10000 END), 4) AS missed_gross FROM maker GROUP BY stream""")
def sim_maker_summary(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("ok", F.col("filled"))
    rows = rows.join(sided(spark, sf_dir).select("stream", "bar", F.lead("close", H).over(by_bar()).alias("pend")), ["stream", "bar"])
    missed = F.when(~F.col("filled"), F.col("side") * (F.col("pend") / F.col("close") - 1) * X.BPS)
    return rounded(
        rows.groupBy("stream").agg(
            F.count("filled").alias("triggers"),
            F.round(F.avg(F.col("filled").cast("int")), 6).alias("fill_rate"),
            F.round(F.avg("net_bps"), 4).alias("mean_net"),
            F.round(F.coalesce(F.sum("net_bps"), F.lit(0.0)) / F.count("filled"), 4).alias("ev_per_trigger"),
            F.round(F.avg(F.when(F.col("filled"), (F.col("exit_reason") == "tp").cast("int"))), 6).alias("hit_filled"),
            F.round(F.avg(missed), 4).alias("missed_gross"),
        )
    )


GRID = [(0.1, 0.1), (0.2, 0.15), (0.3, 0.2)]


def _one(tp: float, sl: float) -> str:
    return f"""SELECT CAST({tp} AS DOUBLE) AS tp, CAST({sl} AS DOUBLE) AS sl, net, reason FROM (SELECT side, CASE WHEN pend IS NOT NULL THEN CASE WHEN reason = 'tp' THEN {tp} * 10000 - 7 ELSE side * (px / close - 1) * 10000 - 10 END END AS net, reason FROM (
  SELECT *, {AHEAD('least(kt, ks, 6)')} AS px, lead(close, {H}) OVER w AS pend, CASE WHEN ks <= kt AND ks <= {H} THEN 'sl' WHEN kt <= {H} THEN 'tp' ELSE 'time' END AS reason FROM (
  SELECT *, {first(H, f'side * ($x / close - 1) >= {tp}')} AS kt, {first(H, f'side * ($x / close - 1) <= -{sl}')} AS ks FROM sided {W}) {W})) WHERE side IS NOT NULL"""


@query(f"WITH {SIDED}, g AS ({' UNION ALL '.join(_one(*p) for p in GRID)}) SELECT tp, sl, count(net) AS n, round(avg(net), 4) AS mean_net, round(avg(CASE WHEN net IS NOT NULL THEN CAST(reason = 'tp' AS INT) END), 6) AS hit FROM g GROUP BY tp, sl")
def sim_param_grid(spark, sf_dir):
    """Each setting adds columns over one shared sort; results meet in one aggregation."""
    rows = sided(spark, sf_dir)
    parts = [X.tp_sl(rows, "close", F.col("side"), H, tp, sl, TAKER, MAKER, by_bar()).filter("side is not null").select(F.lit(tp).alias("tp"), F.lit(sl).alias("sl"), "net_bps", "exit_reason") for tp, sl in GRID]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    got = both.groupBy("tp", "sl").agg(F.count("net_bps").alias("n"), F.round(F.avg("net_bps"), 4).alias("mean_net"), F.round(F.avg(F.when(F.col("net_bps").isNotNull(), (F.col("exit_reason") == "tp").cast("int"))), 6).alias("hit"))
    return got


@query(f"""WITH {SCORED}, r AS (SELECT *, CASE WHEN score >= 0.3 THEN 1 WHEN score <= -0.3 THEN -1 WHEN abs(score) <= 0.09 THEN 0 END AS raw, lead(bar) OVER w - bar = 86400 AS nxt FROM scored {W}),
h AS (SELECT *, coalesce(last_value(raw IGNORE NULLS) OVER (PARTITION BY stream ORDER BY bar ROWS UNBOUNDED PRECEDING), 0) AS held FROM r), p AS (SELECT *, CASE WHEN nxt THEN held ELSE 0 END AS position FROM h),
t AS (SELECT *, abs(position - coalesce(lag(position) OVER w, 0)) AS turnover FROM p {W})
SELECT stream, bar, position, turnover, round(CASE WHEN position <> 0 THEN position * ret * 10000 ELSE 0 END - turnover * 5, 4) AS pnl_bps FROM t""")
def sim_hysteresis_position(spark, sf_dir):
    return rounded(positions(spark, sf_dir).select("stream", "bar", "position", "turnover", "pnl_bps"), 4)


def positions(spark, sf_dir):
    follows = F.lead("bar").over(by_bar()) - F.col("bar") == DAY
    held = X.hysteresis(scored(spark, sf_dir), "score", 0.3, 0.09, follows, by_bar())
    pnl = F.when(F.col("position") != 0, F.col("position") * F.col("ret") * X.BPS).otherwise(0.0) - F.col("turnover") * TAKER
    return held.withColumn("pnl_bps", pnl)


PNL = f"{SIDED}, pnl AS (SELECT *, side * fwd AS pnl FROM sided WHERE side IS NOT NULL AND fwd IS NOT NULL)"


def results(spark, sf_dir):
    return sided(spark, sf_dir).filter("side is not null and fwd is not null").withColumn("pnl", F.col("side") * F.col("fwd"))


@query(f"""WITH {PNL}, q AS (SELECT *, sum(pnl) OVER (PARTITION BY stream ORDER BY bar ROWS UNBOUNDED PRECEDING) AS equity FROM pnl), k AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY stream ORDER BY bar ROWS UNBOUNDED PRECEDING)) AS peak FROM q)
SELECT stream, bar, {rsql('pnl', 'equity', 'peak', digits=4)}, round(equity - peak, 4) AS drawdown FROM k""")
def equity_drawdown(spark, sf_dir):
    return rounded(X.equity(results(spark, sf_dir), "pnl", by_bar()).select("stream", "bar", "pnl", "equity", "peak", "drawdown"), 4)


@query(f"""WITH {PNL}, s AS (SELECT *, CAST(sign(pnl) AS INT) AS k FROM pnl), c AS (SELECT *, CASE WHEN k IS DISTINCT FROM lag(k) OVER w THEN 1 ELSE 0 END AS c FROM s {W}),
i AS (SELECT *, sum(c) OVER (PARTITION BY stream ORDER BY bar) AS run FROM c), r AS (SELECT stream, run, any_value(k) AS k, count(*) AS n FROM i GROUP BY ALL)
SELECT stream, coalesce(max(n) FILTER (k = 1), 0) AS longest_win, coalesce(max(n) FILTER (k = -1), 0) AS longest_loss FROM r GROUP BY stream""")
def equity_streaks(spark, sf_dir):
    return X.streaks(results(spark, sf_dir), "pnl", ("stream",), "bar")


@query(f"""WITH {PNL}, g AS (SELECT stream, count(*) AS n, sum(pnl) AS total, avg(CAST(pnl > 0 AS INT)) AS win_rate, avg(pnl) FILTER (pnl > 0) AS avg_win, avg(pnl) FILTER (pnl < 0) AS avg_loss,
  coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gain, coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS loss, avg(pnl) AS mean, stddev_pop(pnl) AS std FROM pnl GROUP BY stream)
SELECT stream, n, {rsql('total', 'win_rate', 'avg_win', 'avg_loss', digits=4)}, round(CASE WHEN loss > 0 THEN gain / loss END, 4) AS profit_factor, round(CASE WHEN std > 0 THEN mean / std END, 4) AS sharpe, round(-avg_loss / (avg_win - avg_loss), 4) AS breakeven FROM g""")
def backtest_summary(spark, sf_dir):
    return rounded(X.trade_stats(results(spark, sf_dir), "pnl", ["stream"]), 4)


@query(f"WITH {SCORED} SELECT stream, round(arg_max(close, bar) - arg_min(close, bar), 4) AS buy_and_hold FROM scored GROUP BY stream")
def buy_and_hold(spark, sf_dir):
    return rounded(scored(spark, sf_dir).groupBy("stream").agg((F.max_by("close", "bar") - F.min_by("close", "bar")).alias("buy_and_hold")), 4)


@query(f"WITH {PNL} SELECT CAST((bar // 86400 + 3) % 7 AS INT) AS weekday, side, count(*) AS n, round(sum(pnl), 4) AS pnl, round(avg(CAST(pnl > 0 AS INT)), 6) AS win_rate FROM pnl GROUP BY ALL")
def pnl_by_weekday(spark, sf_dir):
    """By weekday and direction."""
    day = F.weekday(F.timestamp_seconds("bar")).cast("int").alias("weekday")
    return results(spark, sf_dir).groupBy(day, "side").agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("pnl"), F.round(F.avg((F.col("pnl") > 0).cast("int")), 6).alias("win_rate"))


DECILES = ", ".join(repr(k / 10) for k in range(1, 10))


@query(f"""WITH {PNL}, e AS (SELECT quantile_cont(abs(score), [{DECILES}]) AS q FROM pnl), b AS (SELECT pnl, {' + '.join(f'CAST(abs(score) > q[{k}] AS INT)' for k in range(1, 10))} AS decile FROM pnl, e)
SELECT decile, count(*) AS n, round(sum(pnl), 4) AS pnl, round(avg(pnl), 4) AS mean_pnl FROM b GROUP BY decile""")
def pnl_by_decile(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("strength", F.abs("score"))
    edges = rows.agg(F.percentile("strength", F.array(*[F.lit(k / 10) for k in range(1, 10)])).alias("edges"))
    binned = rows.crossJoin(F.broadcast(edges)).withColumn("decile", T.quantile_bins("strength", F.col("edges")))  # one row of edges
    return rounded(binned.groupBy("decile").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"), F.avg("pnl").alias("mean_pnl")), 4)


LEVELS = [0.15, 0.2, 0.3, 0.4, 0.5]


@query(f"""WITH {PNL}, t AS (SELECT CAST(unnest({LEVELS}) AS DOUBLE) AS threshold)
SELECT threshold, count(*) AS n, round(sum(pnl), 4) AS gross, round(sum(pnl - close * (4 / 10000.0)), 4) AS net_maker, round(sum(pnl - close * (10 / 10000.0)), 4) AS net_taker, round(avg(CAST(pnl > 0 AS INT)), 4) AS win_rate FROM pnl, t WHERE abs(score) >= threshold GROUP BY threshold""")
def confidence_sweep(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("strength", F.abs("score"))
    return rounded(X.sweep(rows, "strength", "pnl", "close", LEVELS, 4.0, 10.0), 4)


TRIG = f"""{SCORED}, trig AS (SELECT *, count(score) OVER near AS n_near, CASE WHEN count(score) OVER near >= 20 THEN quantile_cont(score, 0.9) OVER near ELSE quantile_cont(score, 0.9) OVER past END AS threshold FROM scored
  WINDOW near AS (PARTITION BY stream ORDER BY bar RANGE BETWEEN {MONTH} PRECEDING AND 1 PRECEDING), past AS (PARTITION BY stream ORDER BY bar RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def triggers(spark, sf_dir):
    return X.trailing_thresholds(scored(spark, sf_dir), "score", "bar", DAY, MONTH // DAY, 0.1, 20, ["stream"])


@query(f"WITH {TRIG} SELECT stream, bar, n_near, round(threshold, 6) AS threshold FROM trig")
def trigger_rolling_quantile(spark, sf_dir):
    return rounded(triggers(spark, sf_dir))


@query(f"WITH {TRIG} SELECT stream, bar, round(score, 6) AS score FROM trig WHERE score >= threshold AND imb >= threshold")
def trigger_unanimity(spark, sf_dir):
    """Both scores, the rolling one and the bar's own, are above the trailing threshold."""
    both = scored(spark, sf_dir).join(triggers(spark, sf_dir), ["stream", "bar"])
    return rounded(both.filter((F.col("score") >= F.col("threshold")) & (F.col("imb") >= F.col("threshold"))).select("stream", "bar", "score"))


@query(f"""WITH {TPSL}, g AS (SELECT stream, count(net_bps) AS n, avg(net_bps) AS mean_net, avg(CASE WHEN net_bps IS NOT NULL THEN CAST(exit_reason = 'tp' AS INT) END) AS hit FROM tpsl GROUP BY stream)
SELECT stream, n, round(mean_net, 4) AS mean_net, round(hit, 6) AS hit, n >= 100 AS enough, mean_net > 0 AS pays, hit > 0.3 AS hits, n >= 100 AND mean_net > 0 AND hit > 0.3 AS passed FROM g""")
def gate_verdict(spark, sf_dir):
    by = exits(spark, sf_dir).groupBy("stream").agg(F.count("net_bps").alias("n"), F.avg("net_bps").alias("mean_net"), F.avg(F.when(F.col("net_bps").isNotNull(), (F.col("exit_reason") == "tp").cast("int"))).alias("hit"))
    got = X.gate(by, {"enough": F.col("n") >= 100, "pays": F.col("mean_net") > 0, "hits": F.col("hit") > 0.3})
    return got.withColumn("mean_net", F.round("mean_net", 4)).withColumn("hit", F.round("hit", 6))


@query(f"WITH {SIDED}, c AS (SELECT stream, period, count(*) AS n FROM sided WHERE side IS NOT NULL GROUP BY ALL) SELECT stream, period, n, round(n / sum(n) OVER (PARTITION BY stream), 6) AS share FROM c")
def trigger_fold_share(spark, sf_dir):
    from pyspark.sql import Window

    by = sided(spark, sf_dir).filter("side is not null").groupBy("stream", "period").agg(F.count("*").alias("n"))
    return rounded(by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("stream"))))


@query(f"""WITH {SCORED}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY bar) - 1 AS i, count(*) OVER (PARTITION BY stream) AS n FROM scored)
SELECT a.stream, a.bar, round(b.score, 6) AS shifted FROM n a JOIN n b ON a.stream = b.stream AND b.i = (a.i + 100) % a.n""")
def control_circular_shift(spark, sf_dir):
    return rounded(X.circular_shift(scored(spark, sf_dir).select("stream", "bar", "score"), ["stream"], "bar", "score", 100, "shifted").select("stream", "bar", "shifted"))


@query(f"""WITH {TPSL}, m AS (SELECT stream, side, count(net_bps) AS n, avg(CASE WHEN net_bps IS NOT NULL THEN CAST(exit_reason = 'tp' AS INT) END) AS hit, avg(net_bps) AS mean_net, avg(exit_k) AS mean_k FROM tpsl GROUP BY ALL)
SELECT stream, side, n, {rsql('hit', 'mean_net', 'mean_k', digits=4)} FROM m""")
def trigger_stats(spark, sf_dir):
    hit = F.avg(F.when(F.col("net_bps").isNotNull(), (F.col("exit_reason") == "tp").cast("int")))
    return rounded(exits(spark, sf_dir).groupBy("stream", "side").agg(F.count("net_bps").alias("n"), hit.alias("hit"), F.avg("net_bps").alias("mean_net"), F.avg("exit_k").alias("mean_k")), 4)


EPISODES = f"""{SCORED}, r AS (SELECT *, CASE WHEN score >= 0.3 THEN 1 WHEN score <= -0.3 THEN -1 WHEN abs(score) <= 0.09 THEN 0 END AS raw, lead(bar) OVER w - bar = 86400 AS nxt FROM scored {W}),
h AS (SELECT *, coalesce(last_value(raw IGNORE NULLS) OVER (PARTITION BY stream ORDER BY bar ROWS UNBOUNDED PRECEDING), 0) AS held FROM r), p AS (SELECT *, CASE WHEN nxt THEN held ELSE 0 END AS position FROM h),
t AS (SELECT *, abs(position - coalesce(lag(position) OVER w, 0)) AS turnover, CASE WHEN position <> coalesce(lag(position) OVER w, 0) THEN 1 ELSE 0 END AS c FROM p {W}),
i AS (SELECT *, sum(c) OVER (PARTITION BY stream ORDER BY bar) AS run, position * ret * 10000 - turnover * 5 AS pnl FROM t)"""


@query(f"WITH {EPISODES} SELECT stream, min(bar) AS start, any_value(position) AS side, count(*) AS bars, round(sum(pnl), 4) AS pnl FROM i WHERE position <> 0 GROUP BY stream, run")
def position_episodes(spark, sf_dir):
    return rounded(X.episodes(positions(spark, sf_dir), "position", "pnl_bps", ("stream",), "bar"), 4)


def walked(before: str, source: str) -> str:
    """Greedy trades by a recursive walk: source has stream, bar, until and net_bps of the triggers."""
    return f"""WITH RECURSIVE {before}, triggers AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY bar) AS rn FROM ({source})),
walk AS (SELECT stream, rn, bar, until, net_bps, true AS took, until AS busy FROM triggers WHERE rn = 1
  UNION ALL SELECT t.stream, t.rn, t.bar, t.until, t.net_bps, t.bar >= k.busy, CASE WHEN t.bar >= k.busy THEN t.until ELSE k.busy END FROM walk k JOIN triggers t ON t.stream = k.stream AND t.rn = k.rn + 1)
SELECT stream, bar, until, round(net_bps, 4) AS net_bps FROM walk WHERE took"""


@query(walked(TPSL, f"SELECT stream, bar, bar + exit_k * {DAY} AS until, net_bps FROM tpsl WHERE net_bps IS NOT NULL"))
def sim_non_overlap(spark, sf_dir):
    reachable(spark)
    rows = exits(spark, sf_dir).filter("net_bps is not null").withColumn("until", F.col("bar") + F.col("exit_k") * DAY)
    return rounded(X.non_overlapping(rows, ("stream",), "bar", "until", "net_bps"), 4)


@query(walked(MAKERSQL, f"SELECT stream, bar, bar + coalesce(exit_k, {min(DELAY + WAIT, H)}) * {DAY} AS until, net_bps FROM maker WHERE filled IS NOT NULL"))
def sim_non_overlap_maker(spark, sf_dir):
    """A resting order blocks until its trade ends or, unfilled, until it is withdrawn; unfilled ones have no result."""
    reachable(spark)
    rows = orders(spark, sf_dir).filter("filled is not null").withColumn("until", F.col("bar") + F.coalesce("exit_k", F.lit(min(DELAY + WAIT, H))) * DAY)
    return rounded(X.non_overlapping(rows, ("stream",), "bar", "until", "net_bps"), 4)


CROSS = f"""{SCORED}, n AS MATERIALIZED (SELECT stream, bar, close, score, row_number() OVER (PARTITION BY stream ORDER BY bar) AS rn, coalesce(bar - lag(bar) OVER (PARTITION BY stream ORDER BY bar) > {5 * DAY}, true) AS broke FROM scored),
ema AS (SELECT stream, rn, close AS fast, close AS slow FROM n WHERE rn = 1
  UNION ALL SELECT n.stream, n.rn, e.fast + 2.0 / 13 * (n.close - e.fast), e.slow + 2.0 / 49 * (n.close - e.slow) FROM ema e JOIN n ON n.stream = e.stream AND n.rn = e.rn + 1),
runs AS (SELECT *, sum(CAST(broke AS INT)) OVER (PARTITION BY stream ORDER BY bar) AS run FROM n),
crossed AS (SELECT r.stream, r.bar, r.rn, r.score, r.close, fast, slow, CASE WHEN row_number() OVER (PARTITION BY r.stream, run ORDER BY r.bar) > 48 THEN CAST(sign(fast - slow) AS INT) END AS signal FROM runs r JOIN ema USING (stream, rn))"""


def crossed(spark, sf_dir):
    reachable(spark)
    means = X.ewm(scored(spark, sf_dir), ("stream",), "bar", "close", {"fast": 12, "slow": 48})
    return X.cross_signal(means, "fast", "slow", 48, "bar", 5 * DAY, ("stream",)).select("stream", "bar", "close", "fast", "slow", "signal")


@query(f"WITH RECURSIVE {CROSS} SELECT stream, bar, round(fast, 4) AS fast, round(slow, 4) AS slow, signal FROM crossed")
def feat_ema_cross(spark, sf_dir):
    return rounded(crossed(spark, sf_dir).drop("close"), 4)


K, RESUME, COOLDOWN, PERSIST = 0.25, 0.5, 4, 2


@query(f"""WITH RECURSIVE {CROSS}, o AS MATERIALIZED (SELECT stream, bar, rn, close, score, greatest(coalesce(signal, 0), 0) AS d, coalesce(lead(bar) OVER (PARTITION BY stream ORDER BY bar) - bar = {DAY}, false) AS ok FROM crossed),
m AS (SELECT stream, CAST(0 AS BIGINT) AS rn, 0 AS p, 0 AS barred, 0 AS rest, 0 AS streak, CAST(0 AS DOUBLE) AS turn_base, CAST(0 AS DOUBLE) AS turn_overlay FROM o WHERE rn = 1
  UNION ALL SELECT stream, rn, goal, barred, rest, streak, CASE WHEN quick THEN 0 ELSE abs(goal - p) * close END, CASE WHEN quick THEN abs(goal - p) * close ELSE 0 END FROM (
    SELECT stream, rn, p, close, CASE WHEN ok AND NOT leaves AND NOT vetoed AND NOT (again AND NOT back) THEN d ELSE 0 END AS goal, ok AND (leaves OR back) AS quick,
      CASE WHEN leaves THEN p WHEN back THEN 0 WHEN vetoed THEN d ELSE b0 END AS barred, CASE WHEN leaves THEN {COOLDOWN} ELSE r0 END AS rest, CASE WHEN leaves THEN 0 ELSE st END AS streak FROM (
      SELECT *, held AND st >= {PERSIST} AS leaves, again AND r0 = 0 AND coalesce(score * d > {-K * RESUME}, false) AS back, p = 0 AND d <> 0 AND b0 <> d AND against AS vetoed FROM (
        SELECT *, CASE WHEN held AND against THEN streak + 1 ELSE 0 END AS st, p = 0 AND d <> 0 AND b0 = d AS again FROM (
          SELECT o.*, m.p, m.streak, CASE WHEN m.barred = o.d THEN m.barred ELSE 0 END AS b0, greatest(m.rest - 1, 0) AS r0, o.d <> 0 AND coalesce(o.score * o.d <= {-K}, false) AS against, m.p <> 0 AND o.d = m.p AS held FROM m JOIN o ON o.stream = m.stream AND o.rn = m.rn + 1)))))
SELECT stream, bar, d AS base, m.p AS position, round(turn_base, 4) AS turn_base, round(turn_overlay, 4) AS turn_overlay, round(turn_base * 0.0002 + turn_overlay * 0.0005, 6) AS fees FROM m JOIN o USING (stream, rn)""")
def sim_overlay_machine(spark, sf_dir):
    """Position and turnover of either cause; base moves pay the maker's fee, the overlay's the taker's."""
    rows = crossed(spark, sf_dir).drop("fast", "slow").join(scored(spark, sf_dir).select("stream", "bar", "score"), ["stream", "bar"])
    got = X.overlay(rows, ("stream",), "bar", "signal", "score", "close", DAY, K, RESUME, COOLDOWN, PERSIST)
    fees = F.round(F.col("turn_base") * 0.0002 + F.col("turn_overlay") * 0.0005, 6).alias("fees")
    return got.select("stream", "bar", F.greatest(F.coalesce("signal", F.lit(0)), F.lit(0)).alias("base"), "position", F.round("turn_base", 4).alias("turn_base"), F.round("turn_overlay", 4).alias("turn_overlay"), fees)
