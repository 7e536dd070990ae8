"""Reports and checks that build on the other families."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..functions.windows import along, diff, rolling
from ..operators import bars as B
from ..operators import cleaning as C
from ..operators import folds as D
from ..operators import merge as M
from ..operators import simulation as X
from ..operators import stats as T
from ..sources.tables import DAY, messages, tape
from .features import LABELLED, labelled
from .shared import DAILY, SCORED, TAPE, WEEK, daily, rounded, scored
from .simulations import DELTA, H, MAKER, MAKERSQL, PNL, SIDED, SL, TAKER, TP, TPSL, exits, maker_sql, orders, results, sided

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query(f"WITH {DAILY} SELECT stream, CAST(ceil(bar / 604800.0) * 604800 AS BIGINT) AS label, round(arg_max(close, bar), 6) AS close FROM daily GROUP BY ALL")
def resample_right_closed(spark, sf_dir):
    return rounded(M.resample_right(daily(spark, sf_dir), WEEK, "close"))


@query(f"WITH {PNL}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY bar) - 1 AS k, count(*) OVER (PARTITION BY stream) AS n FROM pnl) SELECT stream, bar, round(pnl, 4) AS pnl FROM n WHERE k % greatest(1, CAST(ceil(n / 40.0) AS BIGINT)) = 0")
def even_sample(spark, sf_dir):
    return rounded(X.even_sample(results(spark, sf_dir).select("stream", "bar", "pnl"), ["stream"], "bar", 40), 4)


@query(f"WITH {PNL}, t AS (SELECT CAST(unnest([0.15, 0.2, 0.3, 0.4, 0.5]) AS DOUBLE) AS threshold), g AS (SELECT threshold, sum(pnl) AS gross FROM pnl, t WHERE abs(score) >= threshold GROUP BY threshold) SELECT arg_max(threshold, gross) AS best_threshold, round(max(gross), 4) AS gross FROM g")
def best_threshold(spark, sf_dir):
    from .simulations import LEVELS

    swept = X.sweep(results(spark, sf_dir).withColumn("strength", F.abs("score")), "strength", "pnl", "close", LEVELS, 4.0, 10.0)
    return rounded(swept.agg(F.max_by("threshold", "gross").alias("best_threshold"), F.max("gross").alias("gross")), 4)


@query(f"WITH {SCORED} SELECT stream, bar, {', '.join(f'round(lag(imb, {k}) OVER w, 6) AS imb_{k}' for k in (0, 1, 2, 4, 8, 16, 32))} FROM scored WINDOW w AS (PARTITION BY stream ORDER BY bar)")
def lag_stack_matrix(spark, sf_dir):
    stacked = scored(spark, sf_dir).select("stream", "bar", *D.lag_stack(["imb"], [0, 1, 2, 4, 8, 16, 32], along("stream", by="bar")))
    return rounded(stacked.toDF(*[c.replace("@", "_") for c in stacked.columns]))


@query(f"WITH {LABELLED}, c AS (SELECT label, count(*) AS c FROM lab GROUP BY label) SELECT label, c, round((SELECT count(*) FROM lab) / ((SELECT count(*) FROM c) * c), 6) AS weight FROM c")
def class_weights(spark, sf_dir):
    return rounded(D.class_weights(labelled(spark, sf_dir), "label"))


@query(f"""WITH {SCORED}, m AS (SELECT stream, bar, unnest([imb, score, (imb + score) / 2]) AS s FROM scored WHERE score IS NOT NULL), e AS (SELECT stream, bar, avg(s) AS s, abs(sum(sign(s))) = count(s) AS unanimous FROM m GROUP BY ALL),
d AS (SELECT stream, stddev_pop(s) AS sd FROM e GROUP BY stream) SELECT stream, bar, round(s / sd, 5) AS score, unanimous FROM e JOIN d USING (stream)""")
def seed_ensemble(spark, sf_dir):
    """Three members a bar: their mean over its deviation, and whether they agree in sign."""
    rows = scored(spark, sf_dir).filter("score is not null")
    members = rows.select("stream", "bar", F.explode(F.array("imb", "score", (F.col("imb") + F.col("score")) / 2)).alias("member"))
    mean = D.ensemble(members, ["stream", "bar"], "member").withColumnRenamed("member", "score")
    spread = mean.groupBy("stream").agg(F.stddev_pop("score").alias("sd"))
    return mean.join(spread, "stream").select("stream", "bar", F.round(F.col("score") / F.col("sd"), 5).alias("score"), "unanimous")


@query(f"""WITH {PNL}, c AS (SELECT *, 100000 + sum(pnl) OVER (PARTITION BY stream ORDER BY bar ROWS UNBOUNDED PRECEDING) AS e FROM pnl), p AS (SELECT *, greatest(100000, max(e) OVER (PARTITION BY stream ORDER BY bar ROWS UNBOUNDED PRECEDING)) AS p FROM c),
g AS (SELECT stream, count(*) AS n, sum(pnl) AS total, max((p - e) / p * 100) AS dd, avg(pnl) AS m, stddev_pop(pnl) AS s FROM p GROUP BY stream)
SELECT stream, n, round(total, 4) AS total, round(dd, 4) AS max_drawdown_pct, round(CASE WHEN s > 0 THEN m / s * sqrt(252) END, 4) AS sharpe, round(CASE WHEN dd > 0 THEN total / 100000 * 100 / dd END, 4) AS calmar FROM g""")
def equity_metrics(spark, sf_dir):
    return rounded(X.equity_metrics(results(spark, sf_dir), "pnl", ["stream"], "bar", 100_000.0, 252.0), 4)


# the CTEs of both rules side by side: those of the taker's bear doubled names
TAKERSQL = re.sub(r"FROM (k|e|x)\b", r"FROM \1\1", re.sub(r"\b(k|e|x) AS \(", r"\1\1 AS (", TPSL[len(SIDED) :]))


@query(f"""WITH {MAKERSQL}{TAKERSQL}, r AS (SELECT m.stream, CASE WHEN t.imb * m.side > 0 THEN 'taker' ELSE 'maker' END AS route, CASE WHEN t.imb * m.side > 0 THEN t.net_bps ELSE m.net_bps END AS net FROM maker m JOIN tpsl t USING (stream, bar))
SELECT stream, route, count(net) AS n, round(avg(net), 4) AS mean_net FROM r GROUP BY stream, route""")
def sim_hybrid_routing(spark, sf_dir):
    """Taker where the bar's own imbalance agrees with the side, else maker."""
    got = X.routed(orders(spark, sf_dir), exits(spark, sf_dir), ["stream", "bar"], "imb")
    return rounded(got.groupBy("stream", "route").agg(F.count("net_bps").alias("n"), F.avg("net_bps").alias("mean_net")), 4)


ENTRIES = ((1, 0, DELTA), (3, 0, DELTA), (3, 1, DELTA), (3, 0, 2 * DELTA))
ENTRYSQL = " UNION ALL ".join(f'SELECT {wait} AS "wait", {delay} AS delay, CAST({delta} AS DOUBLE) AS delta, CAST(filled AS INT) AS filled, net_bps FROM (WITH {maker_sql(wait, delay, delta)} SELECT filled, net_bps FROM maker)' for wait, delay, delta in ENTRIES)


@query(f'SELECT "wait", delay, round(delta, 4) AS delta, count(filled) AS n, round(avg(filled), 4) AS fill_rate, round(avg(net_bps), 4) AS mean_net FROM ({ENTRYSQL}) GROUP BY "wait", delay, delta')
def sim_entry_grid(spark, sf_dir):
    """Fill rate and result by waiting time, delay and distance of the resting order."""
    parts = None
    for wait, delay, delta in ENTRIES:
        one = X.maker_fill(sided(spark, sf_dir), "close", F.col("side"), H, wait, delay, delta, TP, SL, MAKER, TAKER, along("stream", by="bar")).filter("side is not null")
        one = one.select(F.lit(wait).alias("wait"), F.lit(delay).alias("delay"), F.lit(delta).alias("delta"), "filled", "net_bps")
        parts = one if parts is None else parts.unionByName(one)
    return rounded(parts.groupBy("wait", "delay", "delta").agg(F.count("filled").alias("n"), F.avg(F.col("filled").cast("int")).alias("fill_rate"), F.avg("net_bps").alias("mean_net")), 4)


@query(f"""WITH {MAKERSQL}, u AS (SELECT stream, abs(score) AS s, CAST(filled AS INT) AS y FROM maker WHERE filled IS NOT NULL),
k AS (SELECT stream, y, rank() OVER (PARTITION BY stream ORDER BY s) + (count(*) OVER (PARTITION BY stream, s) - 1) / 2.0 AS rk FROM u),
a AS (SELECT stream, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, sum(rk) FILTER (y = 1) AS r FROM k GROUP BY stream)
SELECT stream, n, positives, round(CASE WHEN positives > 0 AND n > positives THEN (r - positives * (positives + 1) / 2.0) / (positives * (n - positives)) END, 6) AS auc FROM a""")
def fill_split_auc(spark, sf_dir):
    """Whether the score's strength tells filled orders from missed ones."""
    rows = orders(spark, sf_dir).filter("filled is not null").withColumn("strength", F.abs("score")).withColumn("y", F.col("filled").cast("int"))
    return rounded(T.roc_auc(rows, "strength", "y", ["stream"]).drop("auc_any"))


@query(f"""WITH {LABELLED}, g AS (SELECT label, CAST(sign(score) AS INT) AS guess, score, fwd FROM lab), c AS (SELECT label, count(*) AS n, count(*) FILTER (label = guess) AS hit FROM g WHERE guess IS NOT NULL GROUP BY label),
a AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(hit) / sum(n) AS accuracy, max(n) / sum(n) AS majority FROM c), i AS (SELECT corr(score, fwd) AS ic FROM lab)
SELECT n, round(accuracy, 4) AS accuracy, round(majority, 4) AS majority, round(accuracy - majority, 4) AS lift, round(ic, 4) AS ic, CASE WHEN abs(ic) < 0.02 THEN 'no signal' WHEN accuracy - majority > 0 THEN 'signal beats the majority' ELSE 'signal below the majority' END AS verdict FROM a, i""")
def summary_verdict(spark, sf_dir):
    """One row: rows, majority share, correlation and a verdict in words."""
    rows = labelled(spark, sf_dir)
    by = T.accuracy_lift(rows.withColumn("guess", F.signum("score").cast("int")).filter("guess is not null"), "label", "guess")
    ic = rows.agg(F.corr("score", "fwd").alias("ic"))
    got = by.crossJoin(F.broadcast(ic))  # one row each
    verdict = F.when(F.abs("ic") < 0.02, "no signal").when(F.col("lift") > 0, "signal beats the majority").otherwise("signal below the majority")
    return rounded(got.withColumn("verdict", verdict), 4)


@query(f"""WITH {PNL}, v AS (SELECT stream || '-' || bar AS key, abs(pnl) AS w FROM pnl WHERE abs(pnl) > 0), u AS (SELECT *, CAST(floor(('0x' || substr(md5('0-g-' || key), 1, 8))::BIGINT / 4294967296.0 * 64) AS INT) AS g FROM v),
p AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY key) AS hi FROM u), t0 AS (SELECT g, sum(w) AS t FROM u GROUP BY g), t AS (SELECT *, sum(t) OVER (ORDER BY g) AS "end" FROM t0),
d AS (SELECT draw, ('0x' || substr(md5('0-d-' || draw), 1, 8))::BIGINT / 4294967296.0 * (SELECT max("end") FROM t) AS x FROM range(1, 201) r(draw))
SELECT CAST(draw AS BIGINT) AS draw, key, round(w, 4) AS w FROM d JOIN t ON x >= "end" - t AND x < "end" JOIN p ON p.g = t.g AND x - ("end" - t) >= hi - w AND x - ("end" - t) < hi""")
def weighted_sample(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("key", F.concat_ws("-", "stream", "bar")).withColumn("w", F.abs("pnl"))
    return rounded(X.weighted_sample(rows.select("key", "w"), "w", 200, "key"), 4)


@query(f"""WITH {SCORED}, p AS (SELECT *, period // 4 AS fold, period % 4 AS quarter FROM scored),
e AS (SELECT stream, fold, quantile_cont(score, 0.8) AS high, quantile_cont(score, 0.2) AS low FROM p WHERE quarter = 2 AND score IS NOT NULL GROUP BY ALL)
SELECT stream, bar, 1 AS side, round(score, 6) AS score, round(high, 6) AS threshold FROM p JOIN e USING (stream, fold) WHERE quarter = 3 AND score >= high
UNION ALL SELECT stream, bar, -1 AS side, round(score, 6) AS score, round(low, 6) AS threshold FROM p JOIN e USING (stream, fold) WHERE quarter = 3 AND score <= low""")
def trigger_frozen_quantile(spark, sf_dir):
    """Both tails of the score; in each fold the third period validates, the fourth tests."""
    quarter = F.col("period") % 4
    rows = scored(spark, sf_dir).withColumn("fold", F.floor(F.col("period") / 4)).withColumn("part", F.when(quarter == 2, "val").when(quarter == 3, "test").otherwise("train"))
    tails = [X.frozen_trigger(rows, "part", "score", 0.2, ["stream", "fold"], low).select("stream", "bar", F.lit(-1 if low else 1).alias("side"), "score", "threshold") for low in (False, True)]
    return rounded(tails[0].unionByName(tails[1]))


@query(f"""WITH {DAILY} SELECT stream, bar, round(close - lag(close, 1) OVER w, 6) AS diff_1, round(close - lag(close, 4) OVER w, 6) AS diff_4,
  round(CASE WHEN count(buy_qty) OVER w12 = 12 THEN sum(buy_qty) OVER w12 END, 6) AS sum_12 FROM daily WINDOW w AS (PARTITION BY stream ORDER BY bar), w12 AS (PARTITION BY stream ORDER BY bar ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def feat_diff_full_sum(spark, sf_dir):
    """Differences, and a rolling sum that needs its whole window."""
    w = along("stream", by="bar")
    return rounded(daily(spark, sf_dir).select("stream", "bar", diff("close", 1, w).alias("diff_1"), diff("close", 4, w).alias("diff_4"), rolling("buy_qty", 12, 12, w, F.sum).alias("sum_12")))


@query(f"""WITH {TAPE}, b AS (SELECT stream, bar, arg_max(bid, seq) AS bc, arg_max(ask, seq) AS ac, quantile_cont(bid, 0.5) AS bm, quantile_cont(ask, 0.5) AS am FROM tape GROUP BY stream, bar)
SELECT stream, bar, round((bc + ac) / 2, 6) AS close, round((bm + am) / 2, 6) AS close_of_medians FROM b""")
def close_from_sides(spark, sf_dir):
    """The close of bars with both sides' closes, and of the same bars under a schema without them."""
    ends = [f(s, *a).alias(f"{s}_{n}") for s in ("bid", "ask") for n, f, a in (("close", F.max_by, ("seq",)), ("median", F.percentile, (F.lit(0.5),)))]
    bars = B.bars(tape(spark, sf_dir), DAY, *ends)
    both = C.with_close(C.with_close(bars.drop("bid_close", "ask_close")).withColumnRenamed("close", "close_of_medians").drop("bid_median", "ask_median").join(bars.select("stream", "bar", "bid_close", "ask_close"), ["stream", "bar"]))
    return rounded(both.select("stream", "bar", "close", "close_of_medians"))


@query(f"WITH {SCORED}, s AS (SELECT min(bar) AS start FROM scored WHERE score IS NOT NULL) SELECT stream, bar, round(close, 6) AS close, round(score, 6) AS score FROM scored, s WHERE bar >= start")
def era_slice(spark, sf_dir):
    return rounded(C.era(scored(spark, sf_dir), "bar", "score").select("stream", "bar", "close", "score"))


@query(f"""WITH {SCORED}, n AS (SELECT count(*) AS n, count(*) FILTER (score IS NULL OR fwd IS NULL OR imb IS NULL) AS lost, count(score) AS a, count(fwd) AS b, count(imb) AS c FROM scored),
u AS (SELECT 'score' AS "column", 1 - a / n AS null_share, lost / n AS lost_share FROM n UNION ALL SELECT 'fwd', 1 - b / n, lost / n FROM n UNION ALL SELECT 'imb', 1 - c / n, lost / n FROM n)
SELECT "column", round(null_share, 6) AS null_share, round(lost_share, 6) AS lost_share, row_number() OVER (ORDER BY null_share DESC, "column") AS worst, CAST(lost_share > 0.05 AS INT) AS warn FROM u""")
def null_loss_report(spark, sf_dir):
    got = C.null_losses(scored(spark, sf_dir), ["score", "fwd", "imb"])
    return rounded(got.withColumn("warn", F.col("warn").cast("int")))


@query("SELECT event_id AS seq, CASE WHEN event_type NOT IN ('error', 'signup') THEN round(value, 6) END AS value FROM events")
def finite_values(spark, sf_dir):
    """Errors carry an infinity and signups no number; both become null."""
    raw = F.when(F.col("kind") == "error", float("-inf")).when(F.col("kind") == "signup", float("nan")).otherwise(F.col("value"))
    return rounded(messages(spark, sf_dir).select("seq", finite(raw).alias("value")))
