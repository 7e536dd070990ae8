"""Cleaning, features, as-of joins and labels over daily bars and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import windows as W
from ..operators import cleaning as C
from ..operators import joins as J
from ..operators import labels as L
from ..sources.tables import DAY, messages, table
from .shared import DAILY, SCORED, daily, rounded, rsql, scored

QUERIES, ORACLE = {}, {}
HOUR = 3600


def by_bar():
    return W.along("stream", by="bar")


def by_key():
    return W.along("key", by="ts")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(epoch(l_shipdate) AS BIGINT) AS ts, round(l_quantity, 6) AS qty FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1")
def dedupe_first(spark, sf_dir):
    first = C.first_of(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])
    return rounded(first.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("ts"), F.col("l_quantity").alias("qty")))


def with_options(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.when(F.col("event_type") == "error", -1.0).otherwise(F.col("value")).alias("opt_value"), F.when(F.col("user_id") % 3 == 0, -1.0).otherwise(F.col("user_id").cast("double")).alias("opt_user"), F.when(F.col("event_id") % 2 == 0, F.lit(1.0)).alias("opt_half"))


OPTIONS = "opts AS (SELECT event_id, CASE WHEN event_type = 'error' THEN -1.0 ELSE value END AS opt_value, CASE WHEN user_id % 3 = 0 THEN -1.0 ELSE CAST(user_id AS DOUBLE) END AS opt_user, CASE WHEN event_id % 2 = 0 THEN 1.0 END AS opt_half FROM events)"


@query(f"WITH {OPTIONS} SELECT event_id, round(nullif(opt_value, -1), 6) AS opt_value, nullif(opt_user, -1) AS opt_user, CAST(opt_half AS DOUBLE) AS opt_half FROM opts")
def sentinel_decode(spark, sf_dir):
    return rounded(C.decode_sentinels(with_options(spark, sf_dir)))


@query(f"WITH {OPTIONS}, d AS (SELECT nullif(opt_value, -1) AS a, nullif(opt_user, -1) AS b, opt_half AS c, count(*) OVER () AS n FROM opts), s AS (SELECT unnest(['opt_value', 'opt_user', 'opt_half']) AS \"column\", unnest([count(a) / max(n), count(b) / max(n), count(c) / max(n)]) AS share FROM d) SELECT \"column\", round(share, 6) AS share, share >= 0.6 AS kept FROM s")
def coverage_guard(spark, sf_dir):
    return rounded(C.column_coverage(C.decode_sentinels(with_options(spark, sf_dir)), ["opt_value", "opt_user", "opt_half"]))


@query(f"WITH {SCORED} SELECT stream, bar, coalesce(bar - lag(bar, 3) OVER w = 3 * 86400 AND lead(bar, 2) OVER w - bar = 2 * 86400 AND fwd IS NOT NULL, false) AS valid FROM scored WINDOW w AS (PARTITION BY stream ORDER BY bar)")
def contiguity_mask(spark, sf_dir):
    return C.sample_valid(scored(spark, sf_dir), ("stream",), "bar", 3, 2, DAY, ["fwd"]).select("stream", "bar", "valid")


@query("WITH e AS (SELECT *, (epoch_us(ts) // 1000000) AS t FROM events) SELECT event_id, round(value, 6) AS value FROM e WHERE t >= (SELECT max(t) FROM e) - 7 * 86400")
def lookback_filter(spark, sf_dir):
    return rounded(C.recent(messages(spark, sf_dir), "ts", 7).select(F.col("seq").alias("event_id"), "value"))


@query("WITH m AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share FROM m")
def schema_mix(spark, sf_dir):
    return rounded(C.schema_mix(table(spark, sf_dir, "events"), "event_type"))


@query(f"WITH {DAILY} SELECT stream, bar, round((buy_qty - sell_qty) / (buy_qty + sell_qty + 1e-9), 6) AS flow_imbalance, round((buy_samples - sell_samples) / (buy_samples + sell_samples + 1e-9), 6) AS sample_imbalance, round(buy_vwap - sell_vwap, 6) AS vwap_spread, round(CASE WHEN max > min THEN (close - min) / (max - min) ELSE 0.5 END, 6) AS stochastic FROM daily")
def feat_imbalance(spark, sf_dir):
    stochastic = F.when(F.col("max") > F.col("min"), (F.col("close") - F.col("min")) / (F.col("max") - F.col("min"))).otherwise(0.5)
    return rounded(daily(spark, sf_dir).select("stream", "bar", S.imbalance("buy_qty", "sell_qty").alias("flow_imbalance"), S.imbalance("buy_samples", "sell_samples").alias("sample_imbalance"), (F.col("buy_vwap") - F.col("sell_vwap")).alias("vwap_spread"), stochastic.alias("stochastic")))


def frame(name: str, n: int) -> str:
    return f"{name} AS (PARTITION BY stream ORDER BY bar ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(f"WITH {SCORED} SELECT stream, bar, round(CASE WHEN count(imb) OVER w4 >= 2 THEN avg(imb) OVER w4 END, 6) AS roll4, round(CASE WHEN count(imb) OVER w8 >= 4 THEN avg(imb) OVER w8 END, 6) AS roll8, round(CASE WHEN count(ret) OVER w16 >= 4 THEN stddev_samp(ret) OVER w16 END, 6) AS vol16, round(CASE WHEN count(samples) OVER w12 >= 12 THEN sum(samples) OVER w12 END, 6) AS sum12 FROM scored WINDOW {frame('w4', 4)}, {frame('w8', 8)}, {frame('w16', 16)}, {frame('w12', 12)}")
def feat_rolling_minperiods(spark, sf_dir):
    rows = scored(spark, sf_dir)
    got = rows.select("stream", "bar", W.rolling("imb", 4, 2, by_bar()).alias("roll4"), W.rolling("imb", 8, 4, by_bar()).alias("roll8"), W.rolling("ret", 16, 4, by_bar(), F.stddev_samp).alias("vol16"), W.rolling("samples", 12, 12, by_bar(), F.sum).cast("double").alias("sum12"))
    return rounded(got)


MSG = "m AS (SELECT user_id AS key, (epoch_us(ts) // 1000000) AS ts, value, event_id AS seq FROM events)"


def time_frame(name: str, seconds: int) -> str:
    return f"{name} AS (PARTITION BY key ORDER BY ts RANGE BETWEEN {seconds - 1} PRECEDING AND CURRENT ROW)"


@query(f"WITH {MSG}, r AS (SELECT seq, value, count(value) OVER w AS n, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS std FROM m WINDOW {time_frame('w', 86400)}) SELECT seq, round(CASE WHEN n >= 3 AND std > 0 THEN greatest(-8, least(8, (value - mean) / std)) END, 5) AS z FROM r")
def feat_time_roll_z(spark, sf_dir):
    return rounded(messages(spark, sf_dir).select("seq", W.time_z("value", DAY, 3, by_key()).alias("z")), 5)


@query(f"WITH {MSG}, r AS (SELECT seq, value, count(value) OVER w AS n, avg(value) OVER w AS mean, max(value) OVER w AS hi, min(value) OVER w AS lo FROM m WINDOW {time_frame('w', 14400)}) SELECT seq, round(CASE WHEN n >= 2 AND mean <> 0 THEN greatest(0, least(10, value / mean)) END, 6) AS ratio, round(CASE WHEN n >= 2 THEN hi END, 6) AS hi, round(CASE WHEN n >= 2 THEN lo END, 6) AS lo FROM r")
def feat_time_roll_ratio(spark, sf_dir):
    return rounded(messages(spark, sf_dir).select("seq", W.time_ratio("value", 4 * HOUR, 2, by_key()).alias("ratio"), W.rolling_time("value", 4 * HOUR, 2, by_key(), F.max).alias("hi"), W.rolling_time("value", 4 * HOUR, 2, by_key(), F.min).alias("lo")))


@query("""WITH e AS (SELECT event_id, (epoch_us(ts) // 1000000) AS s, make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS t FROM events), a AS (SELECT event_id, hour(t) * 2 * pi() / 24 AS h, minute(t) * 2 * pi() / 60 AS m, (isodow(t) - 1) * 2 * pi() / 7 AS d FROM e)
SELECT event_id, round(sin(h), 6) AS hour_sin, round(cos(h), 6) AS hour_cos, round(sin(m), 6) AS minute_sin, round(cos(m), 6) AS minute_cos, round(sin(d), 6) AS dow_sin, round(cos(d), 6) AS dow_cos FROM a""")
def feat_cyclic_time(spark, sf_dir):
    got = messages(spark, sf_dir).select(F.col("seq").alias("event_id"), *[c.alias(n) for n, c in S.time_features("ts").items()])
    return rounded(got)


@query("WITH e AS (SELECT event_id, value, (epoch_us(ts) // 1000000) AS t FROM events), f AS (SELECT *, 28800 - t % 28800 AS left_sec FROM e) SELECT event_id, left_sec, left_sec < 900 AS near_funding, round(value * CAST(left_sec < 900 AS INT), 6) AS funding_pressure FROM f")
def feat_funding_window(spark, sf_dir):
    left = S.to_next("ts", 8 * HOUR)
    got = messages(spark, sf_dir).select(F.col("seq").alias("event_id"), "value", left.alias("left_sec")).withColumn("near_funding", F.col("left_sec") < 900)
    pressure = F.col("value") * F.col("near_funding").cast("double")
    return rounded(got.select("event_id", "left_sec", "near_funding", pressure.alias("funding_pressure")))


@query(f"""WITH {SCORED}, v AS (SELECT stream, bar, CASE WHEN count(abs(ret)) OVER w8 >= 4 THEN avg(abs(ret)) OVER w8 END AS vol FROM scored WINDOW {frame('w8', 8)}),
q AS (SELECT *, CASE WHEN count(vol) OVER w >= 30 THEN quantile_cont(vol, 1.0/3) OVER w END AS lo, CASE WHEN count(vol) OVER w >= 30 THEN quantile_cont(vol, 2.0/3) OVER w END AS hi FROM v WINDOW {frame('w', 200)})
SELECT stream, bar, round(vol, 6) AS vol, CASE WHEN vol <= lo THEN 'low' WHEN vol >= hi THEN 'high' ELSE 'mid' END AS vol_regime FROM q""")
def feat_vol_regime_quantile(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("abs_ret", F.abs("ret")).withColumn("vol", W.rolling("abs_ret", 8, 4, by_bar()))
    marked = rows.withColumn("lo", W.quantile("vol", 1 / 3, 200, 30, by_bar())).withColumn("hi", W.quantile("vol", 2 / 3, 200, 30, by_bar()))
    regime = F.when(F.col("vol") <= F.col("lo"), "low").when(F.col("vol") >= F.col("hi"), "high").otherwise("mid")
    return rounded(marked.select("stream", "bar", "vol", regime.alias("vol_regime")))


@query(f"WITH {MSG}, r AS (SELECT seq, value, max(value) OVER w AS hi, min(value) OVER w AS lo FROM m WINDOW {time_frame('w', 86400)}) SELECT seq, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.5 END, 6) AS range_pos FROM r")
def feat_range_position(spark, sf_dir):
    """Runs on chunks of five days with a day of halo, so no key's history needs one task."""
    dealt = J.chunked(messages(spark, sf_dir), "ts", 5 * DAY, DAY)
    w = W.along("key", "chunk", by="ts")
    hi, lo = (W.rolling_time("value", DAY, 1, w, f) for f in (F.max, F.min))
    marked = dealt.withColumn("hi", hi).withColumn("lo", lo).filter("not halo")
    pos = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    return rounded(marked.select("seq", pos.alias("range_pos")))


@query(f"WITH {DAILY} SELECT stream, bar, round(ln(1 + buy_qty) - ln(1 + sell_qty), 6) AS pull_add, round(greatest(0, least(1, buy_qty / (buy_qty + sell_qty + 1e-9))), 6) AS buy_share, round(ln(1 + greatest(max - min, 0)), 6) AS range_log FROM daily")
def feat_log_ratios(spark, sf_dir):
    share = S.clip(F.col("buy_qty") / (F.col("buy_qty") + F.col("sell_qty") + S.EPS), 0.0, 1.0)
    return rounded(daily(spark, sf_dir).select("stream", "bar", (F.log1p("buy_qty") - F.log1p("sell_qty")).alias("pull_add"), share.alias("buy_share"), F.log1p(S.clip(F.col("max") - F.col("min"), 0.0)).alias("range_log")))


@query(f"""WITH {MSG}, t AS (SELECT m.*, m.ts - 86400 AS aim FROM m),
b AS (SELECT t.seq, t.aim, p.ts AS bts, p.value AS bv FROM t ASOF LEFT JOIN m p ON t.key = p.key AND t.aim >= p.ts),
a AS (SELECT t.seq, p.ts AS ats, p.value AS av FROM t ASOF LEFT JOIN m p ON t.key = p.key AND t.aim <= p.ts)
SELECT seq, round(CASE WHEN ats - aim <= 7200 AND (bts IS NULL OR ats - aim <= aim - bts) THEN av WHEN aim - bts <= 7200 THEN bv END, 6) AS past,
  CASE WHEN ats - aim <= 7200 AND (bts IS NULL OR ats - aim <= aim - bts) THEN ats WHEN aim - bts <= 7200 THEN bts END AS past_ts FROM b JOIN a USING (seq)""")
def asof_nearest_tolerance(spark, sf_dir):
    rows = messages(spark, sf_dir).select("key", "ts", "value", "seq")
    return rounded(J.nearest(rows, "value", ["key"], DAY, 2 * HOUR, "past", order="seq").select("seq", "past", "past_ts"))


@query("""WITH p AS (SELECT user_id AS key, (epoch_us(ts) // 1000000) AS ts, event_id AS seq FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id AS key, (epoch_us(ts) // 1000000) AS ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
j AS (SELECT p.seq, p.ts, v.ts AS vts, v.value FROM p ASOF LEFT JOIN v ON p.key = v.key AND p.ts >= v.ts)
SELECT seq, round(CASE WHEN ts - vts <= 43200 THEN value END, 6) AS value, CASE WHEN ts - vts <= 43200 THEN vts END AS value_ts FROM j""")
def asof_backward_stale(spark, sf_dir):
    rows = messages(spark, sf_dir)
    left = rows.filter("kind = 'purchase'").select("key", "ts", "seq")
    right = rows.filter("kind = 'view'").select("key", "ts", "value")
    return rounded(J.backward(left, right, "value", ["key"], 12 * HOUR).select("seq", "value", "value_ts"))


@query(f"WITH {SCORED} SELECT stream, bar, round(fwd, 6) AS delta, CASE WHEN fwd > 100 THEN 1 WHEN fwd < -100 THEN -1 ELSE 0 END AS label FROM scored WHERE fwd IS NOT NULL")
def label_direction(spark, sf_dir):
    rows = C.drop_tail(scored(spark, sf_dir).withColumn("delta", L.forward_delta("close", 1, by_bar())).withColumn("label", L.direction_label("close", 1, 100.0, by_bar())), ("stream",), "bar", 1)
    return rounded(rows.select("stream", "bar", "delta", "label"))


@query(f"""WITH {DAILY}, o AS (SELECT *, (close - lag(close) OVER w) / lag(close) OVER w AS one FROM daily WINDOW w AS (PARTITION BY stream ORDER BY bar)),
v AS (SELECT *, CASE WHEN count(one) OVER f >= 4 THEN stddev_samp(one) OVER f END AS vol, lead(close, 3) OVER w AS later, lead(bar, 3) OVER w AS nxt FROM o WINDOW {frame('f', 16)}, w AS (PARTITION BY stream ORDER BY bar))
SELECT stream, bar, round(CASE WHEN nxt - bar = 3 * 86400 AND vol > 0 THEN greatest(-5, least(5, (later - close) / close / vol)) END, 5) AS y FROM v""")
def label_volnorm(spark, sf_dir):
    return rounded(daily(spark, sf_dir).select("stream", "bar", L.vol_normalised("close", "bar", 3, DAY, 16, 4, by_bar()).alias("y")), 5)


@query(f"WITH {DAILY}, t AS (SELECT *, max(close) OVER w AS hi, min(close) OVER w AS lo FROM daily WINDOW w AS (PARTITION BY stream ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)) SELECT stream, bar, CAST(hi / close - 1 >= 0.2 AS INT) AS touch_up, CAST(lo / close - 1 <= -0.2 AS INT) AS touch_down FROM t")
def label_mfe_touch(spark, sf_dir):
    up, down = L.touch("close", 4, 0.2, by_bar())
    return daily(spark, sf_dir).select("stream", "bar", up.alias("touch_up"), down.alias("touch_down"))


def first(h: int, test: str, w: str = "w") -> str:
    """SQL of the first of h bars ahead that meets a test on x."""
    return "coalesce(least(" + ", ".join(f"CASE WHEN {test.replace('$x', f'(lead(close, {k}) OVER {w})')} THEN {k} END" for k in range(1, h + 1)) + f"), {h + 1})"


@query(f"WITH {DAILY}, t AS (SELECT stream, bar, {first(6, '$x / close - 1 >= 0.2')} AS k_up, {first(6, '$x / close - 1 <= -0.2')} AS k_down FROM daily WINDOW w AS (PARTITION BY stream ORDER BY bar)) SELECT stream, bar, k_up, k_down, CAST(k_up < k_down AS INT) AS touch_up, CAST(k_down < k_up AS INT) AS touch_down FROM t")
def label_first_touch(spark, sf_dir):
    return L.triple_barrier(daily(spark, sf_dir), "close", 6, 0.2, by_bar()).select("stream", "bar", "k_up", "k_down", "touch_up", "touch_down")


LABELLED = f"{SCORED}, lab AS (SELECT *, CASE WHEN fwd > 100 THEN 1 WHEN fwd < -100 THEN -1 ELSE 0 END AS label FROM scored WHERE fwd IS NOT NULL)"


def labelled(spark, sf_dir):
    return scored(spark, sf_dir).filter("fwd is not null").withColumn("label", S.direction("fwd", 100.0))


@query(f"WITH {LABELLED} SELECT label, count(*) AS n, round(avg(fwd), 5) AS mean_delta, round(stddev_samp(fwd), 5) AS std_delta, round(min(fwd), 5) AS min_delta, round(max(fwd), 5) AS max_delta, round(count(*) / (SELECT count(*) FROM lab), 5) AS share FROM lab GROUP BY label")
def class_distribution(spark, sf_dir):
    return rounded(L.class_spread(labelled(spark, sf_dir), "label", "fwd"), 5)


@query(f"""WITH {LABELLED}, l AS (SELECT label, unnest(['imb', 'score', 'samples']) AS feature, unnest([imb, score, samples]) AS x FROM lab),
m AS (SELECT feature, avg(x) FILTER (label = -1) AS mean_down, avg(x) FILTER (label = 0) AS mean_flat, avg(x) FILTER (label = 1) AS mean_up FROM l GROUP BY feature)
SELECT feature, {rsql('mean_down', 'mean_flat', 'mean_up')}, coalesce((mean_down < mean_flat AND mean_flat < mean_up) OR (mean_down > mean_flat AND mean_flat > mean_up), false) AS monotone FROM m""")
def mean_by_class(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("samples", F.col("samples").cast("double"))
    return rounded(L.mean_by_class(rows, "label", ["imb", "score", "samples"]))
