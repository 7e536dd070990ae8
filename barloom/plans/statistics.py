"""Scores of daily bars against what followed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as D
from ..operators import stats as T
from ..sources.tables import table
from .features import LABELLED, labelled
from .shared import SCORED, rounded, rsql, scored

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


LAGS = [0, 1, 2, 3, 4, 6, 8, 12]


@query(f"WITH {SCORED}, s AS (SELECT fwd, {', '.join(f'lag({f}, {k}) OVER w AS {f}_{k}' for f in ('imb', 'score') for k in LAGS)} FROM scored WINDOW w AS (PARTITION BY stream ORDER BY bar)) " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {k} AS lag, round(corr({f}_{k}, fwd), 6) AS corr FROM s" for f in ("imb", "score") for k in LAGS))
def lag_correlation_grid(spark, sf_dir):
    return rounded(T.lag_correlations(scored(spark, sf_dir), ["imb", "score"], "fwd", LAGS, ("stream",), "bar"))


IC = f"""{SCORED}, k AS (SELECT * FROM scored WHERE score IS NOT NULL AND ret IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY score) + (count(*) OVER (PARTITION BY period, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY period ORDER BY ret) + (count(*) OVER (PARTITION BY period, ret) - 1) / 2.0 AS b FROM k),
ic AS (SELECT period, count(*) AS n, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM rk GROUP BY period)"""


@query(f"WITH {IC} SELECT period, n, round(ic, 6) AS ic FROM ic")
def rank_ic_by_period(spark, sf_dir):
    return rounded(T.rank_ic(scored(spark, sf_dir), "score", "ret", ["period"]))


@query(f"WITH {IC}, d AS (SELECT ic FROM ic WHERE n >= 20 AND ic IS NOT NULL), s AS (SELECT count(*) AS days, avg(ic) AS mean_ic, stddev_samp(ic) / sqrt(count(*)) AS se FROM d) SELECT days, {rsql('mean_ic', 'se')}, round(CASE WHEN se > 0 THEN mean_ic / se END, 6) AS t FROM s")
def rank_ic_daily_t(spark, sf_dir):
    return rounded(T.ic_summary(T.rank_ic(scored(spark, sf_dir), "score", "ret", ["period"]), 20))


UP = f"{LABELLED}, u AS (SELECT *, CAST(label = 1 AS INT) AS up FROM lab WHERE score IS NOT NULL)"


def ups(spark, sf_dir):
    return labelled(spark, sf_dir).filter("score is not null").withColumn("up", (F.col("label") == 1).cast("int"))


@query(f"""WITH {UP}, g AS (SELECT stream, score, sum(up) AS p, count(*) AS c FROM u GROUP BY ALL),
s AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS k, sum(p) OVER (PARTITION BY stream) AS ap, sum(c) OVER (PARTITION BY stream) AS ac FROM g WINDOW w AS (PARTITION BY stream ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT stream, CAST(sum(c) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS positives, round(CASE WHEN any_value(ap) > 0 AND any_value(ap) < any_value(ac) THEN sum(p / ap * tp / k) END, 6) AS ap FROM s GROUP BY stream""")
def average_precision(spark, sf_dir):
    return rounded(T.average_precision(ups(spark, sf_dir), "score", "up", ["stream"]))


@query(f"""WITH {UP}, k AS (SELECT stream, up, rank() OVER (PARTITION BY stream ORDER BY score) + (count(*) OVER (PARTITION BY stream, score) - 1) / 2.0 AS rk FROM u),
a AS (SELECT stream, count(*) AS n, CAST(sum(up) AS BIGINT) AS positives, sum(rk) FILTER (up = 1) AS s FROM k GROUP BY stream), z AS (SELECT *, CASE WHEN positives > 0 AND n > positives THEN (s - positives * (positives + 1) / 2.0) / (positives * (n - positives)) END AS auc FROM a)
SELECT stream, n, positives, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS auc_any FROM z""")
def roc_auc(spark, sf_dir):
    return rounded(T.roc_auc(ups(spark, sf_dir), "score", "up", ["stream"]))


EDGES = "[" + ", ".join(f"{k / 5!r}" for k in range(1, 5)) + "]"


@query(f"""WITH {LABELLED}, k AS (SELECT score, label FROM lab WHERE score IS NOT NULL), e AS (SELECT quantile_cont(score, {EDGES}) AS q FROM k),
b AS (SELECT (score > q[1])::INT + (score > q[2])::INT + (score > q[3])::INT + (score > q[4])::INT AS b, label AS y FROM k, e), c AS (SELECT b, y, count(*) AS c FROM b GROUP BY ALL),
p AS (SELECT *, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY b) AS nb, sum(c) OVER (PARTITION BY y) AS ny FROM c) SELECT 'score' AS feature, CAST(sum(c) AS BIGINT) AS n, round(sum(c / n * ln(c * n / (nb * ny))), 6) AS mi FROM p""")
def binned_mutual_info(spark, sf_dir):
    return rounded(T.mutual_information(labelled(spark, sf_dir), "score", "label", 5))


CONF = f"{LABELLED}, conf AS (SELECT *, CASE WHEN score > 0.1 THEN 1 WHEN score < -0.1 THEN -1 ELSE 0 END AS guess, 0.33 + abs(score) * 0.6 AS confidence FROM lab WHERE score IS NOT NULL)"


def guessed(spark, sf_dir):
    rows = labelled(spark, sf_dir).filter("score is not null")
    return rows.withColumn("guess", F.when(F.col("score") > 0.1, 1).when(F.col("score") < -0.1, -1).otherwise(0)).withColumn("confidence", 0.33 + F.abs("score") * 0.6)


@query(f"""WITH {CONF}, b AS (SELECT CAST(floor((confidence - 0.33) / 0.05) AS INT) AS bucket, confidence, CAST(guess = label AS INT) AS ok FROM conf WHERE confidence >= 0.33),
g AS (SELECT bucket, count(*) AS n, avg(confidence) AS mean_conf, avg(ok) AS accuracy FROM b GROUP BY bucket HAVING count(*) >= 10)
SELECT bucket, n, {rsql('mean_conf', 'accuracy')}, round(0.33 + bucket * 0.05, 6) AS low, abs(accuracy - mean_conf) <= 0.05 AS fits FROM g""")
def calibration_buckets(spark, sf_dir):
    rows = guessed(spark, sf_dir).withColumn("ok", (F.col("guess") == F.col("label")).cast("int"))
    return rounded(T.calibration(rows, "confidence", "ok", 0.33, 0.05, 10))


@query(f"WITH {CONF} SELECT label AS truth, guess, count(*) AS n FROM conf GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return T.confusion(guessed(spark, sf_dir), "label", "guess")


@query(f"""WITH {CONF}, c AS (SELECT k AS class, count(*) FILTER (label = k AND guess = k) AS tp, count(*) FILTER (label = k) AS support, count(*) FILTER (guess = k) AS guessed FROM conf, (SELECT unnest([-1, 0, 1]) AS k) GROUP BY k HAVING count(*) FILTER (label = k OR guess = k) > 0),
p AS (SELECT *, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM c)
SELECT class, tp, support, guessed, {rsql('precision', 'recall')}, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM p""")
def class_report(spark, sf_dir):
    return rounded(T.class_report(guessed(spark, sf_dir), "label", "guess"))


@query(f"WITH {CONF}, c AS (SELECT label, count(*) AS n, count(*) FILTER (label = guess) AS hit FROM conf GROUP BY label), a AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(hit) / sum(n) AS accuracy, max(n) / sum(n) AS majority FROM c) SELECT n, {rsql('accuracy', 'majority')}, round(accuracy - majority, 6) AS lift FROM a")
def accuracy_lift(spark, sf_dir):
    return rounded(T.accuracy_lift(guessed(spark, sf_dir), "label", "guess"))


@query(f"""WITH {SCORED}, k AS (SELECT * FROM scored WHERE score IS NOT NULL AND ret IS NOT NULL),
e AS (SELECT stream, quantile_cont(ret, 0.1) AS t, quantile_cont(score, 0.05) AS q0, quantile_cont(score, 0.1) AS q1, quantile_cont(score, 0.2) AS q2 FROM k GROUP BY stream),
f AS (SELECT stream, CAST(ret <= t AS INT) AS bad, unnest([0.05, 0.1, 0.2]) AS pick, unnest([CAST(score <= q0 AS INT), CAST(score <= q1 AS INT), CAST(score <= q2 AS INT)]) AS hit FROM k JOIN e USING (stream)),
g AS (SELECT stream, CAST(pick AS DOUBLE) AS pick, count(*) AS n, CAST(sum(hit) AS BIGINT) AS picked, CAST(sum(bad) AS BIGINT) AS bad, CAST(sum(hit * bad) AS BIGINT) AS caught FROM f GROUP BY ALL)
SELECT stream, pick, n, picked, bad, caught, round(caught / bad, 6) AS capture, round((caught / picked) / (bad / n), 6) AS lift FROM g""")
def tail_capture_lift(spark, sf_dir):
    rows = scored(spark, sf_dir).filter("score is not null and ret is not null")
    return rounded(T.tail_capture(rows, "score", "ret", 0.1, [0.05, 0.1, 0.2], ["stream"]))


@query(f"""WITH {SCORED}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY bar) - 1 AS i, count(*) OVER (PARTITION BY stream) AS n FROM scored),
f AS (SELECT unnest(range(0, 4)) AS fold), b AS (SELECT stream, n, fold, CAST(floor(n * (CAST(0.4 AS DOUBLE) + CAST(0.15 AS DOUBLE) * fold)) AS BIGINT) AS test_lo, CAST(floor(n * (CAST(0.4 AS DOUBLE) + CAST(0.15 AS DOUBLE) * (fold + 1))) AS BIGINT) AS test_hi FROM (SELECT DISTINCT stream, n FROM n), f),
c AS (SELECT *, test_lo - 8 AS val_hi, CAST(floor((test_lo - 8) * CAST(0.9 AS DOUBLE)) AS BIGINT) AS val_lo FROM b)
SELECT stream, fold, count(*) FILTER (i < val_lo - 8) AS train, count(*) FILTER (i >= val_lo AND i < val_hi) AS val, count(*) FILTER (i >= test_lo AND i < test_hi) AS test, round(avg(score) FILTER (i >= test_lo AND i < test_hi), 6) AS test_score FROM n JOIN c USING (stream) GROUP BY stream, fold""")
def fold_purged_walkforward(spark, sf_dir):
    rows = D.numbered(scored(spark, sf_dir), ("stream",), "bar")
    bounds = D.walk_forward(rows, ("stream",), folds=4, start=0.4, step=0.15, purge=8, val_share=0.1)
    return rounded(D.assigned(rows, bounds, ("stream",)).groupBy("stream", "fold").agg(*[F.count(F.when(F.col("part") == p, 1)).alias(p) for p in ("train", "val", "test")], F.avg(F.when(F.col("part") == "test", F.col("score"))).alias("test_score")))


@query(f"WITH {SCORED}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY bar) AS i, count(*) OVER (PARTITION BY stream) AS n FROM scored) SELECT stream, CAST(i <= floor(CAST(0.7 AS DOUBLE) * n) AS BOOLEAN) AS train, count(*) AS rows, round(avg(imb), 6) AS mean_imb FROM n GROUP BY ALL")
def chronological_split(spark, sf_dir):
    return rounded(D.chronological(scored(spark, sf_dir), ("stream",), "bar", 0.7).groupBy("stream", "train").agg(F.count("*").alias("rows"), F.avg("imb").alias("mean_imb")))


@query(f"WITH {SCORED}, m AS (SELECT avg(imb) AS a, stddev_pop(imb) AS s FROM scored WHERE period < 600) SELECT stream, bar, round(CASE WHEN s > 0 THEN (imb - a) / s ELSE imb - a END, 5) AS imb FROM scored, m")
def standard_scaler(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rounded(D.standardised(rows.select("stream", "bar", "imb"), rows.filter("period < 600"), ["imb"]), 5)


@query("WITH b AS (SELECT split_part(p_type, ' ', 1) AS base, sum(p_retailprice) AS importance FROM part GROUP BY 1) SELECT base, round(importance, 4) AS importance, round(importance / sum(importance) OVER (), 6) AS share, base IN ('PROMO', 'SMALL') AS fresh FROM b")
def importance_by_base(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat(F.split("p_type", " ")[0], F.lit("@"), F.col("p_size")).alias("name"), "p_retailprice")
    got = T.importance_by_base(part, "name", "p_retailprice", ["PROMO", "SMALL"])
    return got.select("base", F.round("importance", 4).alias("importance"), F.round("share", 6).alias("share"), "fresh")


@query(f"WITH {SCORED}, k AS (SELECT stream, period, ret, row_number() OVER (PARTITION BY stream ORDER BY ret DESC NULLS LAST, bar) AS place FROM scored) SELECT stream, period, place, round(ret, 6) AS ret FROM k WHERE place <= 10")
def top_moves(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("stream").orderBy(F.col("ret").desc_nulls_last(), "bar"))
    return rounded(scored(spark, sf_dir).withColumn("place", place).filter("place <= 10").select("stream", "period", "place", "ret"))


@query(f"""WITH {SCORED}, d AS (SELECT period, sum(ret) AS s, count(ret) AS c, row_number() OVER (ORDER BY period) - 1 AS k FROM scored WHERE ret IS NOT NULL GROUP BY period), t AS (SELECT count(*) AS days, sum(s) / sum(c) AS mean FROM d),
p AS (SELECT draw, CAST(floor(('0x' || substr(md5('0-' || draw || '-' || slot), 1, 8))::BIGINT / 4294967296.0 * days) AS INT) AS k FROM t, range(1, 501) a(draw), (SELECT unnest(range(1, days + 1)) AS slot FROM t) b), m AS (SELECT draw, sum(s) / sum(c) AS m FROM p JOIN d USING (k) GROUP BY draw)
SELECT round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, any_value(days) AS days, round(any_value(mean), 6) AS mean FROM m, t""")
def bootstrap_day_cluster(spark, sf_dir):
    return rounded(T.day_bootstrap(scored(spark, sf_dir), "ret", "period", draws=500))


@query(f"""WITH {UP}, c AS (SELECT stream, CAST(sum(CAST((score > 0) = (fwd > 0) AS INT)) AS BIGINT) AS hits, count(*) AS n FROM u GROUP BY stream)
SELECT stream, hits, n, round(least(1.0, list_sum(list_transform(range(hits, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + n * ln(0.5))))), 6) AS p_value FROM c""")
def binomial_test(spark, sf_dir):
    rows = ups(spark, sf_dir).withColumn("hit", ((F.col("score") > 0) == (F.col("fwd") > 0)).cast("int"))
    counts = rows.groupBy("stream").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    from ..workers import reachable

    reachable(spark)
    return rounded(T.binomial_tail(counts, "hits", "n"))
