"""Statistics of scores against outcomes. Each is one or two grouped aggregations over ranked rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hashed
from ..functions.windows import tie_rank


def lag_correlations(rows: DataFrame, features: list[str], target: str, lags: list[int], keys: tuple[str, ...], ts: str) -> DataFrame:
    """Pearson correlation of each feature, k rows earlier, with the target: all pairs in one pass over one sort."""
    w = Window.partitionBy(*keys).orderBy(ts)
    pairs = [(f, k) for f in features for k in lags]
    shifted = rows.select(F.col(target).alias("_t"), *[F.lag(f, k).over(w).alias(f"_{f}_{k}") for f, k in pairs])
    got = shifted.agg(*[F.corr(f"_{f}_{k}", "_t").alias(f"_{f}_{k}") for f, k in pairs])
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("lag"), F.col(f"_{f}_{k}").alias("corr")) for f, k in pairs])
    return got.select(F.explode(items).alias("x")).select("x.*")


def rank_ic(rows: DataFrame, score: str, outcome: str, keys: list[str]) -> DataFrame:
    """Spearman correlation within each key: average-tie ranks, then Pearson."""
    there = rows.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    ranked = there.withColumn("_a", tie_rank(score, *keys)).withColumn("_b", tie_rank(outcome, *keys))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("ic"))


def ic_summary(daily: DataFrame, least: int) -> DataFrame:
    """Mean, standard error and t of the daily coefficients of days with enough rows."""
    d = daily.filter((F.col("n") >= least) & F.col("ic").isNotNull())
    got = d.agg(F.count("*").alias("days"), F.avg("ic").alias("mean_ic"), (F.stddev_samp("ic") / F.sqrt(F.count("*"))).alias("se"))
    return got.withColumn("t", F.when(F.col("se") > 0, F.col("mean_ic") / F.col("se")))


def average_precision(rows: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """Sum over distinct scores, falling, of the recall gained times the precision there; null without both classes."""
    by = rows.groupBy(*keys, score).agg(F.sum(label).alias("_p"), F.count("*").alias("_c"))
    down = Window.partitionBy(*keys).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    seen = by.withColumn("_tp", F.sum("_p").over(down)).withColumn("_k", F.sum("_c").over(down)).withColumn("_all_p", F.sum("_p").over(whole)).withColumn("_all_c", F.sum("_c").over(whole))
    proper = (F.first("_all_p") > 0) & (F.first("_all_p") < F.first("_all_c"))
    return seen.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum("_p").alias("positives"), F.when(proper, F.sum(F.col("_p") / F.nullif("_all_p", F.lit(0)) * F.col("_tp") / F.col("_k"))).alias("ap"))


def roc_auc(rows: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """Mann-Whitney area from average-tie ranks, and the area of the better direction."""
    ranked = rows.filter(F.col(score).isNotNull()).withColumn("_r", tie_rank(score, *keys))
    pos, n = F.sum(label), F.count("*")
    got = ranked.groupBy(*keys).agg(n.alias("n"), pos.alias("positives"), F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("_s"))
    p, m = F.col("positives"), F.col("n") - F.col("positives")
    got = got.withColumn("auc", F.when((p > 0) & (m > 0), (F.col("_s") - p * (p + 1) / 2) / (p * m))).drop("_s")
    return got.withColumn("auc_any", F.greatest("auc", 1 - F.col("auc")))


def mutual_information(rows: DataFrame, feature: str, label: str, bins: int) -> DataFrame:
    """Mutual information in nats of a feature in equal-count bins and a class; a binned estimate."""
    there = rows.filter(F.col(feature).isNotNull() & F.col(label).isNotNull())
    edges = there.agg(F.percentile(feature, F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("e"))
    binned = there.crossJoin(F.broadcast(edges)).select(F.aggregate("e", F.lit(0), lambda a, x: a + F.when(F.col(feature) > x, 1).otherwise(0)).alias("b"), F.col(label).alias("y"))  # one row of edges
    cells = binned.groupBy("b", "y").agg(F.count("*").alias("c"))
    n, nb, ny = (F.sum("c").over(Window.partitionBy(*k)) for k in ((F.lit(1),), ("b",), ("y",)))
    parts = cells.withColumn("n", n).withColumn("nb", nb).withColumn("ny", ny)
    return parts.agg(F.lit(feature).alias("feature"), F.sum("c").alias("n"), F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("nb") * F.col("ny")))).alias("mi"))


def calibration(rows: DataFrame, confidence: str, correct: str, start: float, width: float, least: int) -> DataFrame:
    """Accuracy by bucket of confidence, for buckets with enough rows, and whether it fits the bucket's mean within 0.05."""
    k = F.floor((F.col(confidence) - F.lit(start)) / F.lit(width)).cast("int")
    by = rows.filter(F.col(confidence) >= start).groupBy(k.alias("bucket")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_conf"), F.avg(correct).alias("accuracy")).filter(F.col("n") >= least)
    return by.withColumn("low", F.lit(start) + F.col("bucket") * F.lit(width)).withColumn("fits", F.abs(F.col("accuracy") - F.col("mean_conf")) <= 0.05)


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def class_report(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1 of each class from the confusion counts."""
    cells = confusion(rows, truth, guess)
    both = F.explode(F.array_distinct(F.array("truth", "guess")))
    by = cells.select("*", both.alias("class")).groupBy("class").agg(
        F.sum(F.when((F.col("truth") == F.col("class")) & (F.col("guess") == F.col("class")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("truth") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("guess") == F.col("class"), F.col("n")).otherwise(0)).alias("guessed"),
    )
    p, r = F.when(F.col("guessed") > 0, F.col("tp") / F.col("guessed")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return by.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def accuracy_lift(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, that of always guessing the commonest class, and the difference."""
    cells = rows.groupBy(truth).agg(F.count("*").alias("n"), F.sum((F.col(truth) == F.col(guess)).cast("int")).alias("hit"))
    got = cells.agg(F.sum("n").alias("n"), (F.sum("hit") / F.sum("n")).alias("accuracy"), (F.max("n") / F.sum("n")).alias("majority"))
    return got.withColumn("lift", F.col("accuracy") - F.col("majority"))


def tail_capture(rows: DataFrame, score: str, outcome: str, tail: float, picks: list[float], keys: list[str]) -> DataFrame:
    """Within each key, how far the lowest scores gather the lowest outcomes: share captured and lift for each cut."""
    qs = sorted({tail, *picks})
    edges = rows.groupBy(*keys).agg(F.percentile(outcome, F.lit(tail)).alias("_tail"), *[F.percentile(score, F.lit(q)).alias(f"_q{k}") for k, q in enumerate(qs)])
    both = rows.join(edges, keys)
    bad = (F.col(outcome) <= F.col("_tail")).cast("int")
    items = F.array(*[F.struct(F.lit(q).alias("pick"), F.col(f"_q{qs.index(q)}").alias("edge")) for q in picks])
    flagged = both.select(*keys, bad.alias("bad"), F.col(score).alias("s"), F.explode(items).alias("x"))
    hit = (F.col("s") <= F.col("x.edge")).cast("int")
    got = flagged.groupBy(*keys, "x.pick").agg(F.count("*").alias("n"), F.sum(hit).alias("picked"), F.sum("bad").alias("bad"), F.sum(hit * F.col("bad")).alias("caught"))
    base, rate = F.col("bad") / F.col("n"), F.col("caught") / F.col("picked")
    return got.withColumn("capture", F.when(F.col("bad") > 0, F.col("caught") / F.col("bad"))).withColumn("lift", F.when((F.col("picked") > 0) & (F.col("bad") > 0), rate / base))


def binomial_tail(rows: DataFrame, hits: str, n: str, p: float = 0.5) -> DataFrame:
    """One-sided exact probability of at least so many hits, for few rows of counts."""

    def tail(h: pd.Series, m: pd.Series) -> pd.Series:
        def one(k: int, t: int) -> float:
            return min(1.0, math.fsum(math.exp(math.lgamma(t + 1) - math.lgamma(j + 1) - math.lgamma(t - j + 1) + j * math.log(p) + (t - j) * math.log1p(-p)) for j in range(k, t + 1)))

        return pd.Series([one(int(a), int(b)) for a, b in zip(h, m, strict=True)])

    return rows.withColumn("p_value", F.pandas_udf(tail, "double")(hits, n))


def day_bootstrap(rows: DataFrame, value: str, day: str, draws: int = 2000, seed: int = 0, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Interval of a mean by drawing whole days with replacement, seeded by hashes.

    Rows shrink to (sum, count) by day first; a draw picks as many days as there are.
    """
    by = rows.filter(F.col(value).isNotNull()).groupBy(day).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    numbered = by.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(day)) - 1)  # a row per day
    total = numbered.agg(F.count("*").alias("days"), (F.sum("s") / F.sum("c")).alias("mean"))
    picks = total.select("days", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select("days", "draw", F.explode(F.expr("sequence(1, int(greatest(days, 1)))")).alias("slot"))
    picked = picks.select("draw", F.floor(hashed(F.lit(seed), F.col("draw"), F.col("slot")) * F.col("days")).cast("int").alias("k"))
    means = picked.join(numbered, "k").groupBy("draw").agg((F.sum("s") / F.sum("c")).alias("m"))
    return means.agg(F.percentile("m", F.lit(low)).alias("ci_low"), F.percentile("m", F.lit(high)).alias("ci_high")).crossJoin(total)


def importance_by_base(rows: DataFrame, name: str, value: str, fresh: list[str]) -> DataFrame:
    """Importance of lagged features ("base@lag") summed to their base, its share, and whether the base is new."""
    by = rows.groupBy(F.split(name, "@")[0].alias("base")).agg(F.sum(value).alias("importance"))
    return by.withColumn("share", F.col("importance") / F.sum("importance").over(Window.partitionBy(F.lit(1)))).withColumn("fresh", F.col("base").isin(fresh))


def quantile_bins(c: str, edges: Column) -> Column:
    """How many edges lie below the value."""
    return F.aggregate(edges, F.lit(0), lambda a, x: a + F.when(F.col(c) > x, 1).otherwise(0))
