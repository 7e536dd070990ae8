"""Models over daily bars: rows-only, since fits are iterative."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import along, rolling
from ..operators import models as O
from ..operators import stats as T
from .features import labelled
from .shared import rounded
from .simulations import orders

QUERIES, ORACLE = {}, {}
FEATURES = ["imb", "score", "vol"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def prepared(spark, sf_dir):
    w = along("stream", by="bar")
    rows = labelled(spark, sf_dir).withColumn("move", F.abs(F.col("close") / F.col("open") - 1)).withColumn("vol", rolling("move", 8, 4, w))
    split = rows.agg(F.percentile("bar", F.lit(0.7)).alias("split")).first()["split"] or 0  # one number
    return rows.filter("score is not null and vol is not null").select("stream", "bar", "period", "label", "ret", *FEATURES), split


@query
def model_logistic(spark, sf_dir):
    rows, split = prepared(spark, sf_dir)
    return rounded(T.accuracy_lift(O.logistic(rows.filter(F.col("bar") <= split), rows.filter(F.col("bar") > split), FEATURES, "label"), "label", "guess"), 4)


@query
def model_forest(spark, sf_dir):
    rows, split = prepared(spark, sf_dir)
    return T.confusion(O.trees(rows.filter(F.col("bar") <= split), rows.filter(F.col("bar") > split), FEATURES, "label"), "label", "guess")


@query
def model_boosted_regression(spark, sf_dir):
    rows, split = prepared(spark, sf_dir)
    got = O.boosted_regression(rows.filter(F.col("bar") <= split), rows.filter(F.col("bar") > split), FEATURES, "ret", rounds=5)
    return rounded(T.rank_ic(got.select("period", "ret", "forecast"), "forecast", "ret", ["period"]), 4)


def in_line(rows):
    """Bars of all streams in one order: by time, then stream."""
    return rows.withColumn("at", F.col("bar") + F.ascii("stream"))


@query
def model_rolling_windows(spark, sf_dir):
    rows, _ = prepared(spark, sf_dir)
    return rounded(O.rolling(in_line(rows), "at", FEATURES, "label", most=4), 4)


@query
def model_rolling_wins(spark, sf_dir):
    """The bar's own imbalance against all features, over the same windows."""
    rows, _ = prepared(spark, sf_dir)
    return rounded(O.rolling_wins(in_line(rows), "at", {"imb": ["imb"], "all": FEATURES}, "label", most=3), 4)


@query
def fill_split_grouped_auc(spark, sf_dir):
    """Whether a model that never saw a period tells its filled orders from its missed ones: one area over all held-out rows."""
    rows = orders(spark, sf_dir).filter("filled is not null").withColumn("y", F.col("filled").cast("int"))
    held = O.grouped_scores(rows.select("stream", "bar", "period", "y", "imb", "score", "buy_qty", "sell_qty"), "period", ["imb", "score", "buy_qty", "sell_qty"], "y")
    auc = T.roc_auc(held.withColumn("pool", F.lit("all")), "p", "y", ["pool"]).drop("auc_any", "pool")
    return rounded(auc.withColumn("verdict", F.when(F.col("auc") >= 0.58, "signal").when(F.col("auc") >= 0.54, "weak").otherwise("none")), 4)


@query
def model_by_regime(spark, sf_dir):
    rows, _ = prepared(spark, sf_dir)
    edges = rows.agg(F.percentile("vol", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("e"))
    marked = rows.crossJoin(F.broadcast(edges)).withColumn("regime", F.when(F.col("vol") <= F.col("e")[0], "low").when(F.col("vol") > F.col("e")[1], "high").otherwise("mid")).drop("e")  # one row of edges
    return rounded(O.by_regime(marked, "regime", ["low", "mid", "high"], "bar", FEATURES, "label"), 4)


@query
def model_feature_sets(spark, sf_dir):
    """Accuracy on the same rows with and without the rolling features."""
    rows, split = prepared(spark, sf_dir)
    train, test = rows.filter(F.col("bar") <= split), rows.filter(F.col("bar") > split)
    parts = [T.accuracy_lift(O.logistic(train, test, f, "label"), "label", "guess").withColumn("features", F.lit("+".join(f))) for f in (["imb"], FEATURES)]
    return rounded(parts[0].unionByName(parts[1]), 4)
