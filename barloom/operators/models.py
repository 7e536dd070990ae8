"""Model operators: any model is a score column; these fit the ones Spark has, on the past alone."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import class_weights, numbered, standardised
from .stats import accuracy_lift


def assembled(rows: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip").transform(rows)


def as_classes(rows: DataFrame, label: str) -> DataFrame:
    """-1, 0, 1 to 0, 1, 2."""
    return rows.withColumn("_y", (F.col(label) + 1).cast("double"))


def logistic(train: DataFrame, test: DataFrame, features: list[str], label: str, c: float = 0.1) -> DataFrame:
    """Balanced multinomial logistic regression on features scaled by the training rows; test with guess and confidence."""
    a, b = standardised(train, train, features), standardised(test, train, features)
    a = a.join(F.broadcast(class_weights(train, label).select(label, "weight")), label)  # a row a class
    n = max(a.count(), 1)
    model = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="weight", regParam=1.0 / (c * n), maxIter=50, family="multinomial").fit(assembled(as_classes(a, label), features))
    return _guessed(model.transform(assembled(as_classes(b, label), features)))


def trees(train: DataFrame, test: DataFrame, features: list[str], label: str, n: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    model = RandomForestClassifier(featuresCol="features", labelCol="_y", numTrees=n, maxDepth=depth, seed=seed).fit(assembled(as_classes(train, label), features))
    return _guessed(model.transform(assembled(as_classes(test, label), features)))


def boosted(train: DataFrame, test: DataFrame, features: list[str], label: str, rounds: int = 10, depth: int = 3, seed: int = 42) -> DataFrame:
    """Gradient-boosted trees, one against the rest, since the built-in ones tell two classes."""
    one = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)
    model = OneVsRest(classifier=one, featuresCol="features", labelCol="_y").fit(assembled(as_classes(train, label), features))
    return model.transform(assembled(as_classes(test, label), features)).withColumn("guess", (F.col("prediction") - 1).cast("int"))


def boosted_regression(train: DataFrame, test: DataFrame, features: list[str], target: str, rounds: int = 10, depth: int = 3, seed: int = 42, out: str = "forecast") -> DataFrame:
    """Test rows with the forecast."""
    model = GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed).fit(assembled(train.filter(F.col(target).isNotNull()), features))
    return model.transform(assembled(test, features)).withColumnRenamed("prediction", out)


def _guessed(scored: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return scored.withColumn("guess", (F.col("prediction") - 1).cast("int")).withColumn("confidence", F.array_max(vector_to_array("probability")))


def majority(rows: DataFrame, label: str) -> DataFrame:
    return rows.agg(F.mode(label, True).alias("guess"))


def windows(n: int, train: int, test: int, step: int) -> list[tuple[int, int, int]]:
    """Bounds (start, split, end) of rolling windows over n rows: plain numbers, no rows."""
    return [(a, a + train, a + train + test) for a in range(0, max(0, n - train - test) + 1, step) if a + train + test <= n]


def sized(n: int, window: int = 0, most: int = 100) -> tuple[int, int]:
    """Rows of a window and of a step that keep n rows near ``most`` windows: 200 rows and a quarter of a window at least."""
    window = window or max(200, n // (most + 2))
    return window, max(1, window // 4, (n - 2 * window) // most)


def rolling(rows: DataFrame, ts: str, features: list[str], label: str, train: int = 0, test: int = 0, step: int = 0, fit=logistic, most: int = 100) -> DataFrame:
    """Accuracy, majority share and lift in each rolling window; rows are numbered once, each window is a range.

    Without ``train``, windows and steps are sized by the rows. No row comes back where they fill no window.
    """
    placed = numbered(rows, (), ts).persist()
    try:
        n = placed.count()
        if not train:
            train, step = sized(n, 0, most)
            test = train
        out = accuracy_lift(rows.limit(0).withColumn("guess", F.col(label)), label, "guess").withColumn("window", F.lit(0)).limit(0)
        for k, (a, m, z) in enumerate(windows(n, train, test, step)):
            part = fit(placed.filter((F.col("i") >= a) & (F.col("i") < m)), placed.filter((F.col("i") >= m) & (F.col("i") < z)), features, label)
            out = out.unionByName(accuracy_lift(part, label, "guess").withColumn("window", F.lit(k)))
        return out
    finally:
        placed.unpersist()


def rolling_wins(rows: DataFrame, ts: str, sets: dict[str, list[str]], label: str, fit=logistic, most: int = 100) -> DataFrame:
    """Feature sets over the same rolling windows of the rows that have every feature: mean accuracy and lift, and windows won outright."""
    same = rows.na.drop(subset=sorted({f for fs in sets.values() for f in fs}))
    parts = [rolling(same, ts, fs, label, fit=fit, most=most).withColumn("features", F.lit(name)) for name, fs in sets.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    w = Window.partitionBy("window")
    best = F.max("accuracy").over(w)
    marked = both.withColumn("_top", (F.col("accuracy") == best).cast("int")).withColumn("_win", F.when(F.sum("_top").over(w) == 1, F.col("_top")).otherwise(0))
    return marked.groupBy("features").agg(F.count("*").alias("windows"), F.avg("accuracy").alias("accuracy"), F.avg("lift").alias("lift"), F.sum("_win").alias("wins"))


def grouped_scores(rows: DataFrame, group: str, features: list[str], label: str, folds: int = 5, c: float = 0.5, out: str = "p") -> DataFrame:
    """Rows with the probability of label 1 from a balanced logistic fit on the other folds; a group is in one fold alone.

    Null features count as 0. The probability is null where the other folds lack a class.
    """
    from pyspark.ml.functions import vector_to_array

    placed = rows.na.fill(0.0, features).withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int"))
    cells = {(r["fold"], r[label]): r["n"] for r in placed.groupBy("fold", label).agg(F.count("*").alias("n")).collect()}  # a row a fold and class
    done = None
    for k in sorted({f for f, _ in cells}):
        seen = {y: sum(n for (f, z), n in cells.items() if f != k and z == y) for y in (0, 1)}
        test = placed.filter(F.col("fold") == k)
        if min(seen.values()) == 0:
            got = test.withColumn(out, F.lit(None).cast("double"))
        else:
            train = placed.filter(F.col("fold") != k)
            weight = F.when(F.col(label) == 1, sum(seen.values()) / (2 * seen[1])).otherwise(sum(seen.values()) / (2 * seen[0]))
            fitted = assembled(standardised(train, train, features).withColumn("weight", weight).withColumn("_y", F.col(label).cast("double")), features, "_x")
            model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="weight", regParam=1.0 / (c * sum(seen.values())), maxIter=50).fit(fitted)
            got = model.transform(assembled(standardised(test, train, features), features, "_x")).withColumn(out, vector_to_array("probability")[1])
        got = got.select(*rows.columns, "fold", out)
        done = got if done is None else done.unionByName(got)
    return done if done is not None else placed.withColumn(out, F.lit(None).cast("double"))


def by_regime(rows: DataFrame, regime: str, regimes: list[str], ts: str, features: list[str], label: str, share: float = 0.7, fit=logistic) -> DataFrame:
    """The same model in each regime: fitted on the first share of its rows, judged on the rest."""
    out = None
    for name in regimes:
        part = rows.filter(F.col(regime) == name)
        n = part.count()
        if n < 20:
            continue
        placed = numbered(part, (), ts)
        cut = int(share * n)
        got = accuracy_lift(fit(placed.filter(F.col("i") < cut), placed.filter(F.col("i") >= cut), features, label), label, "guess").withColumn("regime", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out
