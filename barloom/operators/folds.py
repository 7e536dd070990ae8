"""Walk-forward folds, splits and scaling fitted on the past alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, keys: tuple[str, ...], ts: str, chunk: int = 30 * 86_400) -> DataFrame:
    """Adds i, the place in time from 0: the place within a chunk of time, after the rows of earlier chunks.

    One long history is so never sorted in one task; the table of chunks has a row for each.
    """
    cut = rows.withColumn("_c", F.floor(F.col(ts) / chunk))
    by = [*keys, "_c"]
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = cut.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, before.alias("_before"))
    inside = cut.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(ts)) - 1)
    return inside.join(chunks, by).withColumn("i", F.col("_before") + F.col("_k")).select(*rows.columns, "i")


def walk_forward(rows: DataFrame, keys: tuple[str, ...], folds: int, start: float, step: float, purge: int, val_share: float) -> DataFrame:
    """Bounds of expanding folds: a row for each key and fold, with ``purge`` rows between parts."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    grid = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    at = lambda f: F.floor(F.col("n") * (F.lit(start) + F.lit(step) * f)).cast("long")
    out = grid.withColumn("test_lo", at(F.col("fold"))).withColumn("test_hi", at(F.col("fold") + 1)).withColumn("val_hi", F.col("test_lo") - purge)
    out = out.withColumn("val_lo", F.floor(F.col("val_hi") * F.lit(1 - val_share)).cast("long"))
    return out.withColumn("train_hi", F.col("val_lo") - purge).drop("n")


def assigned(rows: DataFrame, bounds: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each row in each fold that uses it, with its part; purged rows have none. bounds has a row a fold."""
    i = F.col("i")
    part = F.when(i < F.col("train_hi"), "train").when((i >= F.col("val_lo")) & (i < F.col("val_hi")), "val").when((i >= F.col("test_lo")) & (i < F.col("test_hi")), "test")
    return rows.join(bounds, list(keys)).withColumn("part", part)


def chronological(rows: DataFrame, keys: tuple[str, ...], ts: str, share: float) -> DataFrame:
    """Adds train: whether a row is in the first share of its key's history."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("train", F.row_number().over(w.orderBy(ts)) <= F.floor(F.lit(share) * F.count("*").over(w)))


def standardised(rows: DataFrame, fitted_on: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less the mean, over the population deviation, of ``fitted_on``; a constant keeps scale 1."""
    got = fitted_on.agg(*[F.avg(c).alias(f"_a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    wide = rows.crossJoin(F.broadcast(got))  # one row
    put = {c: (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return wide.select(*[put[c].alias(c) if c in put else F.col(c) for c in rows.columns])


def lag_stack(columns: list[str], lags: list[int], w) -> list[Column]:
    """Lagged copies named base@lag."""
    return [F.lag(c, k).over(w).alias(f"{c}@{k}") for c in columns for k in lags]


def ensemble(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean of the seeds' scores, and whether all agree in sign."""
    s = F.signum(score)
    return scores.groupBy(*keys).agg(F.avg(score).alias(score), (F.abs(F.sum(s)) == F.count(score)).alias("unanimous"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (classes * count): weights that balance classes."""
    by = rows.groupBy(label).agg(F.count("*").alias("c"))
    total = by.agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    return by.crossJoin(F.broadcast(total)).select(label, "c", (F.col("n") / (F.col("k") * F.col("c"))).alias("weight"))
