"""Cleaning: first of duplicates, sentinels, coverage of columns, validity of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import decoded
from ..functions.windows import along, contiguous


def first_of(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first by an explicit order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def decode_sentinels(rows: DataFrame, prefix: str = "opt_", sentinel: float = -1.0) -> DataFrame:
    """Null for the sentinel in every column of the prefix."""
    return rows.select(*[decoded(c, sentinel).alias(c) if c.startswith(prefix) else F.col(c) for c in rows.columns])


def column_coverage(rows: DataFrame, columns: list[str], least: float = 0.6) -> DataFrame:
    """One row per column: its share of values and whether that reaches ``least``; one pass."""
    got = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    items = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) / F.greatest("n", F.lit(1))).alias("share")) for c in columns])
    return got.select(F.explode(items).alias("x")).select("x.column", "x.share", (F.col("x.share") >= least).alias("kept"))


def guarded(rows: DataFrame, columns: list[str], least: float = 0.6) -> DataFrame:
    """Drops columns below the coverage."""
    kept = {r["column"] for r in column_coverage(rows, columns, least).collect() if r["kept"]}  # a row per column
    return rows.drop(*[c for c in columns if c not in kept])


def sample_valid(rows: DataFrame, keys: tuple[str, ...], ts: str, back: int, ahead: int, step: int, finite: list[str]) -> DataFrame:
    """Adds valid: contiguous back and ahead, with all targets there."""
    ok = contiguous(ts, back, ahead, step, along(*keys, by=ts))
    for c in finite:
        ok = ok & F.col(c).isNotNull()
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False)))


def recent(rows: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of the last days before the latest one: the maximum is a single value."""
    latest = rows.agg(F.max(ts).alias("_latest"))
    return rows.crossJoin(F.broadcast(latest)).filter(F.col(ts) >= F.col("_latest") - days * 86_400).drop("_latest")


def era(rows: DataFrame, ts: str, marker: str, least_days: float = 0) -> DataFrame:
    """Rows from the first that has the marker; an error if they span fewer days."""
    start = rows.filter(F.col(marker).isNotNull()).agg(F.min(ts).alias("_start"))
    out = rows.crossJoin(F.broadcast(start)).filter(F.col(ts) >= F.col("_start")).drop("_start")  # one row
    if least_days:
        ends = out.agg(F.min(ts).alias("a"), F.max(ts).alias("z")).first()
        if ends["a"] is None or ends["z"] - ends["a"] < least_days * 86_400:
            raise ValueError(f"the era has fewer than {least_days} days")
    return out


def without_nulls(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in each of the columns; ``null_losses`` tells what that costs."""
    return rows.na.drop(subset=columns)


def null_losses(rows: DataFrame, columns: list[str], most: float = 0.05) -> DataFrame:
    """One row per column: its share of nulls, its place among the worst, the share of rows that ``without_nulls`` drops, and whether that is above ``most``; one pass. Without rows every share of nulls is 1 and nothing is lost."""
    some = F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0))
    got = rows.agg(F.count("*").alias("n"), F.sum(some).alias("_lost"), *[F.count(c).alias(c) for c in columns])
    n = F.greatest("n", F.lit(1))
    items = F.array(*[F.struct(F.lit(c).alias("column"), (1 - F.col(c) / n).alias("null_share")) for c in columns])
    each = got.select("n", (F.coalesce("_lost", F.lit(0)) / n).alias("lost_share"), F.explode(items).alias("x")).select("x.*", "lost_share")
    worst = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("null_share").desc(), "column"))  # a row per column
    return each.withColumn("worst", worst).withColumn("warn", F.col("lost_share") > most)


def with_close(rows: DataFrame, closes: tuple[str, str] = ("bid_close", "ask_close"), medians: tuple[str, str] = ("bid_median", "ask_median")) -> DataFrame:
    """Adds close, the mean of both sides' closes, or of their medians where the schema lacks the closes."""
    a, b = closes if set(closes) <= set(rows.columns) else medians
    return rows.withColumn("close", (F.col(a) + F.col(b)) / 2)


def schema_mix(rows: DataFrame, version: str = "schema_version") -> DataFrame:
    """Rows and share of each schema version."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy(version).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(version, "n", (F.col("n") / F.col("total")).alias("share"))


def drop_tail(rows: DataFrame, keys: tuple[str, ...], ts: str, horizon: int) -> DataFrame:
    """Without the last ``horizon`` rows of each key."""
    return rows.withColumn("_next", F.lead(ts, horizon).over(along(*keys, by=ts))).filter("_next is not null").drop("_next")
