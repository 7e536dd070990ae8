"""Market messages: schemas, parsing, a replaying stream source, and polling with backoff.

A live feed enters Spark as rows (us, feed, body): from Kafka, from files that a collector writes, or
from the replay source here. What follows parses the JSON bodies; nothing is parsed row by row in Python.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

PAIRS = "array<array<string>>"
#: Message bodies by feed.
SCHEMAS = {
    "depth": f"u long, pu long, b {PAIRS}, a {PAIRS}",
    "snapshot": f"lastUpdateId long, bids {PAIRS}, asks {PAIRS}, b {PAIRS}, a {PAIRS}",
    "trade": "p string, q string, m boolean, t long",
    "liquidation": "e string, o struct<S: string, q: string, ap: string, p: string>",
    "ticker": "b string, a string",
    "premium": "markPrice string, indexPrice string, lastFundingRate string, estimatedSettlePrice string, nextFundingTime long, time long",
}


def parsed(rows: DataFrame, feed: str, body: str = "body") -> DataFrame:
    """Messages of a feed with their fields; malformed ones are dropped.

    A depth message's first id differs from its last one by letter case alone, which columns don't tell
    apart: it becomes first_id.
    """
    mine = rows.filter(F.col("feed") == feed).withColumn("m", F.from_json(body, SCHEMAS[feed])).filter("m is not null")
    first = [F.get_json_object(body, "$.U").try_cast("long").alias("first_id")] if feed == "depth" else []
    return mine.select(*[c for c in rows.columns if c != body], "m.*", *first)


def number(c: str):
    return F.col(c).try_cast("decimal(20,8)")


def level_changes(depth: DataFrame, keys: list[str]) -> DataFrame:
    """One row per changed level: keys, side, price, qty, seq."""
    both = F.array(F.struct(F.lit("bid").alias("side"), F.col("b").alias("levels")), F.struct(F.lit("ask").alias("side"), F.col("a").alias("levels")))
    rows = depth.select(*keys, F.col("u").alias("seq"), F.explode(both).alias("x")).select(*keys, "seq", "x.side", F.explode("x.levels").alias("l"))
    return rows.select(*keys, "side", F.col("l")[0].try_cast("decimal(20,8)").cast("double").alias("price"), F.col("l")[1].try_cast("decimal(20,8)").cast("double").alias("qty"), "seq").filter("price is not null and qty is not null")


def snapshot_levels(snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """A snapshot under either naming of its sides, as changes at its update id."""
    same = snapshot.select(*keys, F.col("lastUpdateId").alias("u"), F.coalesce("b", "bids").alias("b"), F.coalesce("a", "asks").alias("a"))
    return level_changes(same, keys)


def trades(rows: DataFrame) -> DataFrame:
    """price, qty, side (+1 buy, -1 sell: the maker bought) and trade id."""
    return rows.withColumn("price", number("p").cast("double")).withColumn("qty", number("q").cast("double")).withColumn("side", F.when(F.col("m"), -1).otherwise(1)).withColumnRenamed("t", "trade_id").drop("p", "q", "m")


def liquidations(rows: DataFrame) -> DataFrame:
    """Side liquidated and notional: a sell closes a long; the average price, or the order's if that is missing or empty."""
    price = F.coalesce(F.nullif(F.col("o.ap"), F.lit("")), F.nullif(F.col("o.p"), F.lit("")), F.lit("0")).try_cast("decimal(20,8)")
    notional = (price * F.col("o.q").try_cast("decimal(20,8)")).cast("double")
    return rows.filter("o.q is not null").withColumn("liquidated", F.when(F.col("o.S") == "SELL", "long").otherwise("short")).withColumn("notional", notional).drop("o", "e")


def ticker_mid(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mid", ((number("b") + number("a")) / 2).cast("double")).drop("a", "b")


def premium(rows: DataFrame) -> DataFrame:
    """mark, index, funding, settle, spread in percent, and seconds to the next funding."""
    return rows.select(
        *[c for c in rows.columns if c not in ("markPrice", "indexPrice", "lastFundingRate", "estimatedSettlePrice", "nextFundingTime", "time")],
        number("markPrice").cast("double").alias("mark"),
        number("indexPrice").cast("double").alias("index"),
        number("lastFundingRate").cast("double").alias("funding"),
        number("estimatedSettlePrice").cast("double").alias("settle"),
        F.expr("try_divide(double(markPrice) - double(indexPrice), double(indexPrice)) * 100").alias("spread"),
        ((F.col("nextFundingTime") - F.col("time")) / 1000).alias("remaining_sec"),
    )


def batched(rows: DataFrame, us: str = "us", batch_us: int = 200_000, keys: tuple[str, ...] = ()) -> DataFrame:
    """Trades in short batches: sums and counts by side and the ordered sequence of (side, qty)."""
    return rows.groupBy(*keys, (F.floor(F.col(us) / batch_us) * batch_us).alias("batch")).agg(
        *[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("qty"))), F.lit(0.0)).alias(f"{n}_qty") for n, s in (("buy", 1), ("sell", -1))],
        *[F.count(F.when(F.col("side") == s, 1)).alias(f"{n}_samples") for n, s in (("buy", 1), ("sell", -1))],
        F.transform(F.array_sort(F.collect_list(F.struct(us, "trade_id", "side", "qty"))), lambda x: F.struct(x["side"].alias("side"), x["qty"].alias("qty"))).alias("trade_seq"),
    )


def with_backoff(fetch: Callable[[], str], tries: int = 8, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Calls fetch until it succeeds, waiting min(2^n, most) seconds after the n-th failure; for a driver-side poller."""
    for n in range(tries):
        try:
            return fetch()
        except OSError:
            if n == tries - 1:
                raise
            sleep(min(2.0**n, most))
    raise ValueError("no tries")


class ReplaySource(DataSource):
    """format("replay"): a JSON-lines file of {"us", "feed", "body"} as a stream, ``rows`` a micro-batch, each exactly once."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "us long, feed string, body string"

    def simpleStreamReader(self, schema) -> ReplayReader:
        return ReplayReader(self.options["path"], int(self.options.get("rows", "1000")))

    def reader(self, schema) -> DataSourceReader:
        return _Whole(self.options["path"])


class _Whole(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _lines(self.path, 0, None)


def _lines(path: str, start: int, stop: int | None) -> Iterator[tuple]:
    with open(path, encoding="utf-8") as f:
        for k, line in enumerate(f):
            if stop is not None and k >= stop:
                return
            if k >= start:
                row = json.loads(line)
                body = row["body"]
                yield row["us"], row["feed"], body if isinstance(body, str) else json.dumps(body)


class ReplayReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def initialOffset(self) -> dict:
        return {"line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        got = list(_lines(self.path, start["line"], start["line"] + self.rows))
        return iter(got), {"line": start["line"] + len(got)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return _lines(self.path, start["line"], end["line"])
