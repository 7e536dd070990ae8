"""Sources and sinks: tables written as bar files or messages, read back through the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..workers import shared_folder
from ..sources import files, messages
from ..sources.tables import table
from .shared import DAILY, daily, rounded, rsql

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query(f"WITH {DAILY} SELECT stream, bar, {rsql('close', 'buy_qty')}, CAST(samples AS DOUBLE) AS samples FROM daily")
def source_bar_files(spark, sf_dir):
    """Bars written as rolled, gzipped text by stream, then found and read by groups of equal header."""
    top = f"{shared_folder(spark).rstrip('/')}/bars-{uuid.uuid4().hex}"
    bars = daily(spark, sf_dir).withColumn("spot_datetime", F.date_format(F.timestamp_seconds(F.col("bar") + F.ascii("stream")), "yyyy-MM-dd HH:mm:ss"))
    files.write_bars(bars.select("spot_datetime", "stream", "bar", "close", "buy_qty", "samples").withColumn("code", F.ascii("stream").cast("double")).drop("stream"), top, lines=2000, gzip=True)
    got = files.typed(files.read_bars(spark, files.find_files(spark, top, recursive=True)))
    return got.select(F.chr(F.col("code").cast("int")).alias("stream"), F.col("bar").cast("long").alias("bar"), F.round("close", 6).alias("close"), F.round("buy_qty", 6).alias("buy_qty"), "samples")


def feed(df, name: str, body):
    return df.select(F.lit(1).cast("long").alias("us"), F.lit(name).alias("feed"), body.alias("body"))


@query("SELECT round(l_extendedprice, 6) AS price, round(l_quantity, 6) AS qty, CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END AS side, l_orderkey AS trade_id FROM lineitem")
def source_trade_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    body = F.to_json(F.struct(F.col("l_extendedprice").cast("decimal(20,8)").cast("string").alias("p"), F.col("l_quantity").cast("string").alias("q"), (F.col("l_linestatus") == "F").alias("m"), F.col("l_orderkey").alias("t")))
    return rounded(messages.trades(messages.parsed(feed(rows, "trade", body), "trade")).select("price", "qty", "side", "trade_id"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'long' ELSE 'short' END AS liquidated, round(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 2.5 END * (o_orderkey % 7), 4) AS notional FROM orders")
def source_liquidations(spark, sf_dir):
    """The average price counts, the order's price where that is empty."""
    rows = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("decimal(20,8)").cast("string")).otherwise("")
    order = F.struct(F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY").alias("S"), (F.col("o_orderkey") % 7).cast("string").alias("q"), price.alias("ap"), F.lit("2.5").alias("p"))
    body = F.to_json(F.struct(F.lit("forceOrder").alias("e"), order.alias("o")))
    return rounded(messages.liquidations(messages.parsed(feed(rows, "liquidation", body), "liquidation")).select("liquidated", "notional"), 4)


@query("SELECT round(p_retailprice, 6) AS mark, round((p_retailprice - (1000.0 + p_size)) / (1000.0 + p_size) * 100, 5) AS spread, CAST(p_size AS DOUBLE) AS remaining_sec FROM part")
def source_premium(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    text = lambda c: c.cast("decimal(20,8)").cast("string")
    body = F.to_json(F.struct(text(F.col("p_retailprice")).alias("markPrice"), text(F.col("p_size") + 1000.0).alias("indexPrice"), F.lit("0.0001").alias("lastFundingRate"), F.lit("0").alias("estimatedSettlePrice"), (F.col("p_size") * 1000 + 5000).cast("long").alias("nextFundingTime"), F.lit(5000).cast("long").alias("time")))
    got = messages.premium(messages.parsed(feed(rows, "premium", body), "premium"))
    return got.select(F.round("mark", 6).alias("mark"), F.round("spread", 5).alias("spread"), "remaining_sec")


@query("SELECT round((s_acctbal + s_suppkey) / 2, 6) AS mid FROM supplier")
def source_ticker_mid(spark, sf_dir):
    body = F.to_json(F.struct(F.col("s_acctbal").cast("decimal(20,8)").cast("string").alias("b"), F.col("s_suppkey").cast("string").alias("a")))
    return rounded(messages.ticker_mid(messages.parsed(feed(table(spark, sf_dir, "supplier"), "ticker", body), "ticker")).select("mid"))


@query("SELECT 'bid' AS side, CAST(event_id AS DOUBLE) AS price, round(value, 6) AS qty, event_id AS seq FROM events UNION ALL SELECT 'ask', CAST(event_id + 1 AS DOUBLE), 0.0, event_id FROM events")
def source_depth_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    level = lambda p, q: F.array(F.array(p, q))
    body = F.to_json(F.struct(F.col("event_id").alias("U"), F.col("event_id").alias("w"), level(F.col("event_id").cast("string"), F.col("value").cast("string")).alias("b"), level((F.col("event_id") + 1).cast("string"), F.lit("0")).alias("a")))
    depth = messages.parsed(feed(rows, "depth", F.regexp_replace(body, '"w":', '"u":')), "depth")
    return rounded(messages.level_changes(depth, []).select("side", "price", "qty", "seq"))


@query("SELECT epoch_us(ts) // 200000 * 200000 AS batch, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 6) AS buy_qty, round(coalesce(sum(value) FILTER (event_type <> 'purchase'), 0), 6) AS sell_qty, count(*) FILTER (event_type = 'purchase') AS buy_samples, count(*) FILTER (event_type <> 'purchase') AS sell_samples, count(*) AS trades FROM events GROUP BY 1")
def source_trade_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("side"), F.col("value").alias("qty"), F.col("event_id").alias("trade_id"))
    return rounded(messages.batched(rows).withColumn("trades", F.size("trade_seq").cast("long")).drop("trade_seq"))
