"""Streaming queries over replayed events; each ends when all is read and returns what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..workers import shared_folder
from ..streaming.bars import run_now, stream_bars
from ..streaming.book import live_book
from .book import BEST
from .shared import rounded

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def replay(spark, sf_dir: str):
    """The events table as a file stream, whether it is a file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH e AS (SELECT (epoch_us(ts) // 1000000) // 3600 * 3600 AS bar, event_type, value, ts FROM events)
SELECT bar, event_type, count(*) AS n, round(sum(value), 6) AS total, round(max(value), 6) AS most FROM e GROUP BY bar, event_type HAVING (bar + 3600) * 1000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM events)""")
def stream_bar_equivalence(spark, sf_dir):
    """Hourly bars that the watermark has closed; the SQL takes them from the whole table."""
    aggregates = [F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")]
    bars = stream_bars(replay(spark, sf_dir), "ts", "1 hour", "10 minutes", aggregates, ["event_type"])
    out = folder(spark, "stream-bars")
    run_now(bars, f"{out}/data", f"{out}/state")
    return rounded(spark.read.schema(bars.schema).parquet(f"{out}/data"))


@query(f"WITH {BEST} SELECT b.book, (SELECT max(seq) FROM changes c WHERE c.book = b.book) AS seq, CAST(best_bid AS DOUBLE) AS best_bid, round(bid_qty, 6) AS bid_qty, CAST(best_ask AS DOUBLE) AS best_ask, round(ask_qty, 6) AS ask_qty, (SELECT count(*) FROM levels l WHERE l.book = b.book) AS n_levels FROM best b")
def stream_book_state(spark, sf_dir):
    """The book after the last change, kept in keyed state; the SQL takes the last change of each level."""
    rows = replay(spark, sf_dir).withColumn("level", F.from_json("props", "k long").getField("k")).filter("level is not null")
    bid = F.col("event_id") % 2 == 0
    changes = rows.select(
        (F.col("user_id") % 5).alias("book"),
        F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, 1000.0 - F.col("level")).otherwise(1000.5 + F.col("level")).alias("price"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("qty"),
        F.col("event_id").alias("seq"),
    )
    out = folder(spark, "stream-book")
    live_book(changes).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{out}/data")).trigger(availableNow=True).start().awaitTermination()
    told = spark.read.parquet(f"{out}/data")
    return rounded(told.groupBy("book").agg(F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in ("best_bid", "bid_qty", "best_ask", "ask_qty", "n_levels")]))
