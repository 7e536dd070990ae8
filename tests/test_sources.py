"""Bar files, messages, streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from barloom.operators.book import best, state_at
from barloom.sources import files, grammar, messages
from barloom.streaming.book import live_book


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "out5.w5.a.csv").write_text("spot_datetime;x;opt_a\n2026-01-01 00:00:00;1;2\nspot_datetime;x;opt_a\n2026-01-01 00:00:05;bad;-1\nnever;3;3\n")
    (tmp_path / "out5.w5.b.csv").write_text("opt_a;spot_datetime;y\n7;2026-01-01 00:00:05;8\n9;2026-01-01 00:00:10;NaN\n")
    (tmp_path / "out5.w15.c.csv").write_text("spot_datetime;x\n2026-01-01 00:00:15;5\n")
    (tmp_path / "out5.w5.d.csv").write_text("other;x\n1;2\n")
    with gzip.open(tmp_path / "out5.w5.e.csv.gz", "wt") as f:
        f.write("spot_datetime;x;opt_a\n2026-01-01 00:00:20;4;4\n")
    return str(tmp_path)


def test_files_of_several_headers(spark, folder):
    found = files.find_files(spark, folder, cadence=5)
    assert [f.rpartition("/")[2] for f in found] == ["out5.w5.a.csv", "out5.w5.b.csv", "out5.w5.d.csv", "out5.w5.e.csv.gz"]
    got = files.typed(files.read_bars(spark, found)).orderBy("spot_datetime").collect()
    assert [(str(r["spot_datetime"])[-2:], r["x"], r["opt_a"], r["y"]) for r in got] == [("00", 1.0, 2.0, None), ("05", None, -1.0, None), ("10", None, 9.0, None), ("20", 4.0, 4.0, None)]
    assert files.read_bars(spark, found, ["x"]).columns == ["spot_datetime", "x", "_file"]
    with pytest.raises(ValueError):
        files.read_bars(spark, found, strict=True)


def test_written_bars_come_back(spark, tmp_path):
    df = spark.range(10).select(F.date_format(F.timestamp_seconds(F.col("id") * 5), "yyyy-MM-dd HH:mm:ss").alias("spot_datetime"), F.col("id").cast("double").alias("x"))
    files.write_bars(df.coalesce(1), f"{tmp_path}/out", lines=4, gzip=True)
    found = files.find_files(spark, f"{tmp_path}/out")
    assert len(found) == 3 and files.lines_per_file(15) == 960
    assert files.typed(files.read_bars(spark, found)).count() == 10


def test_grammar():
    g = grammar.Grammar()
    assert g.columns()[:2] == ["spot_datetime", "future_datetime"] and g.columns()[-1] == "schema_version"
    assert len(set(g.columns())) == len(g.columns())
    assert "bid" in grammar.series_of(g.columns(), "spot") and "bid_liq_0.1" not in grammar.series_of(g.columns(), "spot")


def test_messages(spark):
    raw = [
        (1, "depth", '{"U":1,"u":2,"b":[["99","5"],["98","7"]],"a":[["101","2"]]}'),
        (2, "depth", '{"U":3,"u":4,"b":[["99","0"]],"a":[]}'),
        (3, "trade", '{"p":"10","q":"2","m":true,"t":7}'),
        (4, "liquidation", '{"e":"x","o":{"S":"SELL","q":"2","ap":"","p":"5"}}'),
        (5, "liquidation", '{"e":"x","o":{"S":"BUY","q":"2","ap":"0","p":"5"}}'),
        (6, "premium", '{"markPrice":"101","indexPrice":"100","lastFundingRate":"0.1","estimatedSettlePrice":"9","nextFundingTime":5000,"time":2000}'),
        (7, "trade", "no json"),
    ]
    df = spark.createDataFrame(raw, "us long, feed string, body string")
    changes = messages.level_changes(messages.parsed(df, "depth").withColumn("key", F.lit(1)), ["key"])
    assert best(state_at(changes, ["key"]), ["key"]).first()["best_bid"] == 98.0
    t = messages.trades(messages.parsed(df, "trade")).filter("price is not null").first()
    assert (t["side"], t["qty"], t["trade_id"]) == (-1, 2.0, 7)
    assert [(r["liquidated"], r["notional"]) for r in messages.liquidations(messages.parsed(df, "liquidation")).orderBy("us").collect()] == [("long", 10.0), ("short", 0.0)]
    p = messages.premium(messages.parsed(df, "premium")).first()
    assert (p["spread"], p["remaining_sec"]) == (1.0, 3.0)
    b = messages.batched(messages.trades(messages.parsed(df, "trade")).filter("price is not null")).first()
    assert b["sell_qty"] == 2.0 and b["trade_seq"][0]["side"] == -1


def test_backoff_waits_longer_each_time():
    waits, left = [], [3]

    def fetch():
        left[0] -= 1
        if left[0]:
            raise OSError
        return "ok"

    assert messages.with_backoff(fetch, sleep=waits.append) == "ok" and waits == [1.0, 2.0]


def test_replayed_stream_builds_the_book(spark, tmp_path):
    lines = [{"us": k, "feed": "depth", "body": {"U": k, "u": k, "b": [[str(90 + k % 5), str(k % 3)]], "a": [["101", "1"]]}} for k in range(1, 40)]
    (tmp_path / "feed.jsonl").write_text("\n".join(map(json.dumps, lines)))
    spark.dataSource.register(messages.ReplaySource)
    source = {"path": f"{tmp_path}/feed.jsonl", "rows": "10"}
    batch = messages.level_changes(messages.parsed(spark.read.format("replay").options(**source).load(), "depth").withColumn("book", F.lit(1).cast("long")), ["book"])
    want = best(state_at(batch, ["book"]), ["book"]).first()
    rows = messages.parsed(spark.readStream.format("replay").options(**source).load(), "depth").withColumn("book", F.lit(1).cast("long"))
    changes = messages.level_changes(rows, ["book"]).withColumn("seq", F.col("seq") * 2 + F.when(F.col("side") == "ask", 1).otherwise(0))
    q = live_book(changes).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy(F.col("seq").desc()).first()
    assert (got["best_bid"], got["bid_qty"], got["best_ask"]) == (want["best_bid"], want["bid_qty"], want["best_ask"])


def test_files_of_one_name_keep_their_own_headers(spark, tmp_path):
    import gzip

    for folder, header, row in (("a", "spot_datetime;x;y", "2024-01-01 00:00:00;1;2"), ("b", "spot_datetime;y;x", "2024-01-01 00:00:15;3;4")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part-0.csv").write_text(f"{header}\n{row}\n")
        with gzip.open(tmp_path / folder / "part-1.csv.gz", "wt") as f:
            f.write(f"{header}\n{row.replace('00:00:', '01:00:')}\n")
    (tmp_path / "a" / "empty.csv").write_text("")
    from barloom.sources import files

    got = files.read_bars(spark, files.find_files(spark, str(tmp_path), recursive=True)).orderBy("spot_datetime").collect()
    assert [(r["x"], r["y"]) for r in got] == [("1", "2"), ("4", "3"), ("1", "2"), ("4", "3")]
