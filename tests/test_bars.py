"""Hand cases and properties of bars, merges, labels and books."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.operators import bars as B
from barloom.operators import book as K
from barloom.operators import cleaning as C
from barloom.operators import joins as J
from barloom.operators import labels as L
from barloom.operators import merge as M
from barloom.operators import simulation as X
from barloom.operators import stats as T


def tape(spark, rows):
    """rows: (ts, price, qty, side)."""
    got = [("a", t, float(p), float(q), s, k) for k, (t, p, q, s) in enumerate(rows)]
    return spark.createDataFrame(got, "stream string, ts long, price double, qty double, side int, seq long").withColumn("mid", F.col("price"))


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def random_tape(spark, n, seed):
    rng = random.Random(seed)
    return tape(spark, sorted((rng.randrange(0, 240), rng.choice([9, 10, 11, 12]), rng.randrange(1, 9), rng.choice([1, -1])) for _ in range(n)))


def test_single_trade_is_early_in_a_bar_and_late_after_a_merge(spark):
    bars = B.trade_sequence(tape(spark, [(0, 10, 3, 1)]), 5)
    assert rows(bars)[0]["early_buy_qty"] == 3.0
    assert rows(M.halves(bars, 15))[0] | {} == {"stream": "a", "out": 0, "early_buy_qty": 0.0, "late_buy_qty": 3.0, "early_sell_qty": 0.0, "late_sell_qty": 0.0, "early_buy_count": 0.0, "late_buy_count": 1.0, "early_sell_count": 0.0, "late_sell_count": 0.0}


def test_two_samples_have_no_volatility(spark):
    got = rows(B.mid_volatility(tape(spark, [(0, 10, 1, 1), (1, 12, 1, 1)]), 5))[0]
    assert (got["mid_std"], got["mid_rv"], got["mid_flips"]) == (0.0, 0.0, 0)


def test_lower_weighted_median(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 9.0, 2), ("b", 5.0, 0)], "k string, v double, w long")
    assert rows(M.weighted_median(df, ["k"], "v", "w", "m")) == [{"k": "a", "m": 2.0}]


@pytest.mark.parametrize("seed", range(3))
def test_merging_equals_building_wide(spark, seed):
    t = random_tape(spark, 120, seed)
    wide, narrow = B.sufficient(t, 60), B.sufficient(t, 5)
    pick = lambda df, *c: [{k: (round(v, 6) if isinstance(v, float) else v) for k, v in r.items() if k in c} for r in rows(df, "bar" if "bar" in df.columns else "out")]
    assert pick(M.flips(narrow, 60), "flips", "first_sign", "last_sign") == pick(wide, "flips", "first_sign", "last_sign")
    assert pick(M.realised_variance(narrow, 60), "rv") == pick(wide, "rv")
    assert pick(M.variance(narrow, 60), "mid_m2", "samples") == pick(wide, "mid_m2", "samples")
    runs = ("buy_sweep", "sell_sweep", "lead_side", "lead_qty", "tail_side", "tail_qty")
    assert pick(M.stitched_runs(B.runs(t, 5), 60), *runs) == pick(B.runs(t, 60), *runs)


def test_merging_twice_equals_merging_once(spark):
    t = random_tape(spark, 150, 9)
    bars = B.bars(t, 5, *B.side_stats()).select("stream", "bar", "buy_samples", "buy_qty")
    mid = M.additive(bars, 15).withColumnRenamed("out", "bar")
    assert rows(M.additive(mid, 60), "out") == rows(M.additive(bars, 60), "out")


def test_merge_refuses_unknown_columns_and_widths(spark):
    with pytest.raises(ValueError):
        M.additive(spark.createDataFrame([("a", 0, 1.0)], "stream string, bar long, odd double"), 60)
    with pytest.raises(ValueError):
        M.check_multiple(5, 12)
    assert M.check_multiple(5, 15) == 3


def closes(spark, values, step=5):
    return spark.createDataFrame([("a", k * step, float(v)) for k, v in enumerate(values)], "stream string, ts long, close double")


def test_first_touch_hand_case(spark):
    df = closes(spark, [100, 99.75, 100.40])
    got = rows(L.triple_barrier(df, "close", 2, 0.002, W.along("stream")), "ts")[0]
    assert (got["touch_up"], got["touch_down"]) == (0, 1)


def test_first_touch_against_brute_force(spark):
    rng = random.Random(3)
    values = [100 + rng.gauss(0, 1) for _ in range(300)]
    got = rows(L.triple_barrier(closes(spark, values), "close", 5, 0.01, W.along("stream")), "ts")
    for i, r in enumerate(got):
        path = [v / values[i] - 1 for v in values[i + 1 : i + 6]]
        up = next((k for k, x in enumerate(path, 1) if x >= 0.01), 6)
        down = next((k for k, x in enumerate(path, 1) if x <= -0.01), 6)
        assert (r["k_up"], r["k_down"], r["touch_up"], r["touch_down"]) == (up, down, int(up < down), int(down < up))


def test_exit_has_one_reason_within_the_horizon(spark):
    rng = random.Random(5)
    df = closes(spark, [100 + rng.gauss(0, 2) for _ in range(200)])
    got = rows(X.tp_sl(df, "close", F.lit(1), 6, 0.02, 0.02, 5.0, 2.0, W.along("stream")), "ts")
    for i, r in enumerate(got):
        assert r["exit_reason"] in ("tp", "sl", "time") and 1 <= r["exit_k"] <= 6
        assert (r["net_bps"] is None) == (i + 6 >= len(got))


def test_unfilled_order_has_no_result(spark):
    df = closes(spark, [100, 101, 102, 103, 104, 105, 106])
    got = rows(X.maker_fill(df, "close", F.lit(1), 4, 2, 0, 0.01, 0.02, 0.02, 2.0, 5.0, W.along("stream")), "ts")[0]
    assert (got["filled"], got["net_bps"], got["exit_reason"]) == (False, None, "unfilled")


def test_features_do_not_look_ahead(spark):
    rng = random.Random(1)
    whole = closes(spark, [rng.random() for _ in range(60)])
    roll = lambda df: rows(df.withColumn("r", W.rolling("close", 4, 2, W.along("stream"))).withColumn("z", W.time_z("close", 40, 3, W.along("stream"))), "ts")
    assert roll(whole)[:30] == roll(whole.filter("ts < 150"))


def test_time_frames_are_left_open(spark):
    got = rows(closes(spark, [1, 2, 3, 4]).withColumn("m", W.rolling_time("close", 10, 1, W.along("stream"))), "ts")
    assert [r["m"] for r in got] == [1.0, 1.5, 2.5, 3.5]


def test_nearest_prefers_the_later_of_equals(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 10, 2.0), ("a", 25, 3.0)], "k string, ts long, v double")
    assert [r["past"] for r in rows(J.nearest(df, "v", ["k"], 20, 10, "past"), "ts")] == [None, 1.0, 2.0]


def test_halo_gives_the_windows_of_the_whole(spark):
    rng = random.Random(2)
    df = closes(spark, [rng.random() for _ in range(200)])
    whole = rows(df.withColumn("m", W.rolling_time("close", 60, 1, W.along("stream"))).select("ts", "m"), "ts")
    parts = J.chunked(df, "ts", 100, 60).withColumn("m", W.rolling_time("close", 60, 1, W.along("stream", "chunk"))).filter("not halo").select("ts", "m")
    assert rows(parts, "ts") == whole


def test_gaps_in_chunks(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 5, 10, 400, 405, 2000)], "k string, ts long")
    got = rows(J.gaps(df, "ts", 5, 500, ("k",), chunk=100))[0]
    assert (got["n"], got["breaks"], got["long_gaps"], got["missing_sec"], got["longest_gap"]) == (6, 2, 1, 385 + 1590, 1595)


def test_book_deletes_and_walls(spark):
    df = spark.createDataFrame([(1, "bid", 99.0, 5.0, 1), (1, "bid", 98.0, 7.0, 2), (1, "bid", 99.0, 0.0, 3), (1, "ask", 101.0, 2.0, 4)], "key int, side string, price double, qty double, seq long")
    levels = K.state_at(df, ["key"])
    assert rows(K.best(levels, ["key"]))[0] == {"key": 1, "best_bid": 98.0, "bid_qty": 7.0, "best_ask": 101.0, "ask_qty": 2.0}
    none = K.walls(levels.filter("side = 'bid'"), ["key"], 0.3)
    assert rows(none)[0]["ask_wall_qty"] == 0.0 and rows(none)[0]["ask_wall_dist"] == -1.0


def test_sequence_audit(spark):
    df = spark.createDataFrame([(1, 1, 1, 3), (1, 2, 4, 6), (1, 3, 2, 5), (1, 4, 10, 12)], "k int, at int, first long, last long")
    assert [(r["status"], r["missed"]) for r in rows(K.sequence_audit(df, ("k",), "at", "first", "last"), "at")] == [("start", 0), ("ok", 0), ("stale", 0), ("gap", 3)]


def test_ties_share_their_rank_and_degenerate_classes_give_null(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 0.5, 0), (1, 0.9, 1), (2, 0.1, 0)], "k int, s double, y int")
    auc = {r["k"]: r["auc"] for r in T.roc_auc(df, "s", "y", ["k"]).collect()}
    assert auc == {1: 0.75, 2: None}
    ap = {r["k"]: r["ap"] for r in T.average_precision(df, "s", "y", ["k"]).collect()}
    assert ap[2] is None and ap[1] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_overlay_leaves_and_comes_back(spark):
    score = [0, 0, -1, -1, -1, 0, 0, 0, 0, -1, 0, 0]
    base = [1, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1]  # asked again under a bad score: vetoed, then back
    df = spark.createDataFrame([("a", 5 * k, b, float(s), 10.0) for k, (s, b) in enumerate(zip(score, base, strict=True))], "stream string, ts long, base int, score double, price double")
    got = rows(X.overlay(df, ("stream",), "ts", "base", "score", "price", 5, 0.5, 0.5, 2, 2), "ts")
    assert [r["position"] for r in got] == [1, 1, 1, 0, 0, 1, 1, 1, 0, 0, 1, 0]
    assert [r["turn_overlay"] for r in got] == [0, 0, 0, 10, 0, 10, 0, 0, 0, 0, 10, 0]
    assert [r["turn_base"] for r in got] == [10, 0, 0, 0, 0, 0, 0, 0, 10, 0, 0, 10]


def test_non_overlapping_is_greedy(spark):
    df = spark.createDataFrame([("a", 0, 10, 1.0), ("a", 5, 12, 2.0), ("a", 10, 11, 3.0), ("a", 11, 20, 4.0)], "k string, ts long, until long, v double")
    assert [r["v"] for r in rows(X.non_overlapping(df, ("k",), "ts", "until", "v"), "ts")] == [1.0, 3.0, 4.0]


def test_cleaning(spark):
    df = spark.createDataFrame([(0, -1.0, None), (1, 2.0, 1.0), (2, 3.0, 1.0)], "ts long, opt_a double, b double")
    assert [r["opt_a"] for r in rows(C.decode_sentinels(df), "ts")] == [None, 2.0, 3.0]
    assert C.guarded(df, ["opt_a", "b"], 0.7).columns == ["ts", "opt_a"]
    assert C.era(df, "ts", "b").count() == 2
    with pytest.raises(ValueError):
        C.era(df, "ts", "b", least_days=1)
    assert C.recent(df, "ts", 0).count() == 1


def test_empty_tables(spark):
    none = tape(spark, [(0, 1, 1, 1)]).limit(0)
    for df in (B.bars(none, 5, *B.six_stats("mid", "seq"), *B.side_stats()), B.runs(none, 5), B.sufficient(none, 5), B.trade_sequence(none, 5), M.flips(B.sufficient(none, 5), 60)):
        assert df.count() == 0


def test_window_partitions_follow_keys(spark):
    df = closes(spark, [1, 2]).unionByName(closes(spark, [9, 9]).withColumn("stream", F.lit("b")))
    got = df.withColumn("d", W.diff("close", 1, W.along("stream"))).withColumn("n", F.count("*").over(Window.partitionBy("stream")))
    assert [r["d"] for r in rows(got, "stream", "ts")] == [None, 1.0, None, 0.0]


def test_nearest_among_rows_of_one_time(spark):
    """The last of them from behind, the first from ahead, in whatever order the rows come."""
    got = [("a", 100, 1.0, 1), ("a", 100, 2.0, 2), ("a", 100, 3.0, 3), ("a", 210, 4.0, 4), ("a", 195, 5.0, 5), ("a", 200, 6.0, 6)]
    for some in (got, got[::-1]):
        df = spark.createDataFrame(some, "k string, ts long, v double, seq long").coalesce(1)
        near = {r["seq"]: r["past"] for r in rows(J.nearest(df, "v", ["k"], 100, 20, "past", order="seq"))}
        assert near == {1: None, 2: None, 3: None, 4: 3.0, 5: 1.0, 6: 1.0}
