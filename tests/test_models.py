"""Windows by size, folds by group, and bounds frozen on validation rows."""

from barloom.operators import cleaning as C
from barloom.operators import models as O
from barloom.operators import simulation as X
from barloom.operators import stats as T


def test_windows_are_sized_by_the_rows():
    assert O.sized(1000) == (200, 50)
    assert O.sized(1_200_000) == (11764, 11764 // 4 if 11764 // 4 > (1_200_000 - 2 * 11764) // 100 else (1_200_000 - 2 * 11764) // 100)
    window, step = O.sized(600, most=3)
    assert (window, step) == (200, 66)
    assert O.windows(600, 200, 200, 66) == [(0, 200, 400), (66, 266, 466), (132, 332, 532), (198, 398, 598)]


def test_too_few_rows_fill_no_window(spark):
    rows = spark.createDataFrame([(k, 0.1 * k, k % 3 - 1) for k in range(20)], "ts long, x double, y int")
    assert O.rolling(rows, "ts", ["x"], "y").count() == 0


def test_groups_are_scored_by_models_that_never_saw_them(spark):
    rows = spark.createDataFrame([(k, k % 9, float(k % 2) + 0.001 * (k % 7), None if k == 5 else 1.0, k % 2) for k in range(180)], "id int, day long, x double, z double, y int")
    got = O.grouped_scores(rows, "day", ["x", "z"], "y")
    assert got.count() == 180
    assert max(r["c"] for r in got.groupBy("day").agg({"fold": "max"}).withColumnRenamed("max(fold)", "c").collect()) < 5
    assert all(r["n"] == 1 for r in got.select("day", "fold").distinct().groupBy("day").count().withColumnRenamed("count", "n").collect())
    assert T.roc_auc(got.selectExpr("*", "1 as pool"), "p", "y", ["pool"]).first()["auc"] > 0.99


def test_one_class_or_no_rows_give_no_score(spark):
    rows = spark.createDataFrame([(k, float(k), 1) for k in range(10)], "day long, x double, y int")
    assert {r["p"] for r in O.grouped_scores(rows, "day", ["x"], "y").collect()} == {None}
    assert O.grouped_scores(rows.limit(0), "day", ["x"], "y").count() == 0


def test_a_frozen_bound_ignores_test_rows(spark):
    rows = spark.createDataFrame([("val", float(k)) for k in range(11)] + [("test", 100.0), ("test", 7.0), ("test", 8.5), ("test", 0.0)], "part string, s double").selectExpr("'a' as k", "*")
    assert sorted(r["s"] for r in X.frozen_trigger(rows, "part", "s", 0.2, ["k"]).collect()) == [8.5, 100.0]
    assert [r["s"] for r in X.frozen_trigger(rows, "part", "s", 0.2, ["k"], low=True).collect()] == [0.0]


def test_null_losses_rank_the_worst_column(spark):
    rows = spark.createDataFrame([(1.0, None), (None, None), (3.0, 1.0), (4.0, 2.0)], "a double, b double")
    got = {r["column"]: r for r in C.null_losses(rows, ["a", "b"]).collect()}
    assert (got["b"]["worst"], got["b"]["null_share"], got["a"]["null_share"], got["a"]["lost_share"], got["a"]["warn"]) == (1, 0.5, 0.25, 0.5, True)
    assert C.without_nulls(rows, ["a", "b"]).count() == 2
    assert {r["null_share"] for r in C.null_losses(rows.limit(0), ["a", "b"]).collect()} == {1.0}
