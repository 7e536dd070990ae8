"""The feature catalogue: complete, null where columns lack, and without a look ahead."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import catalogue as C

WIDTH = 900


def table(spark, n=300, drop=()):
    rng = random.Random(1)
    names = sorted({c for sql in [*C.point_features("future", "spot", "0.05", "0.4").values(), *(s for _, s, _ in C.rolled_features("future").values())] for c in C.needs(sql)} | {"spot_bid_close", "spot_ask_close", "opt_eth_mid_open", "opt_eth_mid_close", "opt_open_interest_sample", "opt_funding_rate_sample"})
    names = [c for c in names if c not in drop]
    price, rows = 100.0, []
    for k in range(n):
        price *= math.exp(rng.gauss(0, 0.01))
        rows.append(("a", k * WIDTH + (5 * WIDTH if k > 200 else 0), price, *(rng.uniform(0.5, 2) for _ in names)))
    return spark.createDataFrame(rows, ", ".join(["stream string, ts long, close_price double", *(f"`{c}` double" for c in names)]))


def test_every_feature_comes_out(spark):
    got = C.features(table(spark), WIDTH)
    assert len(got.columns) - 3 >= 76 and len(set(got.columns)) == len(got.columns)
    last = got.orderBy(F.col("ts").desc()).first().asDict()
    assert [c for c, v in last.items() if v is None] == []
    assert all(-8 <= last[c] <= 8 for c in ("ofi_z", "ret_norm_1h", "basis_z_4h")) and 0 <= last["range_pos_24h"] <= 1


def test_missing_columns_give_null(spark):
    got = C.features(table(spark, 20, drop=("future_ofi_sum", "opt_eth_mid_open", "opt_long_force_exit_qty_sum")), WIDTH).first().asDict()
    assert got["ofi_z"] is None and got["eth_ret_z"] is None and got["liq_imbal"] is not None


def test_rows_do_not_see_the_future(spark):
    whole = table(spark, 120)
    a = {r["ts"]: r for r in C.features(whole, WIDTH).collect()}
    for r in C.features(whole.filter("ts < 60 * 900"), WIDTH).collect():
        assert all(x == y or x == pytest.approx(y, rel=1e-9) for x, y in zip(r, a[r["ts"]], strict=True))
