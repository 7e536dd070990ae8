"""Queries against their SQL where part and supplier keys outgrow their places in the SQL's sequence number."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from barloom import plans

from test_queries import plain, same

NAMES = ["agg_flips_merge", "bar_flips", "bar_lead_tail_runs", "bar_mid_vol", "bar_sufficient_stats", "book_ofi"]


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Lines of few orders and days; part keys up to 3 million, supplier keys up to 250000."""
    top, draw = str(tmp_path_factory.mktemp("large")), random.Random(5)
    lines = [
        (draw.randrange(8), draw.randrange(3_000_000), draw.randrange(250_000), draw.randint(1, 7), float(draw.randint(1, 50)), draw.uniform(900, 99_000), draw.randint(0, 10) / 100, draw.randint(0, 8) / 100, draw.choice("ANR"), draw.choice("FO"), datetime(1997, 1, 1) + timedelta(days=draw.randrange(9)))
        for _ in range(900)
    ]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, schema).coalesce(1).write.parquet(f"{top}/lineitem.parquet")
    return top


@pytest.mark.parametrize("name", NAMES)
def test_order_of_large_keys(spark, large, name):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{large}/lineitem.parquet/*.parquet'")
    got, want = plans.QUERIES[name](spark, large), con.sql(plans.ORACLE[name])
    columns = sorted(got.columns)
    a = sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=str)
    b = sorted([tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()], key=str)
    assert len(a) == len(b)
    assert sum(not same(x, y) for x, y in zip(a, b, strict=True)) == 0
