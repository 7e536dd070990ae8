"""Every registered query against its SQL on the small tables, as sets of rows."""

import math

import duckdb
import pytest

from barloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, str):
        return ("", x or "")
    x = float(x)
    return ("", "") if math.isnan(x) else (round(x, 5) + 0.0, "")


def same(a, b):
    return all(p[1] == q[1] and (p[0] == q[0] or (p[0] != "" and q[0] != "" and math.isclose(p[0], q[0], rel_tol=1e-6, abs_tol=2e-5))) for p, q in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_matches_sql(spark, sf, db, name):
    got = plans.QUERIES[name](spark, sf)
    want = db.sql(plans.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=str)
    at = [want.columns.index(c) for c in columns]
    b = sorted([tuple(plain(r[k]) for k in at) for r in want.fetchall()], key=str)
    assert len(a) == len(b)
    assert sum(not same(x, y) for x, y in zip(a, b, strict=True)) == 0


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0
