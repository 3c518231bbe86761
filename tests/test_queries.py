"""Every relational query against its oracle in DuckDB."""
import datetime
import math
from collections import Counter

import duckdb
import pytest

from quarry.plans import ORACLES, QUERIES
from quarry.sources import TABLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x.isoformat() if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = Counter(tuple(plain(r[c]) for c in order) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    assert rows == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["upsert", "insert_select"])
def test_every_customer_takes_part(spark, duck, name):
    ids = {r[0] for r in duck.sql("SELECT c_custkey FROM customer").fetchall()}
    rows = [r.c_custkey for r in QUERIES[name](spark, SF).collect()]
    assert set(rows) == ids and len(rows) == len(ids) + (name == "insert_select") * duck.sql("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'").shape[0]


def test_null_tests_return_the_whole_join(spark, duck):
    rows = QUERIES["null_tests"](spark, SF).collect()
    assert Counter(r.o_orderkey for r in rows) == Counter(dict(duck.sql("SELECT o_orderkey, greatest(count(l_orderkey), 1) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL").fetchall()))
    assert any(r.missing and r.line == -1 for r in rows) and not any(r.missing != (r.line == -1) for r in rows)
