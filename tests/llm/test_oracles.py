"""The queries that have DuckDB statements against them, on sf0.001 and on texts where engines may differ."""
from collections import Counter

import duckdb
import pytest

from quarry.llm.oracles import ORACLES
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " \n\t\x0b ", "é", "TOKEN='abcdefghijkl' token:mnopqrstuvwx", "\u017fecret=abcdefghijklmnop to\u212aen=abcdefghijklmnop", "Api_Key = \"abcdefghijkl/+=.-_\"",
    "apikey=short password=exactly12chr passwd =  'exactly12chr' secret:exactly11ch", "日本 AKIAABCDEFGHIJKLMN日AKIASHORT", "0123456789abcdef0 0123456789ABCDEF 0123456789abcde", "f" * 5000,
    "https://user:hunter22@host ftp://a:b\x0bc@host x://y:zzzzzz@", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----" * 3, "ghp_" + "Zq" * 18 + "ghp_" + "9" * 36, "token=ghp_" + "Zq" * 18,
    "eyJabcdefgh.eyJabcdefgh.sig", "xoxb-1234567890", "AIza" + "x" * 35, "It's 'quoted'", "same text\there", "SAME text\there", "İ STANBUL ß",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(i * 3 % 23, t, "en", None, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "same text here"), (2, None), (3, "İ stanbul"), (4, "Token mnopqrstuvwx")], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("where", ["plain", "odd"])
def test_against_oracle(spark, odd, name, where):
    folder = SF if where == "plain" else odd
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if where == 'odd' else ''}')")
    want = con.sql(ORACLES[name])
    order = sorted(want.columns)
    rows = Counter(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == order
    assert Counter(tuple(r[c] for c in order) for r in got.collect()) == rows
