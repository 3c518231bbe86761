"""Statements of the session: constraints, upserts, rewrites, and that a failed one writes nothing."""
import pytest

from quarry.errors import BindError, CatalogError, ConstraintError, ParseError
from quarry.session import Session


@pytest.fixture()
def db(spark, request):
    s = Session(spark, "t" + str(abs(hash(request.node.name)) % 10**8))
    yield s
    s.sql(f"DROP DATABASE {s.database}")


def rows(s, text):
    return [tuple(r) for r in s.sql(text).collect()]


def test_insert_and_duplicate_key(db):
    db.sql("CREATE TABLE users (id INT PRIMARY KEY, name VARCHAR(255) NOT NULL, email VARCHAR(255) UNIQUE)")
    db.sql("INSERT INTO users VALUES (1, 'a', 'x'), (2, 'it''s', NULL), (3, 'c', NULL)")
    with pytest.raises(ConstraintError, match="duplicate key value"):
        db.sql("INSERT INTO users VALUES (4, 'd', 'y'), (1, 'e', 'z')")
    with pytest.raises(ConstraintError, match="null value"):
        db.sql("INSERT INTO users (id) VALUES (9)")
    assert rows(db, "SELECT * FROM users WHERE id = 2") == [(2, "it's", None)]
    assert len(rows(db, "SELECT * FROM users")) == 3


def test_binding_errors(db):
    db.sql("CREATE TABLE t (a INT, b TEXT)")
    for text, error in (("INSERT INTO t VALUES (1)", BindError), ("INSERT INTO t VALUES ('x', 'y')", BindError), ("INSERT INTO t (a, c) VALUES (1, 2)", BindError),
                        ("CREATE TABLE u (a INT, a INT)", BindError), ("CREATE TABLE u (a INT PRIMARY KEY, b INT PRIMARY KEY)", BindError), ("CREATE TABLE u (a INT, UNIQUE (z))", BindError),
                        ("CREATE TABLE t (a INT)", CatalogError), ("INSERT INTO none VALUES (1)", CatalogError), ("USE nowhere", CatalogError), ("FROBNICATE", ParseError)):
        with pytest.raises(error):
            db.sql(text)
    db.sql("CREATE TABLE IF NOT EXISTS t (a INT)")


def test_defaults_checks_and_foreign_keys(db):
    db.sql("CREATE TABLE p (id INT PRIMARY KEY)")
    db.sql("CREATE TABLE c (id INT, n SMALLINT DEFAULT -1, p INT REFERENCES p (id), twice BIGINT GENERATED ALWAYS AS (id * 2) STORED, CHECK (id > 0))")
    db.sql("INSERT INTO p VALUES (1)")
    db.sql("INSERT INTO c (id, p) VALUES (7 / 2, 1)")
    assert rows(db, "SELECT id, n, p, twice FROM c") == [(3, -1, 1, 6)]
    with pytest.raises(ConstraintError, match="foreign key"):
        db.sql("INSERT INTO c (id, p) VALUES (2, 5)")
    with pytest.raises(ConstraintError, match="check"):
        db.sql("INSERT INTO c (id) VALUES (0)")


def test_upsert_update_delete_returning(db):
    db.sql("CREATE TABLE k (id INT PRIMARY KEY, v INT)")
    db.sql("INSERT INTO k VALUES (1, 10), (2, 20)")
    db.sql("INSERT INTO k VALUES (2, 5), (3, 30) ON CONFLICT (id) DO UPDATE SET v = k.v + excluded.v")
    db.sql("INSERT INTO k VALUES (3, 0), (4, 40) ON CONFLICT (id) DO NOTHING")
    assert sorted(rows(db, "SELECT id, v FROM k")) == [(1, 10), (2, 25), (3, 30), (4, 40)]
    got = db.sql("UPDATE k SET v = v + 1 WHERE id > 2 RETURNING id, v")
    assert sorted(map(tuple, got.collect())) == [(3, 31), (4, 41)]
    db.sql("DELETE FROM k WHERE v > 30")
    assert sorted(rows(db, "SELECT id, v FROM k FOR UPDATE OF k SKIP LOCKED")) == [(1, 10), (2, 25)]
    with pytest.raises(ConstraintError):
        db.sql("UPDATE k SET id = 1")
    assert len(rows(db, "SELECT * FROM k")) == 2


def test_quoted_text_is_kept(db):
    db.sql("CREATE TABLE q (a INT, b TEXT)")
    db.sql("INSERT INTO q VALUES (1, 'two  blanks -- no comment'), -- a comment; 'quoted\n (2, 'a /* b */ (public.q'), /* outer /* inner */ still */ (3, 'x, y; z')")
    assert sorted(rows(db, "SELECT a, b FROM public.q")) == [(1, "two  blanks -- no comment"), (2, "a /* b */ (public.q"), (3, "x, y; z")]
    assert rows(db, "SELECT a FROM q WHERE b = 'a /* b */ (public.q'") == [(2,)]
    db.script("DELETE FROM q WHERE b = 'x, y; z'; -- done; really\nUPDATE q SET b = 'c' WHERE a = 1;")
    assert sorted(rows(db, "SELECT a, b FROM q")) == [(1, "c"), (2, "a /* b */ (public.q")]
    with pytest.raises(ParseError):
        db.sql("SELECT 1 /* open")


def test_update_from_and_delete_using(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT DEFAULT 7, twice INT GENERATED ALWAYS AS (v * 2) STORED)")
    db.sql("CREATE TABLE s (id INT, v INT)")
    db.sql("INSERT INTO t (id, v) VALUES (1, 10), (2, 20), (3, 30), (4, NULL)")
    db.sql("INSERT INTO s VALUES (2, 5), (3, 9), (3, 1), (8, 8)")
    got = db.sql("UPDATE t AS x SET v = x.v + s.v FROM s WHERE s.id = x.id RETURNING id, v, twice")
    assert sorted(map(tuple, got.collect())) == [(2, 25, 50), (3, 31, 62)]  # of two matches the least new value
    assert sorted(rows(db, "SELECT id, v FROM t")) == [(1, 10), (2, 25), (3, 31), (4, None)]
    db.sql("UPDATE t SET v = DEFAULT WHERE id IN (SELECT id FROM s WHERE v = 5)")
    db.sql("UPDATE t SET v = (SELECT max(v) FROM s) WHERE id = 4")
    assert sorted(rows(db, "SELECT id, v, twice FROM t")) == [(1, 10, 20), (2, 7, 14), (3, 31, 62), (4, 9, 18)]
    with pytest.raises(ConstraintError):
        db.sql("UPDATE t SET id = 1 FROM s WHERE s.id = t.id")
    gone = db.sql("DELETE FROM t USING s WHERE s.id = t.id AND s.v < 6 RETURNING id")
    assert sorted(map(tuple, gone.collect())) == [(2,), (3,)]
    db.sql("DELETE FROM t AS y WHERE y.id = 1 OR NOT EXISTS (SELECT 1 FROM s WHERE s.v = y.v)")
    assert rows(db, "SELECT id FROM t") == [(4,)]
    assert [tuple(r) for r in db.sql("DELETE FROM t RETURNING id, v").collect()] == [(4, 9)]
    assert rows(db, "SELECT id FROM t") == []


def test_composite_key_and_null_members(db):
    db.sql("CREATE TABLE e (a INT, b INT, UNIQUE (a, b))")
    db.sql("INSERT INTO e VALUES (1, 1), (1, 2), (NULL, 1), (NULL, 1)")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO e VALUES (1, 2)")


def test_alter_view_sequence_type_function(db):
    db.sql("CREATE TABLE a (id INT, name TEXT)")
    db.sql("CREATE SEQUENCE s START 5 INCREMENT 2")
    db.sql("INSERT INTO a VALUES (nextval('s'), 'x'), (nextval('s'), 'y')")
    db.sql("ALTER TABLE a ADD COLUMN n INT DEFAULT 3")
    db.sql("ALTER TABLE a RENAME COLUMN name TO label")
    assert sorted(rows(db, "SELECT id, label, n FROM a")) == [(5, "x", 3), (7, "y", 3)]
    db.sql("CREATE VIEW big AS SELECT id FROM a WHERE id > 5")
    assert rows(db, "SELECT * FROM big") == [(7,)]
    db.sql("CREATE TYPE mood AS ENUM ('ok', 'bad')")
    db.sql("CREATE TABLE m (x mood)")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO m VALUES ('odd')")
    db.sql("CREATE FUNCTION plus_one(x INT) RETURNS INT AS 'SELECT x + 1' LANGUAGE SQL")
    assert rows(db, "SELECT plus_one(4)") == [(5,)]
    db.sql("TRUNCATE TABLE a")
    assert rows(db, "SELECT * FROM a") == []
    db.sql("DROP TABLE IF EXISTS a, m")


def test_schemas_and_distinct_on(db):
    db.sql("CREATE SCHEMA sales")
    db.sql("CREATE TABLE sales.o (k INT, v INT)")
    db.sql("INSERT INTO sales.o VALUES (1, 5), (1, 9), (2, 4)")
    assert sorted(rows(db, "SELECT DISTINCT ON (k) k, v FROM sales.o ORDER BY k, v DESC")) == [(1, 9), (2, 4)]
    with pytest.raises(CatalogError):
        db.sql("CREATE SCHEMA sales")
    with pytest.raises(BindError):
        db.sql("CREATE DATABASE z CONNECTION LIMIT -2")
