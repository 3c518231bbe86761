"""Statements that change rows: conflicts, numbers, keys of parents, files that are added and rewritten, the catalog."""
import json

import pytest

from quarry.errors import BindError, CatalogError, ConstraintError, ParseError
from quarry.session import Session


@pytest.fixture()
def db(spark, request):
    s = Session(spark, "r" + str(abs(hash(request.node.name)) % 10**8))
    yield s
    s.sql(f"DROP DATABASE {s.database}")


def rows(s, text):
    return [tuple(r) for r in s.sql(text).collect()]


def files(s, table):
    return s.store.names(s.store.location(s._place(table)))


def test_conflict_keeps_quoted_text_and_names(db):
    db.sql("CREATE TABLE k (id INT PRIMARY KEY, name TEXT, n INT)")
    db.sql("INSERT INTO k VALUES (1, 'a', 1), (2, 'b', 2)")
    db.sql("INSERT INTO k AS t VALUES (1, 'x', 5), (3, 'c', 3) ON CONFLICT (id) DO UPDATE SET name = 'a big red cat, n = excluded.n', n = t.n + excluded.n WHERE t.name <> 'excluded.name'")
    assert sorted(rows(db, "SELECT * FROM k")) == [(1, "a big red cat, n = excluded.n", 6), (2, "b", 2), (3, "c", 3)]
    got = db.sql("INSERT INTO k VALUES (1, 'y', 0), (2, 'z', 9), (4, 'd', 4) ON CONFLICT ON CONSTRAINT k_pkey DO UPDATE SET name = name || excluded.name, n = DEFAULT WHERE excluded.n > 0 RETURNING id, name")
    assert sorted(map(tuple, got.collect())) == [(2, "bz"), (4, "d")]
    assert sorted(rows(db, "SELECT id, n FROM k"), key=str) == [(1, 6), (2, None), (3, 3), (4, 4)]
    for text, error in (("INSERT INTO k VALUES (9, 'a', 1), (9, 'b', 2) ON CONFLICT (id) DO UPDATE SET n = 0", ConstraintError), ("INSERT INTO k VALUES (1, 'a', 1) ON CONFLICT (n) DO NOTHING", BindError),
                        ("INSERT INTO k VALUES (1, 'a', 1) ON CONFLICT DO UPDATE SET n = 1", BindError), ("INSERT INTO k VALUES (1, 'a', 1) ON CONFLICT (id) DO UPDATE SET q = 1", BindError), ("INSERT INTO k VALUES (1, 'a', 1) ON CONFLICT ON CONSTRAINT q DO NOTHING", CatalogError)):
        with pytest.raises(error):
            db.sql(text)
    assert len(rows(db, "SELECT * FROM k")) == 4


def test_conflict_on_any_key_and_null_members(db):
    db.sql("CREATE TABLE u (id INT PRIMARY KEY, a INT UNIQUE, b INT, UNIQUE (a, b))")
    db.sql("INSERT INTO u VALUES (1, 1, 1)")
    db.sql("INSERT INTO u VALUES (2, 1, 5), (1, 7, 7), (3, NULL, 2), (4, NULL, 2), (5, 8, NULL), (6, 8, 0), (7, 9, 9) ON CONFLICT DO NOTHING")
    assert sorted(rows(db, "SELECT id, a, b FROM u"), key=str) == sorted([(1, 1, 1), (3, None, 2), (4, None, 2), (5, 8, None), (7, 9, 9)], key=str)
    # 11 meets 10 under a and is out, so 12, which meets 11 under its id only, is in
    db.sql("INSERT INTO u VALUES (10, 20, 0), (11, 20, 0), (11, 21, 0) ON CONFLICT DO NOTHING")
    assert sorted(rows(db, "SELECT id, a FROM u WHERE id > 9")) == [(10, 20), (11, 21)]
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO u VALUES (30, 1, 1) ON CONFLICT (id) DO NOTHING")
    db.sql("CREATE TABLE n (a INT UNIQUE, b INT)")
    db.sql("INSERT INTO n VALUES (NULL, 2), (NULL, 3) ON CONFLICT (a) DO NOTHING")
    db.sql("INSERT INTO n VALUES (NULL, 4) ON CONFLICT (a) DO UPDATE SET b = 0")
    assert sorted(r[1] for r in rows(db, "SELECT a, b FROM n")) == [2, 3, 4]


def test_numbers_for_every_row(db, spark):
    db.sql("CREATE SEQUENCE s START 5 INCREMENT 2 MAXVALUE 20")
    db.sql("CREATE TABLE t (id INT DEFAULT nextval('s'), auto INT AUTO_INCREMENT, v TEXT)")
    db.sql("INSERT INTO t (v) VALUES ('a'), ('b'), ('c')")
    db.sql("INSERT INTO t (v) SELECT concat('x', id) FROM range(0, 4, 1, 3)")
    assert sorted(rows(db, "SELECT id, auto FROM t")) == [(5 + 2 * k, 1 + k) for k in range(7)]
    with pytest.raises(ConstraintError, match="end"):
        db.sql("INSERT INTO t (v) VALUES ('a'), ('b')")
    other = Session(spark, db.database)  # another session sees the catalog
    assert other.nextval("s") == 19
    db.sql("DROP SEQUENCE s")
    with pytest.raises(CatalogError):
        other.nextval("s")


def test_catalog_is_shared(db, spark):
    db.sql("CREATE SCHEMA sales AUTHORIZATION me")
    db.sql("CREATE TYPE mood AS ENUM ('ok', 'bad')")
    db.sql("CREATE DOMAIN small AS INT CHECK (VALUE < 10)")
    db.sql("CREATE TABLE sales.o (k small, m mood)")
    other = Session(spark, db.database)
    other.sql("INSERT INTO sales.o VALUES (3, 'ok')")
    for text in ("INSERT INTO sales.o VALUES (11, 'ok')", "INSERT INTO sales.o VALUES (1, 'odd')"):
        with pytest.raises(ConstraintError):
            other.sql(text)
    assert rows(other, "SELECT o.k, o.m FROM sales.o") == [(3, "ok")]
    with pytest.raises(CatalogError):
        other.sql("CREATE SCHEMA sales")
    other.sql("DROP SCHEMA sales")
    db.sql("CREATE SCHEMA sales")
    assert db.tag == "CREATE SCHEMA"


def test_insert_adds_files_and_changes_rewrite_touched_ones(db):
    db.sql("CREATE TABLE f (id INT PRIMARY KEY, v INT)")
    for k in range(3):
        db.sql(f"INSERT INTO f VALUES ({k}, {k})")
        assert db.tag == "INSERT TABLE"
    before = set(files(db, "f"))
    db.sql("INSERT INTO f VALUES (7, 7)")
    assert before < set(files(db, "f"))  # nothing was written anew
    before = set(files(db, "f"))
    db.sql("UPDATE f SET v = 70 WHERE id = 7")
    assert len(before - set(files(db, "f"))) == 1
    before = set(files(db, "f"))
    db.sql("DELETE FROM f WHERE id > 100")
    db.sql("UPDATE f SET v = 0 WHERE id > 100")
    assert set(files(db, "f")) == before
    db.sql("DELETE FROM f WHERE id = 0")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO f VALUES (20, 0), (7, 1)")
    assert sorted(rows(db, "SELECT id, v FROM f")) == [(1, 1), (2, 2), (7, 70)]
    assert not db.store.names(db.store.location(db._place("f")), "_staged")
    db.compact("f")
    assert len(files(db, "f")) == 1 and len(rows(db, "SELECT * FROM f")) == 3


def test_every_hundredth_key_is_rejected(db):
    db.sql("CREATE TABLE users (id INT PRIMARY KEY, name VARCHAR(255))")
    accepted = rejected = 0
    for low in range(0, 1000, 100):  # a statement holds all or nothing
        values = [(k if k % 100 else 1, f"n{k}") for k in range(low + 1, low + 101)]
        good = [v for v in values if v[1] != f"n{low + 100}"]
        db.sql("INSERT INTO users VALUES " + ", ".join(f"({a}, '{b}')" for a, b in good))
        accepted += len(good)
        with pytest.raises(ConstraintError, match="duplicate key value"):
            db.sql("INSERT INTO users VALUES " + ", ".join(f"({a}, '{b}')" for a, b in values if v_not(good, (a, b))))
        rejected += 1
    assert (accepted, rejected) == (990, 10) and db.table("users").count() == 990


def v_not(good, value):
    return value not in good


def test_a_change_left_half_made_is_finished(db):
    db.sql("CREATE TABLE j (id INT)")
    db.sql("INSERT INTO j VALUES (1)")
    folder = db.store.location(db._place("j"))
    key, _ = db.store.stage(folder, db.table("j").selectExpr("id + 1 AS id"))
    assert rows(db, "SELECT id FROM j") == [(1,)]  # staged files are not seen
    fs, Path = db.store._fs(folder)
    out = fs.create(Path(f"{folder}/_journal-{key}"), True)
    out.write(bytearray(json.dumps({"old": [n for n in files(db, "j")], "new": db.store.names(f"{folder}/_staged-{key}")}).encode()))
    out.close()
    db.sql("INSERT INTO j VALUES (9)")
    assert sorted(rows(db, "SELECT id FROM j")) == [(2,), (9,)] and not db.store.names(folder, "_journal")


def test_parents_keep_their_children(db):
    db.sql("CREATE TABLE p (id INT PRIMARY KEY, up INT REFERENCES p (id))")
    db.sql("CREATE TABLE c (id INT, p INT REFERENCES p (id))")
    db.sql("INSERT INTO p VALUES (1, NULL), (2, 1), (3, NULL), (4, 4)")
    db.sql("INSERT INTO c VALUES (1, 3), (2, NULL)")
    for text in ("DELETE FROM p WHERE id = 3", "DELETE FROM p WHERE id = 1", "UPDATE p SET id = 30 WHERE id = 3", "TRUNCATE TABLE p", "INSERT INTO p VALUES (9, 8)"):
        with pytest.raises(ConstraintError, match="foreign key"):
            db.sql(text)
    db.sql("DELETE FROM p WHERE id = 4 OR id IN (SELECT 2)")
    db.sql("DELETE FROM c WHERE p = 3")
    db.sql("UPDATE p SET id = 30 WHERE id = 3")
    db.sql("INSERT INTO p VALUES (8, 9), (9, NULL)")
    assert sorted(r[0] for r in rows(db, "SELECT id FROM p")) == [1, 8, 9, 30]


def test_alter_leaves_nothing_behind(db):
    db.sql("CREATE TABLE a (id INT PRIMARY KEY, n INT CHECK (n > 0), label TEXT DEFAULT 'n', twice INT GENERATED ALWAYS AS (n * 2) STORED, q INT UNIQUE)")
    db.sql("INSERT INTO a (id, n, q) VALUES (1, 5, 1)")
    db.sql("ALTER TABLE a RENAME COLUMN n TO num")
    db.sql("INSERT INTO a (id, num, q) VALUES (2, 6, 2)")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO a (id, num, q) VALUES (3, 0, 3)")
    assert sorted(rows(db, "SELECT id, num, label, twice FROM a")) == [(1, 5, "n", 10), (2, 6, "n", 12)]
    db.sql("ALTER TABLE a DROP COLUMN num")
    db.sql("ALTER TABLE a DROP COLUMN q")
    db.sql("INSERT INTO a (id) VALUES (3)")
    db.sql("ALTER TABLE a ADD COLUMN num INT")
    db.sql("ALTER TABLE a ADD COLUMN k INT NOT NULL DEFAULT 4")
    assert sorted(rows(db, "SELECT id, num, k FROM a")) == [(1, None, 4), (2, None, 4), (3, None, 4)]
    db.sql("ALTER TABLE a RENAME CONSTRAINT a_pkey TO key1")
    with pytest.raises(ConstraintError, match="key1"):
        db.sql("INSERT INTO a (id) VALUES (3)")
    db.sql("ALTER TABLE a DROP CONSTRAINT key1")
    db.sql("INSERT INTO a (id) VALUES (3)")
    with pytest.raises(ConstraintError):
        db.sql("ALTER TABLE a ADD CONSTRAINT u UNIQUE (id)")
    db.sql("ALTER TABLE a ALTER COLUMN k TYPE TEXT USING concat('k', k)")
    db.sql("ALTER TABLE a ALTER COLUMN k DROP NOT NULL")
    db.sql("ALTER TABLE a ALTER COLUMN k SET DEFAULT 'new'")
    db.sql("ALTER TABLE a SET (fillfactor = 70)")
    db.sql("ALTER TABLE a OWNER TO someone")
    db.sql("CREATE SCHEMA other")
    db.sql("ALTER TABLE a SET SCHEMA other")
    db.sql("INSERT INTO other.a (id) VALUES (9)")
    assert rows(db, "SELECT k FROM other.a WHERE id IN (1, 9) ORDER BY id") == [("k4",), ("new",)]
    for text, error in (("ALTER TABLE other.a DROP COLUMN zz", BindError), ("ALTER TABLE other.a DROP CONSTRAINT zz", CatalogError), ("ALTER TABLE other.a FROB", ParseError)):
        with pytest.raises(error):
            db.sql(text)


def test_partitioned_tables_keep_the_columns_order(db):
    db.sql("CREATE TABLE p (a INT, b TEXT) PARTITION BY LIST (a)")
    db.sql("INSERT INTO p VALUES (1, 'x'), (2, 'y')")
    assert db.table("p").columns == ["a", "b"] and sorted(rows(db, "SELECT * FROM p")) == [(1, "x"), (2, "y")]
    db.sql("UPDATE p SET b = 'z' WHERE a = 2")
    db.sql("DELETE FROM p WHERE a = 1")
    assert rows(db, "SELECT * FROM p") == [(2, "z")]


def test_materialized_views(db):
    db.sql("CREATE TABLE b (id INT)")
    db.sql("INSERT INTO b VALUES (1), (2)")
    db.sql("CREATE MATERIALIZED VIEW v AS SELECT id / 2 AS half FROM b")
    db.sql("INSERT INTO b VALUES (9)")
    assert sorted(rows(db, "SELECT half FROM v")) == [(0,), (1,)]
    db.sql("REFRESH MATERIALIZED VIEW v")
    assert sorted(rows(db, "SELECT half FROM v")) == [(0,), (1,), (4,)]
    db.sql("DROP MATERIALIZED VIEW v")
    with pytest.raises(CatalogError):
        db.sql("DROP TABLE v")


def test_merge(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT NOT NULL DEFAULT 'd', twice INT GENERATED ALWAYS AS (id * 2) STORED)")
    db.sql("INSERT INTO t (id, v) VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    db.sql("CREATE TABLE s (id INT, v TEXT, x INT)")
    db.sql("INSERT INTO s VALUES (1, 'WHEN it''s THEN', 1), (2, 'z', 0), (8, 'new', 5), (9, NULL, 7), (NULL, 'n', 1)")
    out = db.sql("""MERGE INTO t USING s ON t.id = s.id WHEN MATCHED AND x = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET v = s.v, id = t.id + 10 / x
        WHEN NOT MATCHED AND s.id IS NULL THEN DO NOTHING WHEN NOT MATCHED AND s.v IS NULL THEN INSERT (id) VALUES (s.id) WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v) RETURNING id, v""")
    want = [(8, "new"), (9, "d"), (11, "WHEN it's THEN")]
    assert db.tag == "MERGE" and sorted(map(tuple, out.collect())) == want
    assert sorted(rows(db, "SELECT * FROM t")) == sorted([(3, "c", 6), *((i, v, 2 * i) for i, v in want)])
    db.sql("INSERT INTO s VALUES (3, 'p', 1), (3, 'q', 1)")
    for text, error in (("UPDATE SET v = s.v", ConstraintError), ("DELETE", ConstraintError), ("INSERT (id) VALUES (s.id)", ParseError), ("UPDATE SET zz = 1", BindError)):
        with pytest.raises(error):
            db.sql(f"MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN {text}")
    with pytest.raises(ConstraintError, match="unique"):
        db.sql("MERGE INTO t USING s ON false WHEN NOT MATCHED AND s.id = 3 THEN INSERT (id, v) VALUES (s.id, s.v)")
    assert sorted(rows(db, "SELECT id FROM t")) == [(3,), (8,), (9,), (11,)]


def test_copy_and_vacuum(db, tmp_path):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT, twice INT GENERATED ALWAYS AS (id * 2) STORED)")
    db.sql("INSERT INTO t (id, v) VALUES (1, 'a;b'), (2, NULL)")
    db.sql("INSERT INTO t (id, v) VALUES (3, ''), (4, ' \"q\" ')")
    for kind in ("csv", "json", "parquet"):
        db.sql(f"COPY t (id, v) TO '{tmp_path}/{kind}' (FORMAT {kind})")
        db.sql(f"CREATE TABLE {kind} (id INT PRIMARY KEY, v TEXT)")
        db.sql(f"COPY {kind} FROM '{tmp_path}/{kind}' WITH (FORMAT {kind})")
        assert sorted(rows(db, f"SELECT * FROM {kind}")) == [(1, "a;b"), (2, None), (3, ""), (4, ' "q" ')]
        with pytest.raises(ConstraintError):
            db.sql(f"COPY t (id, v) FROM '{tmp_path}/{kind}' WITH (FORMAT {kind})")
    for text in ("COPY t FROM stdin", "COPY (SELECT 1) FROM 'x'", "COPY t TO 'x' (FORMAT xml)"):
        with pytest.raises(ParseError):
            db.sql(text)
    db.sql("VACUUM t")
    assert len(db.store.names(db.store.location(db._place("t")))) == 1 and len(rows(db, "SELECT * FROM t")) == 4


def test_matches_hold_a_number_for_each_row(db, monkeypatch):
    """What is joined with the target's rows has no file paths, over several files."""
    kept = []
    inner = Session._kept
    monkeypatch.setattr(Session, "_kept", lambda self, rows, label, folder=None: kept.append((label, rows.dtypes)) or inner(self, rows, label, folder))
    db.sql('CREATE TABLE many (id BIGINT, v INT)')
    for i in range(5):
        db.sql(f'INSERT INTO many SELECT id + {i * 100}, 0 FROM range(100)')
    db.sql("CREATE TABLE s AS SELECT id * 3 AS id FROM range(1000) WHERE id >= 0")
    gone = db.sql('DELETE FROM many AS t USING s WHERE s.id = t.id AND t.id >= 200 RETURNING id')
    want = {i for i in range(500) if i % 3 or i < 200}
    assert sorted(r[0] for r in gone.collect()) == sorted(set(range(500)) - want)
    assert sorted(rows(db, 'SELECT id, v FROM many')) == [(i, 0) for i in sorted(want)]
    db.sql('UPDATE many AS t SET v = 1 FROM s WHERE s.id = t.id')
    assert sorted(rows(db, 'SELECT id, v FROM many')) == [(i, int(i % 3 == 0)) for i in sorted(want)]
    db.sql('MERGE INTO many AS t USING s ON s.id = t.id WHEN MATCHED AND t.id < 100 THEN DELETE WHEN MATCHED THEN UPDATE SET v = 2 WHEN NOT MATCHED AND s.id >= 2900 THEN INSERT (id, v) VALUES (s.id, 3)')
    assert sorted(rows(db, 'SELECT id, v FROM many')) == sorted([(i, 0 if i % 3 else 2) for i in want if i % 3 or i >= 100] + [(i, 3) for i in range(2901, 3000, 3)])
    matches = [dict(types) for label, types in kept if label == "_matches"]
    assert len(matches) == 3 and all(m["__at"] == "bigint" and "string" not in m.values() for m in matches)
