"""Registered queries that run statements of the session on whole tables, with the DuckDB statement that each
must agree with. A query works in a database of its own, which is made anew in every run."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConstraintError
from ..session import Session
from ..sources import register

STATEMENTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def statements(oracle: str):
    """Register a function of a fresh session over the views of the driver's tables."""
    def put(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            register(spark, folder)
            db = Session(spark, f"q_{f.__name__}")
            db.sql(f"DROP DATABASE {db.database}")
            return f(Session(spark, db.database))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        STATEMENTS[f.__name__] = (run, oracle)
        return f
    return put


def _customers(db: Session, keys: str = "PRIMARY KEY") -> None:
    db.sql(f"CREATE TABLE target (c_custkey BIGINT {keys}, c_name TEXT NOT NULL, c_acctbal DOUBLE)")
    db.sql("INSERT INTO target SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment IS DISTINCT FROM 'MACHINERY'")


@statements("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment IS DISTINCT FROM 'MACHINERY' UNION ALL SELECT c_custkey, upper(c_name), c_acctbal FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')")
def insert_select(db):
    _customers(db, "")
    db.sql("INSERT INTO target (c_name, c_custkey, c_acctbal) SELECT upper(c_name), c_custkey, c_acctbal FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')")
    return db.sql("SELECT * FROM target")


@statements("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'it''s a big c_name' ELSE c_name END AS c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert(db):
    _customers(db)
    db.sql("""INSERT INTO target AS t SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')
        ON CONFLICT (c_custkey) DO UPDATE SET c_name = 'it''s a big c_name', c_acctbal = excluded.c_acctbal + 1 WHERE t.c_custkey = excluded.c_custkey""")
    return db.sql("SELECT * FROM target")


@statements("SELECT c_custkey, c_name, c_acctbal FROM customer")
def upsert_nothing(db):
    _customers(db)
    db.sql("CREATE UNIQUE INDEX names ON target (c_name)")
    db.sql("INSERT INTO target SELECT c_custkey + 1000000000, c_name, -1 FROM customer WHERE c_mktsegment IS DISTINCT FROM 'MACHINERY' UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer ON CONFLICT DO NOTHING")
    return db.sql("SELECT * FROM target")


@statements("SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_rows(db):
    db.sql("CREATE TABLE s AS SELECT * FROM supplier")
    db.sql("UPDATE s SET s_acctbal = 0 WHERE s_nationkey < 5")
    return db.sql("SELECT s_suppkey, s_acctbal FROM s")


@statements("SELECT s_suppkey, CASE WHEN n_regionkey = 2 THEN s_name || '/' || n_name ELSE s_name END AS s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def update_from(db):
    db.sql("CREATE TABLE s (s_suppkey BIGINT PRIMARY KEY, s_name TEXT, s_nationkey INT)")
    db.sql("INSERT INTO s SELECT s_suppkey, s_name, s_nationkey FROM supplier")
    db.sql("UPDATE s AS x SET s_name = x.s_name + '/' + n.n_name FROM nation n WHERE n.n_nationkey = x.s_nationkey AND n.n_regionkey = 2")
    return db.sql("SELECT s_suppkey, s_name FROM s")


@statements("SELECT * FROM supplier WHERE NOT coalesce(s_acctbal < 0, false)")
def delete_rows(db):
    db.sql("CREATE TABLE s AS SELECT * FROM supplier")
    db.sql("DELETE FROM s WHERE s_acctbal < 0")
    return db.sql("SELECT * FROM s")


@statements("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_using_returning(db):
    db.sql("CREATE TABLE o AS SELECT o_orderkey, o_custkey FROM orders")
    return db.sql("DELETE FROM o USING customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING' RETURNING o_orderkey, o_custkey")


@statements("SELECT p_partkey, p_size // 2 AS half, CAST(p_size AS VARCHAR) || '!' AS label FROM part")
def insert_returning(db):
    db.sql("CREATE TABLE p (k BIGINT PRIMARY KEY, n INT)")
    return db.sql("INSERT INTO p SELECT p_partkey, p_size FROM part RETURNING k AS p_partkey, n / 2 AS half, n::text + '!' AS label")


@statements("SELECT count(*) AS n, 10 AS low, 10 + 5 * (count(*) - 1) AS high, count(*) AS different, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem")
def sequence_default(db):
    db.sql("CREATE SEQUENCE ids START WITH 10 INCREMENT BY 5")
    db.sql("CREATE TABLE l (id INT DEFAULT nextval('ids'), quantity DOUBLE)")
    db.sql("INSERT INTO l (quantity) SELECT l_quantity FROM lineitem")
    return db.sql("SELECT count(*) AS n, min(id) AS low, max(id) AS high, count(DISTINCT id) AS different, CAST(sum(quantity) AS BIGINT) AS quantity FROM l")


@statements("SELECT count(*) AS n, 1 AS low, count(*) AS high FROM orders")
def identity_column(db):
    db.sql("CREATE TABLE o (id INT AUTO_INCREMENT PRIMARY KEY, o_orderkey BIGINT)")
    for status in ("= 'F'", "<> 'F'"):
        db.sql(f"INSERT INTO o (o_orderkey) SELECT o_orderkey FROM orders WHERE o_orderstatus {status}")
    return db.sql("SELECT count(DISTINCT id) AS n, min(id) AS low, max(id) AS high FROM o")


@statements("SELECT p_partkey, p_size AS size, p_size * 2 AS twice, 'new' AS state FROM part WHERE p_size > 0")
def alter_table(db):
    db.sql("CREATE TABLE p (p_partkey BIGINT PRIMARY KEY, n INT CHECK (n > 0), twice INT GENERATED ALWAYS AS (n * 2) STORED, extra TEXT)")
    db.sql("INSERT INTO p (p_partkey, n) SELECT p_partkey, p_size FROM part WHERE p_size > 0 AND p_brand < 'Brand#3'")
    db.sql("ALTER TABLE p RENAME COLUMN n TO size")
    db.sql("ALTER TABLE p DROP COLUMN extra")
    db.sql("ALTER TABLE p ADD COLUMN state TEXT DEFAULT 'new'")
    db.sql("INSERT INTO p (p_partkey, size) SELECT p_partkey, p_size FROM part WHERE p_size > 0 AND p_brand >= 'Brand#3'")
    return db.sql("SELECT p_partkey, size, twice, state FROM p")


@statements("SELECT c_custkey, c_nationkey FROM customer")
def rejected_rows(db):
    """Statements with one bad row each leave the table as it was: a second key, an unknown parent, a failed check, a NULL."""
    db.sql("CREATE TABLE n (k INT PRIMARY KEY)")
    db.sql("INSERT INTO n SELECT n_nationkey FROM nation")
    db.sql("CREATE TABLE c (c_custkey BIGINT PRIMARY KEY, c_nationkey INT NOT NULL REFERENCES n (k), CHECK (c_custkey >= 0))")
    db.sql("INSERT INTO c SELECT c_custkey, c_nationkey FROM customer")
    for statement in ("INSERT INTO c SELECT max(c_custkey), 0 FROM customer", "INSERT INTO c SELECT c_custkey + 1000000000, CASE WHEN c_custkey = 1 THEN 99 ELSE c_nationkey END FROM customer", "INSERT INTO c SELECT -c_custkey - 1, c_nationkey FROM customer",
                      "INSERT INTO c SELECT c_custkey + 1000000000, NULL FROM customer", "UPDATE c SET c_custkey = 7", "DELETE FROM n WHERE k IN (SELECT c_nationkey FROM c)"):
        try:
            db.sql(statement)
        except ConstraintError:
            continue
        raise AssertionError(statement)
    return db.sql("SELECT * FROM c")


@statements("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ORDER BY o_custkey LIMIT 50")
def distinct_on_in_cte(db):
    return db.sql("""WITH best AS (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey)
        SELECT * FROM best WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 FOR SHARE) ORDER BY o_custkey FETCH FIRST 50 ROWS ONLY""")


@statements("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 20")
def distinct_on_limit(db):
    return db.sql("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 20")


@statements("SELECT o_orderkey, l FROM (SELECT o_orderkey, max(l_quantity) AS l FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) ORDER BY l DESC NULLS FIRST, o_orderkey LIMIT 400")
def null_order(db):
    return db.sql("SELECT o_orderkey, l FROM (SELECT o_orderkey, max(l_quantity) AS l FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) ORDER BY l DESC, o_orderkey LIMIT 400")


@statements("SELECT l_orderkey, l_linenumber, l_partkey // 7 AS q, (l_partkey + l_suppkey) // 2 AS mean, CAST(l_linenumber AS VARCHAR) AS line, CAST(l_quantity AS BIGINT) AS quantity, l_returnflag || l_linestatus AS flags FROM lineitem")
def typed_arithmetic(db):
    return db.sql("SELECT l_orderkey, l_linenumber, l_partkey / 7 AS q, (l_partkey + l_suppkey) / 2 AS mean, l_linenumber::text AS line, CAST(l_quantity AS INT8) AS quantity, l_returnflag + l_linestatus AS flags FROM lineitem")


@statements("SELECT p_partkey, regexp_matches(p_type, '^[A-M]') AS early, regexp_matches(p_name, '(?i)A') AS a FROM part WHERE NOT regexp_matches(p_brand, '1$')")
def regex_operators(db):
    return db.sql("SELECT p_partkey, p_type ~ '^[A-M]' AS early, p_name ~* 'A' AS a FROM part WHERE p_brand !~ '1$'")


@statements("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_operators(db):
    return db.sql("SELECT event_id, (props ->> 'k')::int8 AS k FROM events")


@statements("SELECT c_mktsegment, n FROM (SELECT c_mktsegment, n, rank() OVER (ORDER BY n) AS r FROM (SELECT c_mktsegment, count(*) // 1000000 AS n FROM customer GROUP BY c_mktsegment)) WHERE r <= 1")
def fetch_with_ties(db):
    return db.sql("SELECT c_mktsegment, n FROM (SELECT c_mktsegment, count(*) / 1000000 AS n FROM customer GROUP BY c_mktsegment) x ORDER BY n FETCH FIRST 1 ROWS WITH TIES")


@statements("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
def schema_and_view(db):
    db.sql("CREATE SCHEMA sales")
    db.sql("CREATE TABLE sales.c AS SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
    db.sql("CREATE VIEW rich AS SELECT c_custkey, c_nationkey FROM sales.c WHERE c_acctbal > 0")
    return db.sql("SELECT n_name, count(*) AS customers FROM rich r JOIN nation ON n_nationkey = r.c_nationkey GROUP BY n_name")


@statements("SELECT p_partkey, p_size * 2 + 1 AS odd, p_size // 2 AS half FROM part")
def sql_functions(db):
    db.sql("CREATE FUNCTION odd_of(x INT) RETURNS INT AS 'SELECT x * 2 + 1' LANGUAGE SQL IMMUTABLE STRICT")
    db.sql("CREATE FUNCTION sized(n INT) RETURNS TABLE (k BIGINT, s INT) AS $$ SELECT p_partkey, p_size FROM part WHERE p_size >= n $$ LANGUAGE SQL")
    return db.sql("SELECT k AS p_partkey, odd_of(s) AS odd, s / 2 AS half FROM sized(-1000)")


@statements("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'none' END AS state FROM orders")
def types_and_domains(db):
    """Finished orders come with their state, all others take the default; all rows pass the enum's and the domain's checks."""
    db.sql("CREATE TYPE state AS ENUM ('F', 'O', 'P', 'none')")
    db.sql("CREATE DOMAIN order_key AS INT8 CHECK (VALUE >= 0) NOT NULL")
    db.sql("CREATE TABLE o (o_orderkey order_key, state state DEFAULT 'none')")
    db.sql("INSERT INTO o SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
    db.sql("INSERT INTO o (o_orderkey) SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
    return db.sql("SELECT * FROM o")


@statements("""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN lower(c_name) ELSE c_name END AS c_name,
    CASE c_mktsegment WHEN 'BUILDING' THEN c_acctbal + 1 WHEN 'MACHINERY' THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment IS DISTINCT FROM 'HOUSEHOLD'""")
def merge_rows(db):
    _customers(db)
    db.sql("""MERGE INTO target AS t USING (SELECT * FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING', 'HOUSEHOLD')) AS s ON s.c_custkey = t.c_custkey
        WHEN MATCHED AND CASE WHEN s.c_mktsegment = 'HOUSEHOLD' THEN true ELSE false END THEN DELETE
        WHEN MATCHED THEN UPDATE SET c_acctbal = s.c_acctbal + 1
        WHEN NOT MATCHED THEN INSERT (c_custkey, c_name, c_acctbal) VALUES (s.c_custkey, lower(s.c_name), 0)""")
    return db.sql("SELECT * FROM target")


@statements("SELECT p_partkey, nullif(p_brand, 'Brand#11') AS brand, CASE WHEN p_size > 25 THEN '' ELSE p_name || chr(10) || ' \"x\", ' END AS label, p_retailprice FROM part")
def copy_round_trip(db):
    """Rows written by COPY TO and read by COPY FROM: NULLs, empty texts, quotes and line breaks stay."""
    folder = db.store.schema_root(db._space()) + "/copied"
    db.sql("CREATE TABLE p (p_partkey BIGINT PRIMARY KEY, brand TEXT, label TEXT, p_retailprice DOUBLE)")
    db.sql(f"COPY (SELECT p_partkey, nullif(p_brand, 'Brand#11') AS brand, CASE WHEN p_size > 25 THEN '' ELSE p_name || chr(10) || ' \"x\", ' END AS label, p_retailprice FROM part) TO '{folder}' WITH (FORMAT csv, HEADER, DELIMITER ';')")
    db.sql(f"COPY p FROM '{folder}' WITH (FORMAT csv, HEADER, DELIMITER ';')")
    return db.sql("SELECT * FROM p")


@statements("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def composite_key(db):
    db.sql("CREATE TABLE l (l_orderkey BIGINT, l_linenumber INT, PRIMARY KEY (l_orderkey, l_linenumber))")
    db.sql("INSERT INTO l SELECT l_orderkey, l_linenumber FROM lineitem ON CONFLICT (l_orderkey, l_linenumber) DO NOTHING")
    return db.sql("SELECT * FROM l")


@statements("SELECT n_nationkey, n_name, n_regionkey * 2 AS twice FROM nation UNION ALL SELECT -1, 'none', 0")
def defaults_and_generated(db):
    db.sql("CREATE TABLE n (n_nationkey INT DEFAULT -1, n_name TEXT DEFAULT 'none', r INT DEFAULT 0, twice INT GENERATED ALWAYS AS (r * 2) STORED) PARTITION BY LIST (r)")
    db.sql("INSERT INTO n DEFAULT VALUES")
    db.sql("INSERT INTO n (n_nationkey, n_name, r) SELECT * FROM nation")
    return db.sql("SELECT n_nationkey, n_name, twice FROM n")


@statements("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 0")
def truncate_rows(db):
    db.sql("CREATE TABLE s AS SELECT s_suppkey, s_name FROM supplier")
    db.sql("TRUNCATE TABLE s RESTART IDENTITY CASCADE")
    db.sql("INSERT INTO s SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 0")
    db.sql("VACUUM s")
    return db.sql("SELECT * FROM s")


@statements("SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY o_custkey")
def materialized_view(db):
    db.sql("CREATE TABLE o AS SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
    db.sql("CREATE MATERIALIZED VIEW counts AS SELECT o_custkey AS customer, count(*) AS n FROM o GROUP BY o_custkey")
    db.sql("INSERT INTO o SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
    db.sql("REFRESH MATERIALIZED VIEW counts")
    return db.sql("SELECT * FROM counts")


@statements("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def altered_view(db):
    db.sql("CREATE TABLE c AS SELECT c_nationkey, c_mktsegment FROM customer")
    db.sql("CREATE VIEW v (segment) AS SELECT c_nationkey FROM c")
    db.sql("ALTER VIEW v AS SELECT c_mktsegment AS segment FROM c")
    db.sql("ALTER VIEW v RENAME TO w")
    return db.sql("SELECT segment, count(*) AS n FROM w GROUP BY segment")


@statements("SELECT event_id, CAST(json_extract_string('{\"a\":{\"b\":[5,' || props || ']}}', '$.a.b[1].k') AS BIGINT) AS k FROM events")
def json_paths(db):
    return db.sql("""SELECT event_id, (('{"a":{"b":[5,' || props || ']}}') #>> '{a,b,1,k}')::bigint AS k FROM events""")


@statements("SELECT r_name, n_name FROM region LEFT JOIN nation ON true")
def join_without_on(db):
    return db.sql("SELECT r_name, n_name FROM region LEFT JOIN nation")


@statements("SELECT p_partkey, p_brand || '/' || p_type AS label, p_size AS n, substring(p_name, 2, 3) AS part, upper(p_type) AS loud FROM part WHERE p_size IN (3, 7, 9, 11) AND p_name ILIKE '%A%' AND (p_type LIKE '%A%' OR p_type LIKE '%B%') AND p_brand NOT IN ('none')")
def lists_and_texts(db):
    return db.sql("SELECT ALL p_partkey, p_brand || '/' || p_type AS label, +p_size AS n, Substring(p_name, 2, 3) AS part, UPPER(p_type) AS loud, FROM part WHERE p_size IN (3, 7, 9, 11) AND p_name ILIKE '%A%' AND p_type LIKE ANY ('%A%', '%B%') AND p_brand NOT IN ('none')")


@statements("SELECT l_orderkey, l_partkey, CAST(l_partkey AS DOUBLE) AS d, CAST(l_quantity > 10 AS VARCHAR) AS many, l_quantity > 10 AS flag, CASE WHEN l_linenumber > 3 THEN CAST(l_linenumber AS BIGINT) END AS some, CAST(l_linenumber AS SMALLINT) AS small FROM lineitem")
def casts(db):
    return db.sql("SELECT l_orderkey, l_partkey, l_partkey::float8 AS d, (l_quantity > 10)::text AS many, (l_quantity > 10)::bool AS flag, CASE WHEN l_linenumber > 3 THEN l_linenumber::int ELSE NULL::int END AS some, CAST(l_linenumber AS INT2) AS small FROM lineitem")


@statements("SELECT o_orderkey, extract(year FROM o_orderdate) AS y, CAST(o_orderdate + INTERVAL 1 DAY AS VARCHAR) AS after, (o_orderkey * 2) AS second FROM orders")
def dates_and_arrays(db):
    return db.sql("SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INT8) AS y, (o_orderdate + INTERVAL '1' DAY)::text AS after, array(o_orderkey, o_orderkey * 2)[1] AS second FROM orders")


@statements("SELECT k FROM ((SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def set_chain(db):
    return db.sql("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")


@statements("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ORDER BY r DESC, o_orderkey LIMIT 30")
def window_in_order(db):
    return db.sql("SELECT o_orderkey FROM orders ORDER BY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) DESC, o_orderkey LIMIT 30")
