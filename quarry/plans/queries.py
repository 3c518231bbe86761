"""One query for each part of the SQL surface, each with the DuckDB statement that it must agree with.

SAME holds statements that both engines read alike; DIFFERENT those whose oracle needs other words.
Sums are taken over decimals, so that the order of rows can't change them.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as ops
from ..functions import int_div, plus, to_text, trunc_int
from ..sources import register, table
from .statements import STATEMENTS

SAME = {
    "scan_all": "SELECT * FROM nation",
    "point_lookup": "SELECT * FROM orders WHERE o_orderkey = 5",
    "filter_eq_nonkey": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "filter_compare_and_or_not": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity >= 40 OR l_quantity < 3) AND NOT (l_returnflag = 'R') AND l_linenumber <> 2",
    "between_in_like": "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN (SELECT p_brand FROM part WHERE p_size = 7) AND p_name LIKE '%a%' AND p_type NOT LIKE 'X%'",
    "null_tests": "SELECT o_orderkey, l_linenumber IS NULL AS missing, coalesce(l_linenumber, -1) AS line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' END AS band FROM orders",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders",
    "project_alias": "SELECT c_custkey AS id, c_name AS label FROM customer AS c",
    "qualified_star": "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA'",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45",
    "join_right": "SELECT l_partkey, o_orderkey FROM lineitem RIGHT JOIN orders ON o_orderkey = l_orderkey AND l_quantity > 48",
    "join_full": "SELECT a.c_custkey AS a, b.s_suppkey AS b FROM customer a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey + 50",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_comma": "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey",
    "join_nonequi": "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey < r_regionkey",
    "join_natural": "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y",
    "semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "anti_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00')",
    "exists_correlated": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "not_exists": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "scalar_subquery": "SELECT p_partkey FROM part WHERE p_size = (SELECT max(p_size) FROM part)",
    "correlated_scalar": "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders",
    "group_aggregates": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_price, min(l_shipdate) AS first_ship, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "count_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    "topk": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey > 4",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "cte": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 250000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON c_custkey = o_custkey",
    "nested_subquery": "SELECT a.c_mktsegment, a.n FROM (SELECT c_mktsegment, count(*) AS n FROM (SELECT * FROM customer WHERE c_acctbal > 0) x GROUP BY c_mktsegment) a WHERE a.n > 10",
    "window_rank": "SELECT event_id, row_number() OVER w AS rn, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rk, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dr FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_lag_lead": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "window_running_sum": "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders",
    "window_rows_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM events",
    "for_update_ignored": "SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
}
DIFFERENT: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(oracle: str):
    """Register a DataFrame query under its name with its oracle."""
    def put(f):
        DIFFERENT[f.__name__] = (f, oracle)
        return f
    return put


@query("SELECT k, a, b FROM (SELECT c_nationkey AS k, c_custkey AS a FROM customer) x JOIN (SELECT s_nationkey AS k, s_suppkey AS b FROM supplier) y USING (k)")
def join_using(spark, d):
    """Customers with all suppliers of their nation: the result grows as the square of the tables."""
    x = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("a"))
    return ops.dealt_join(x, table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("b")), ["k"])


@query("SELECT l_orderkey, l_linenumber, (l_partkey - 500) // 7 AS quotient, (l_partkey - 500) % 7 AS rest, l_suppkey * 2 + l_linenumber - 1 AS mixed FROM lineitem")
def arith_int_div_mod(spark, d):
    c = F.col("l_partkey") - 500
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", int_div(c, F.lit(7)).alias("quotient"), (c % 7).alias("rest"), (F.col("l_suppkey") * 2 + F.col("l_linenumber") - 1).alias("mixed"))


@query("SELECT p_partkey, p_brand || '/' || p_type AS label, upper(p_name) AS loud, lower(p_brand) AS quiet FROM part")
def concat_upper_lower(spark, d):
    df = table(spark, d, "part")
    kind = df.schema["p_brand"].dataType
    return df.select("p_partkey", plus(plus(F.col("p_brand"), F.lit("/"), kind), F.col("p_type"), kind).alias("label"), F.upper("p_name").alias("loud"), F.lower("p_brand").alias("quiet"))


@query("SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(trunc(-p_retailprice / 3) AS BIGINT) AS third FROM part")
def cast_trunc(spark, d):
    return table(spark, d, "part").select("p_partkey", trunc_int(F.col("p_retailprice")).alias("whole"), trunc_int(-F.col("p_retailprice") / 3).alias("third"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS price_text FROM part")
def cast_text(spark, d):
    df = table(spark, d, "part")
    whole = F.floor("p_retailprice").cast("double")
    return df.select("p_partkey", to_text(F.col("p_size"), df.schema["p_size"].dataType).alias("size_text"), to_text(whole, df.schema["p_retailprice"].dataType).alias("price_text"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def constraint_violations(spark, d):
    return ops.duplicates(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def fk_orphans(spark, d):
    return ops.orphans(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_quantity > 2 AND l_tax < 0.08)")
def check_violations(spark, d):
    return table(spark, d, "lineitem").filter("NOT (l_quantity > 2 AND l_tax < 0.08D)").select("l_orderkey", "l_linenumber", "l_quantity")


_VERSIONS = "SELECT event_id, event_id % 20 AS xmin, CASE WHEN event_id % 3 = 0 THEN (event_id * 7) % 20 ELSE 0 END AS xmax FROM events"


@query(f"""WITH v AS ({_VERSIONS}) SELECT event_id, xmin, xmax FROM v
WHERE (xmin = 7 OR (xmin % 4 <> 1 AND xmin < 15)) AND NOT (xmax <> 0 AND (xmax = 7 OR (xmax % 4 <> 1 AND xmax < 15)))""")
def mvcc_visible(spark, d):
    versions = table(spark, d, "events").selectExpr("event_id", "event_id % 20 AS xmin", "CASE WHEN event_id % 3 = 0 THEN (event_id * 7) % 20 ELSE 0 END AS xmax")
    known = spark.range(20).selectExpr("id AS xid", "CASE WHEN id % 4 = 1 THEN 'aborted' ELSE 'committed' END AS status")
    return ops.visible(versions, known, 7, 15)


@query("SELECT p_partkey, p_size * 2 + 1 AS odd FROM part")
def sql_udf(spark, d):
    register(spark, d, ("part",))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION doubled(x INT) RETURNS INT RETURN x * 2 + 1")
    return spark.sql("SELECT p_partkey, doubled(p_size) AS odd FROM part")


@query("SELECT p_partkey, p_brand FROM part WHERE p_size = 9")
def table_udf(spark, d):
    register(spark, d, ("part",))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION of_size(n INT) RETURNS TABLE (p_partkey BIGINT, p_brand STRING) RETURN SELECT p_partkey, p_brand FROM part WHERE p_size = n")
    return spark.sql("SELECT p_partkey, p_brand FROM of_size(9)")


@query("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT CAST(n AS BIGINT) AS n FROM r")
def recursive_cte(spark, d):
    return spark.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT CAST(n AS BIGINT) AS n FROM r")


FLAGSHIP = """SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue by nation."""
    register(spark, folder)
    return spark.sql(FLAGSHIP)


def _same(text: str, locked: bool):
    from ..dialect import Dialect

    def run(spark: SparkSession, folder: str) -> DataFrame:
        register(spark, folder)
        return spark.sql(Dialect(spark).query(text + (" FOR UPDATE OF nation NOWAIT" if locked else "")))

    return run


QUERIES = {k: _same(v, k.startswith("for_update")) for k, v in SAME.items()} | {k: f for k, (f, _) in (DIFFERENT | STATEMENTS).items()} | {"revenue_by_nation": flagship}
ORACLES = SAME | {k: o for k, (_, o) in (DIFFERENT | STATEMENTS).items()} | {"revenue_by_nation": FLAGSHIP}
