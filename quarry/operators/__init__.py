"""Relational operators that Spark lacks a name for, as DataFrame compositions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that come more than once, with their count; keys with a NULL member are exempt."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null key has no parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("__p")).distinct(), F.col(key) == F.col("__p"), "left_anti")


def visible(versions: DataFrame, transactions: DataFrame, me: int, horizon: int) -> DataFrame:
    """Row versions (xmin, xmax, ...) that transaction `me` sees under a snapshot that ends at `horizon`.

    transactions (xid, status) is a small dimension. A version is seen if its maker is `me`, or committed
    and below the horizon, and its remover is nobody, or neither `me` nor committed below the horizon.
    """
    done = transactions.filter("status = 'committed'").select("xid")
    v = versions.join(done.withColumnRenamed("xid", "__a"), F.col("xmin") == F.col("__a"), "left").join(done.withColumnRenamed("xid", "__b"), F.col("xmax") == F.col("__b"), "left")
    made = (F.col("xmin") == me) | (F.col("__a").isNotNull() & (F.col("xmin") < horizon))
    gone = (F.col("xmax") != 0) & ((F.col("xmax") == me) | (F.col("__b").isNotNull() & (F.col("xmax") < horizon)))
    return v.filter(made & ~F.coalesce(gone, F.lit(False))).drop("__a", "__b")


#: Rows of the lists and of the groups that `dealt_join` pairs, and of its result for each task.
BLOCK, TASK_ROWS = 4096, 100_000_000


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], block: int = BLOCK, task_rows: int = TASK_ROWS) -> DataFrame:
    """Inner join on few keys, whose result is many times its inputs. Spark deals a join by its inputs' bytes or by its
    keys, so one task may make all rows. Here both sides' rows of a key are cut into blocks of about `block` rows, and
    pairs of blocks are dealt to as many tasks as the result needs. A row meets each block as a list, so no
    more than a list's rows are held for it. Of the sizes only the result's reaches the driver."""
    def numbered(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__at", F.xxhash64(F.monotonically_increasing_id()))

    def blocks(n: str):
        return F.ceil(F.col(n) / block)

    sizes = left.groupBy(*keys).agg(F.count("*").alias("__l")).join(right.groupBy(*keys).agg(F.count("*").alias("__r")), keys)
    total = int(sizes.agg(F.sum(F.col("__l").cast("decimal(20,0)") * F.col("__r"))).first()[0] or 0)
    tasks = max(1, -(-total // task_rows), min(4 * left.sparkSession.sparkContext.defaultParallelism, total // 2_000_000))
    pair = [*keys, "__i", "__j"]
    of = [c for c in right.columns if c not in keys]
    rows = (numbered(left).join(sizes, keys).withColumn("__i", F.pmod("__at", blocks("__l"))).withColumn("__j", F.explode(F.sequence(F.lit(0), blocks("__r") - 1)))
            .select(*pair, *[c for c in left.columns if c not in keys]).repartition(tasks, *pair))
    lists = (numbered(right).join(sizes, keys).withColumn("__j", F.pmod("__at", blocks("__r"))).groupBy(*keys, "__j")
             .agg(F.collect_list(F.struct(*of)).alias("__rows"), F.first("__l").alias("__l")).withColumn("__i", F.explode(F.sequence(F.lit(0), blocks("__l") - 1)))
             .select(*pair, "__rows").repartition(tasks, *pair))
    return rows.join(lists, pair).select(*left.columns, F.inline("__rows"))
