"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a Parquet table with one row per distinct text: its SHA-256 digest and the doc_id that stays. New
data is reduced to one row per digest, anti-joined with the index by sort-merge (the index side is read by
bucket, without an exchange) and the new digests are appended to their buckets, sorted. Where a bucket is one
file, as after the first batch or `compact`, its order is used and the index isn't sorted again.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path, staged
from .tables import lowered, text_of

_COLUMNS = "digest BINARY, keep_id BIGINT"
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"  # lets a scan of one file a bucket keep its order


def digests(docs: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and `digest`: SHA-256 (binary) of the text with A-Z lower-cased, null as empty."""
    return docs.select(*keep, F.unhex(F.sha2(lowered(text_of(column)), 256)).alias("digest"))


class DigestIndex:
    """A digest index at a path of the shared storage; opening an existing path resumes it.

    buckets should put some 100 MB of digests in each; it is fixed when the index is created.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path or new_path(spark, "digests"), buckets
        self.table = "digests_" + re.sub(r"\W", "_", self.path.rsplit("/", 1)[-1])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({_COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame) -> DataFrame:
        """Append the rows of groups (digest, keep_id; one a digest) that the index lacks; these come back.

        A text that the index already has keeps the doc_id that stays there.
        """
        before = self.spark.conf.get(_ORDERED)
        self.spark.conf.set(_ORDERED, "true")
        try:
            fresh = staged(groups.select("digest", "keep_id").hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti"), "fresh")
        finally:
            self.spark.conf.set(_ORDERED, before)
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.mode("append").insertInto(self.table)
        return fresh

    def compact(self) -> DigestIndex:
        """A new index with the same rows, one sorted file a bucket. This one stays as it is."""
        made = DigestIndex(self.spark, buckets=self.buckets)
        self.rows().repartition(self.buckets, "digest").sortWithinPartitions("digest").write.mode("append").insertInto(made.table)
        return made

    def drop(self) -> None:
        """Forget the table's name; the files stay at the path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    group_size is the number of rows of docs with the text. Of equal texts the row with the largest doc_id stays
    (null only if there is no other); of rows that share text and doc_id all are marked kept. Rows whose text a
    resumed index held before are not kept and carry the doc_id that stays there. Null and empty texts are equal.

    docs may be added in several batches of falling doc_id, each against what the ones before it left in the
    index, which bounds what a batch sorts. Groups are counted with a partial aggregation before their shuffle,
    so a hot text arrives once from each task, and AQE may split its partition in the last join. A new index
    leaves no table behind; its files stay at its path.
    """
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    slim = staged(digests(docs), "digests-of-rows")
    groups = staged(slim.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    edges = sorted(groups.approxQuantile("keep_id", [k / batches for k in range(1, batches)], 0.01), reverse=True) if batches > 1 else []
    rest, fresh = F.lit(True), []
    for edge in edges:
        here = rest & F.coalesce(F.col("doc_id") > edge, F.lit(False))
        fresh.append(index.add(slim.filter(here).groupBy("digest").agg(F.max("doc_id").alias("keep_id"))))
        rest = rest & ~F.coalesce(F.col("doc_id") > edge, F.lit(False))
    fresh.append(index.add(slim.filter(rest).groupBy("digest").agg(F.max("doc_id").alias("keep_id"))))
    new = fresh[0]
    for more in fresh[1:]:
        new = new.unionByName(more)
    held = index.rows().join(new.select("digest", F.lit(True).alias("_new")), "digest", "left")
    held = staged(groups.select("digest", "group_size").join(held, "digest").withColumnRenamed("digest", "_d"), "held")
    if own:
        index.drop()
    rows = slim.join(held, F.col("digest") == F.col("_d"))
    kept = F.coalesce(F.col("_new"), F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
