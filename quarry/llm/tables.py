"""Small helpers that the operators share: inputs, null-safe row keys, held-out split, samples."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space in the contracts' word pattern `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lowered(column: Column) -> Column:
    """Lower-case of A-Z only."""
    return F.translate(column, UPPER, LOWER)


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's values, as a pair of 64-bit hashes; nulls take part by position."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True on the fifth of rows that no classifier may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int = 17) -> DataFrame:
    """(text, label) of at most `most` labelled rows that are not held out, chosen by hash of doc_id.

    The bound holds for the sample alone and proves the size of the broadcast side. Repeated labels of
    a doc_id count once, as their maximum; null labels and null doc_ids are left out.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("_label"))
        .filter(F.col("doc_id").isNotNull() & F.col("_label").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    )
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "_label")


def unique_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
