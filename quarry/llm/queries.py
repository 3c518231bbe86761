"""The registered queries of this subpackage: each applies one operator to its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated, overlap_counts
from .exact_dedup import exact_dedup
from .mixing import mix_plan, slim_rows
from .near_dedup import near_components
from .passages import remove_repeats
from .quality import SAMPLE as QUALITY_SAMPLE
from .quality import fit_quality, score_quality
from .secret_scan import BASE, scan, span_text
from .storage import staged
from .tables import held_out, labelled_sample, read, text_of
from .token_files import read_tokens, write_tokens
from .toxicity import SAMPLE as TOXIC_SAMPLE
from .toxicity import fit_toxicity, score_toxicity
from .warc import build_derivatives, read_derivatives


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and words taken of all documents. A null text has size 0, a null source is one of its own, equal rows are drawn separately; no documents give no rows."""
    slim = staged(slim_rows(read(spark, sf_dir, "documents").select("doc_id", "source", "text")), "mix-rows")
    return mix_plan(slim).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken_times", (F.col("taken_times") * F.col("size")).alias("taken"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest groups of all documents, added to a new index in two batches of falling doc_id. Null and empty texts are equal; rows that share text and doc_id are all kept; no documents give no rows."""
    return exact_dedup(read(spark, sf_dir, "documents"), batches=2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of whole texts, null as empty. Null labels and labels of null doc_ids are left out, repeated ones count as their maximum; without labels of both classes every score is the classes' share."""
    docs = read(spark, sf_dir, "documents")
    model = fit_toxicity(staged(labelled_sample(docs, read(spark, sf_dir, "labels"), "toxic", TOXIC_SAMPLE), "toxic-sample"))
    scored = score_toxicity(docs.select("doc_id", text_of().alias("text")), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy components of all documents by 4-word shingles. Texts that are null or without words are alone; a null doc_id is a component's least only if there is no other; equal rows fall together."""
    rows = near_components(read(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=80)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of whole texts, null as empty. Every row gets its own result, equal ones equal ones; no documents give no rows."""
    rows = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return rows.select("doc_id", *[of(r.kind) for r in BASE], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as responses with their derivatives, read back from the files. Null url or html count as empty; equal rows give equal records; no pages give no rows."""
    return read_derivatives(spark, build_derivatives(read(spark, sf_dir, "pages")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, a row for each, read back. Null texts are empty and have the end id alone; null doc_ids come first; no documents give no rows."""
    return read_tokens(spark, write_tokens(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of whole texts, null as empty. Null labels and labels of null doc_ids are left out, repeated ones count as their maximum; without labels of both classes every score is the classes' share."""
    docs = read(spark, sf_dir, "documents")
    model = fit_quality(staged(labelled_sample(docs, read(spark, sf_dir, "labels"), "quality", QUALITY_SAMPLE), "quality-sample"))
    scored = score_quality(docs.select("doc_id", text_of().alias("text")), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that repeat earlier ones, for all documents. Null texts are empty; rows of equal or null doc_id count in the order in which they lie, null first."""
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents. Null texts have no words; equal item_ids are one item, a null one counts as ''; equal rows get equal results."""
    found = overlap_counts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_exact_dedup, op3_toxicity, op4_near_dedup, op5_secret_scan, op6_warc_derivatives, op7_token_files, op8_quality, op9_repeated_passages, op10_decontaminate,
)}
