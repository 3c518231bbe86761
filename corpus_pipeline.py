"""The corpus pipeline: raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns that they are given. Columns beside those
of documents pass through all but the last; a table without rows gives one without rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.decontaminate import contaminated, find_overlaps
from quarry.llm.mixing import mix
from quarry.llm.near_dedup import near_dedup
from quarry.llm.quality import SAMPLE, fit_quality, score_quality
from quarry.llm.storage import staged
from quarry.llm.tables import labelled_sample, lowered, read, text_of, unique_name
from quarry.llm.token_files import read_tokens, write_tokens

#: Documents that score less go.
LEAST_QUALITY = 0.3
#: Documents with windows of so many benchmark items go: a passage of a single item is contamination.
LEAST_ITEMS = 1
#: Benchmark items of fewer words are names or phrases and remove nothing.
LEAST_WORDS = 5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on a bounded sample of the labels, doesn't reject. Null texts are
    scored as empty ones; equal rows fare alike; without labels of both classes all have the same score."""
    model = fit_quality(staged(labelled_sample(docs, read(spark, sf_dir, "labels"), "quality", SAMPLE), "quality-sample"))
    score = unique_name(docs, "_quality")
    return score_quality(docs, model, output=score).filter(f"{score} >= {LEAST_QUALITY}").drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more. The smallest doc_id
    stays, a null one only if there is no other; documents without words all stay, equal rows once."""
    return near_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Each item decides by itself: a document goes if a window of it
    occurs, or the whole of an item of LEAST_WORDS to 7 words; a shorter item removes nothing. Null texts have no
    words and stay; equal rows fare alike."""
    words = F.regexp_count(lowered(text_of()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    found = find_overlaps(docs, read(spark, sf_dir, "benchmark").filter(words >= LEAST_WORDS))
    return found.filter(~contaminated(LEAST_ITEMS)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for. A null source is one of its own, a null text has no
    words; of equally long documents a hash of the whole row decides, and equal rows are drawn separately."""
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, null texts as empty, in the order of doc_id, null first; a row for each, read
    back from the files."""
    return read_tokens(spark, write_tokens(docs.select("doc_id", "text")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("token output", token_output),
]
#: A fitted classifier and an encoder are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir, each one's result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage-{k}")
    return docs
