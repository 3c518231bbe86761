"""Benchmark decontamination by winnowing.

Every K-gram of words is hashed, and of each SPAN-word window, which holds W K-grams, the minimum hash is kept
as its fingerprint (the same one for runs of windows, so a text keeps few). Equal windows have equal
fingerprints, so every shared span of K + W - 1 = 8 words or more shares one. Fingerprints of documents are
joined with those of the benchmark, and in the same equi-join a hit is extended over the window's other words:
the key is the pair (fingerprint, hash of the window's words), 128 bits together. A longer shared span is the
union of its windows. Items of fewer than 8 words are one window, shorter than the guarantee; their whole
sequence is its own fingerprint.

Equal windows of a text are one row with all their places, so repeated words cost no more than other ones, and
no pairs of places are ever made. What reaches every task is a bit filter of the benchmark's hashes, MOST_BITS
at most; a benchmark that fills it costs more candidates in the join, never results. Neither items nor
documents are collected.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import staged
from .tables import lowered, row_key, text_of, unique_name
from .wordhash import ALNUM, mix, row_blocks, words_of

SPAN = 8
K = 5
W = SPAN - K + 1
#: The filter's size at most, in bits (8 MiB), and its bits for each benchmark window below that.
MOST_BITS, BITS_EACH = 1 << 26, 16
_GRAM, _WINDOW = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def gram_hashes(words: np.ndarray, at: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of the n words from each place on."""
    out = np.full(len(at), n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(base) + words[at + i]
    return mix(out)


def winnowed(words: np.ndarray) -> np.ndarray:
    """For each place with SPAN words from it on: the minimum hash of its window's K-grams."""
    if len(words) < SPAN:
        return np.zeros(0, np.uint64)
    grams = gram_hashes(words, np.arange(len(words) - K + 1), K, _GRAM)
    return np.minimum.reduce([grams[i:len(grams) - W + 1 + i] for i in range(W)])


def _starts(first: np.ndarray, n: int) -> np.ndarray:
    """Places that have n words of their own row from them on."""
    length = np.diff(first)
    ok = np.zeros(int(first[-1]) + 1, np.int32)
    rows = np.flatnonzero(length >= n)
    ok[first[:-1][rows]] += 1
    ok[first[1:][rows] - n + 1] -= 1
    return np.flatnonzero(np.cumsum(ok)[:-1] > 0)


def _windows(words: np.ndarray, first: np.ndarray, n: int, known=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, fingerprint, extension) of the n-word windows; known(hash) drops those that can't be in the benchmark."""
    at = _starts(first, n)
    prints = winnowed(words)[at] if n == SPAN else gram_hashes(words, at, n, _GRAM)
    if known is not None:
        some = known(prints)
        at, prints = at[some], prints[some]
    more = gram_hashes(words, at, n, _WINDOW)
    if known is not None:
        some = known(more)
        at, prints, more = at[some], prints[some], more[some]
    return at, prints, more


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(print, more, n, item): the distinct windows of each item; null ids count as '', null texts have no words."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, "text"):
                _, _, _, first, words = words_of(part.column(1), ALNUM)
                length = np.diff(first)
                for n in range(1, SPAN + 1):
                    whole = np.flatnonzero((length == n) if n < SPAN else (length >= SPAN))
                    if not len(whole):
                        continue
                    at, prints, more = _windows(words, first, n)
                    row = np.searchsorted(first, at, side="right") - 1
                    own = np.isin(row, whole)
                    every = np.unique(np.stack([row[own].astype(np.uint64), prints[own], more[own]], 1), axis=0)
                    item = part.column(0).take(pa.array(every[:, 0].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(every[:, 1].view(np.int64)), pa.array(every[:, 2].view(np.int64)), pa.array(np.full(len(every), n, np.int32)), item], names=["print", "more", "n", "item"])

    return staged(rows.mapInArrow(run, "print long, more long, n int, item string").distinct(), "benchmark-windows")


def _bit_filter(windows: DataFrame, n: int) -> np.ndarray:
    """Bits of both hashes of all n windows, as 64-bit words; the number of words is a power of two, MOST_BITS / 64 at most."""
    size = 1 << 10
    while size < MOST_BITS and size < 2 * BITS_EACH * n:
        size *= 2
    place = F.explode(F.array("print", "more")).alias("h")
    words = windows.select(place).select(F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(size // 64 - 1)).alias("word"), F.col("h").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _candidates(docs: DataFrame, windows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, key, n_words and, of each text, its windows that the filter lets through: (print, more, n, places)."""
    spark = docs.sparkSession
    counts = {r["n"]: r["count"] for r in windows.groupBy("n").count().collect()}  # eight rows at most
    bits, lengths = spark.sparkContext.broadcast(_bit_filter(windows, sum(counts.values()))), sorted(counts)  # MOST_BITS at most
    rows = docs.select(*keep, row_key(text).alias("key"), text_of(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_words", T.LongType()),
                           T.StructField("found", T.ArrayType(T.StructType([T.StructField("print", T.LongType()), T.StructField("more", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("places", T.BinaryType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        known = lambda h: (table[((h >> np.uint64(6)) & np.uint64(len(table) - 1)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) > 0
        for batch in batches:
            for part in row_blocks(batch, "_text"):
                _, _, _, first, words = words_of(part.column(part.num_columns - 1), ALNUM)
                at, prints, more, size = [np.concatenate(x) for x in zip(
                    *[(*w, np.full(len(w[0]), n, np.int32)) for n in lengths for w in [_windows(words, first, n, known)]], [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)])]
                row = np.searchsorted(first, at, side="right") - 1
                order = np.lexsort((at, size, more, prints, row))
                at, prints, more, size, row = at[order], prints[order], more[order], size[order], row[order]
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (prints[1:] != prints[:-1]) | (more[1:] != more[:-1]) | (size[1:] != size[:-1])
                group = np.flatnonzero(new)
                places = (at - first[row]).astype(np.int32)
                edges = np.append(group, len(at)).astype(np.int32) * 4
                struct = pa.StructArray.from_arrays([pa.array(prints[group].view(np.int64)), pa.array(more[group].view(np.int64)), pa.array(size[group]), pa.Array.from_buffers(pa.binary(), len(group), [None, pa.py_buffer(edges), pa.py_buffer(places)])], names=["print", "more", "n", "places"])
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[group], np.arange(part.num_rows + 1)).astype(np.int32)), struct)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(first)), found], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n_hit of rows key, found (n, places): words that lie in any of a text's windows."""
    for batch in batches:
        n_hit = []
        for windows in batch.column(1).to_pylist():
            places = np.concatenate([np.frombuffer(w["places"], np.int32) for w in windows])
            ends = np.concatenate([np.frombuffer(w["places"], np.int32) + w["n"] for w in windows])
            edge = np.zeros(int(ends.max()) + 1, np.int64)
            np.add.at(edge, places, 1)
            np.add.at(edge, ends, -1)
            n_hit.append(int((np.cumsum(edge) > 0).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_hit, pa.int64())], names=["key", "n_hit"])


def _hits(candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """key, n_hit, items of the texts that hold a window of the benchmark; equal texts are one row.

    What is gathered for a key is one text's own windows and its own items.
    """
    texts = candidates.filter(F.size("found") > 0).select("key", "found").dropDuplicates(["key"])
    rows = texts.select("key", F.explode("found").alias("f")).select("key", "f.*")
    # Items may share a window: it meets the documents once, and its items only where it is found.
    met = staged(rows.join(windows.select("print", "more", "n").distinct(), ["print", "more", "n"]), "benchmark-hits")
    key = met.schema["key"].dataType
    n_hit = met.groupBy("key").agg(F.collect_list(F.struct("n", "places")).alias("found")).mapInArrow(_covered, T.StructType([T.StructField("key", key), T.StructField("n_hit", T.LongType())]))
    items = met.select("key", "print", "more", "n").join(windows, ["print", "more", "n"]).select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return n_hit.join(items, "key")


def _filled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def overlap_counts(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs with `n_words`, `n_hit` and `items`, as `find_overlaps` gives them, without the texts:
    these are read once and never shuffled."""
    windows = benchmark_windows(benchmark)
    kept = [F.col(f"`{c}`").alias(f"_kept{k}") for k, c in enumerate(keep)]
    rows = staged(_candidates(docs.select(*kept, F.col(f"`{text}`").alias("_source")), windows, "_source", [f"_kept{k}" for k in range(len(keep))]), "fingerprints")
    filled = _filled(rows.drop("found").join(_hits(rows, windows), "key", "left"))
    return filled.select(*[F.col(f"_kept{k}").alias(c) for k, c in enumerate(keep)], "n_words", "n_hit", "items")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs with `n_words` (long), `n_hit` (long) and `items` (array of item ids as strings, sorted).

    Null texts have no words. Items without words or text match nothing; a null item_id counts as ''.
    Equal item_ids are one item, and repeated rows of docs get the same result each. Columns of these names are
    replaced. Texts without a hit are matched with none by a left join: Spark broadcasts the hits where their
    written size is under its threshold and sorts both sides where it isn't.
    """
    windows = benchmark_windows(benchmark)
    key = unique_name(docs, "_overlap_key")
    hits = staged(_hits(staged(_candidates(docs, windows, text, []).filter(F.size("found") > 0), "fingerprints"), windows), "overlaps").withColumnRenamed("key", key)
    rows = docs.drop("n_words", "n_hit", "items").withColumn(key, row_key(text))
    n_words = F.regexp_count(lowered(text_of(text)), F.lit(_WORDS)).cast("long")
    return _filled(rows.withColumn("n_words", n_words).join(hits, key, "left")).drop(key)


def contaminated(least: int = 2) -> Column:
    """A document is contaminated when windows of `least` items or more occur in it."""
    return F.size("items") >= least
