"""Token-ID output in Arrow's stream format with fixed-size-list batches.

Documents are encoded, each is closed by an end id, and the ids of all documents, in ascending doc_id
order, are cut into sequences of equal length. A file holds record batches of equal row counts with two
fixed-size-list columns, `ids` (uint16 where every id of the vocabulary fits, else uint32) and `mask`
(bits: 1 for an id, 0 for padding). A reader maps the file and finds any sequence or any document's ids without a copy: sequence i lies in batch
i // rows at row i % rows, and a list column's values are one flat buffer.

A shard is written by one task under its final name through a rename, so a repeated task leaves the
same file. Beside the shards stands a Parquet table `documents` of (doc_id, shard, first, n_tokens).
"""
from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import input_bytes, new_path, partitions_for
from .pretokens import BytePairEncoder
from .wordhash import row_blocks

LENGTH = 1024
BATCH_ROWS = 64
END_ID = 0


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared path: whatever Arrow reaches by URI, or a plain local one."""
    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Cuts a stream of ids into equal sequences and writes them in batches of equal row counts."""

    def __init__(self, target, length: int, rows: int, kind: type = np.uint32):
        self.length, self.rows, self.kind, self.parts, self.held, self.total = length, rows, kind, [], 0, 0
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(kind), False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))], {b"batch_rows": str(rows).encode()})
        self.out = pa.ipc.new_stream(target, self.schema)

    def _batch(self, ids: np.ndarray) -> None:
        size = self.length * self.rows
        block, mask = np.zeros(size, self.kind), np.arange(size) < len(ids)
        block[:len(ids)] = ids
        cut = lambda values, kind: pa.FixedSizeListArray.from_arrays(pa.array(values), type=self.schema.field(kind).type)
        self.out.write_batch(pa.RecordBatch.from_arrays([cut(block, "ids"), cut(mask, "mask")], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.kind))
        self.held += len(ids)
        self.total += len(ids)
        size = self.length * self.rows
        if self.held >= size:
            flat = np.concatenate(self.parts)
            whole = len(flat) // size * size
            for at in range(0, whole, size):
                self._batch(flat[at:at + size])
            self.parts, self.held = [flat[whole:].copy()], len(flat) - whole

    def close(self) -> None:
        if self.held:
            self._batch(np.concatenate(self.parts))
        self.out.close()


class ShardReader:
    """Random access to a shard's sequences and to ids by position; local files are mapped, not read."""

    def __init__(self, uri: str):
        place, path = _place(uri)
        self.source = pa.memory_map(path) if isinstance(place, fs.LocalFileSystem) else place.open_input_file(path)
        with pa.ipc.open_stream(self.source) as stream:
            self.length, self.rows = stream.schema.field("ids").type.list_size, int(stream.schema.metadata[b"batch_rows"])
            self.batches = list(stream)

    def __len__(self) -> int:
        return len(self.batches) * self.rows

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence i, both views of the file; the mask is one bit an id."""
        b, r = divmod(i, self.rows)
        ids, mask = (self.batches[b].column(k).flatten().slice(r * self.length, self.length) for k in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def ids(self, first: int, n: int) -> Iterator[np.ndarray]:
        """Views that together hold the n ids from position first on."""
        size = self.length * self.rows
        while n > 0:
            b, at = divmod(first, size)
            part = self.batches[b].column(0).flatten().to_numpy(zero_copy_only=True)[at:at + n]
            yield part
            first, n = first + len(part), n - len(part)


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, length: int = LENGTH, rows: int = BATCH_ROWS, end_id: int = END_ID) -> str:
    """Encode docs (doc_id, text; null text as empty) into shards at path; returns the path.

    Rows are range-partitioned and sorted by doc_id (null first), equal ones by text, so shards follow
    each other in order. An empty table gives an empty `documents` table and no shards.
    """
    spark = docs.sparkSession
    path, tokenizer = path or new_path(spark, "tokens"), tokenizer or tokenizer_path()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = partitions_for(spark, input_bytes(docs))
    ordered = slim.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = None
        shard = TaskContext.get().partitionId()
        place, folder = _place(path)
        final, draft = f"{folder}/shard-{shard:06d}.arrows", f"{folder}/.{shard:06d}-{uuid.uuid4().hex}"
        sink = writer = None
        for batch in batches:
            for part in row_blocks(batch, "text", 1 << 20):
                if writer is None:
                    encoder = BytePairEncoder(tokenizer)
                    place.create_dir(folder, recursive=True)
                    sink = place.open_output_stream(draft)
                    writer = ShardWriter(sink, length, rows, np.uint16 if max(encoder.vocabulary(), end_id) < 1 << 16 else np.uint32)
                ids, offsets = encoder.encode(part.column(1))
                sizes = np.diff(offsets) + 1
                flat = np.full(len(ids) + len(sizes), end_id, np.uint32)
                keep = np.ones(len(flat), bool)
                keep[np.cumsum(sizes) - 1] = False
                flat[keep] = ids
                first = writer.total + np.cumsum(sizes) - sizes
                writer.add(flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(sizes), shard, np.int32)), pa.array(first), pa.array(sizes)], names=schema.names)
        if writer is not None:
            writer.close()
            sink.close()
            place.move(draft, final)

    ordered.mapInArrow(run, schema).write.parquet(f"{path}/documents")
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a written set: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it. The ids come from the mapped shards; crc32 is taken
    over them as little-endian unsigned 32-bit integers. Only totals by shard reach the driver.
    """
    documents = spark.read.schema("doc_id long, shard int, first long, n_tokens long").parquet(f"{path}/documents")
    ends = {r["shard"]: r["n"] for r in documents.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    before, total = {}, 0
    for shard in sorted(ends):
        before[shard] = total
        total += ends[shard]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, reader = None, None
        for batch in batches:
            shard, first, n = (batch.column(k).to_numpy() for k in (1, 2, 3))
            crc = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                if shard[i] != open_shard:
                    open_shard, reader = shard[i], ShardReader(f"{path}/shard-{shard[i]:06d}.arrows")
                value = 0
                for part in reader.ids(int(first[i]), int(n[i])):
                    value = zlib.crc32(part.astype("<u4"), value)
                crc[i] = value
            start = first + np.array([before[s] for s in shard.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start), pa.array(n), pa.array(crc)], names=schema.names)

    return documents.mapInArrow(run, schema)


def local_shards(path: str) -> list[str]:
    """Paths of a local set's shards, in order."""
    folder = path.removeprefix("file://")
    return [str(Path(folder, f)) for f in sorted(os.listdir(folder)) if f.startswith("shard-")]
