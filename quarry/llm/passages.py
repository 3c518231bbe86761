"""Exact repeated-passage removal over UTF-8 bytes, by a column-wise multi-document suffix order.

A byte goes when a SPAN-byte string that covers it also starts earlier in the corpus. Inserting a symbol
of every whole document each round takes as many passes over the collection as the longest document has
bytes, so the collection that is built is one of bounded strings, which hold every repeat:

1. Texts are written once as block files to the shared folder. Of every SPAN-byte string the K-gram
   with the smallest hash is its anchor; equal strings have equal anchors at equal places.
2. Hashes of anchors, one of each and block, meet by hash range; those that occur once in all are done.
3. For each other anchor a block sends the bytes around it that its strings cover, one of equal ones.
4. Strings of an anchor meet and are inserted column by column, aligned at it (`column_bwt`). Neighbours
   with SPAN bytes in common hold the same string; all but the first in corpus order are marked.
5. Marks return to their blocks, where bytes are removed.

A task holds a block, a hash range of bounded size, or a run of whole anchors. The strings of an anchor
that very many blocks share are keyed by each SPAN-byte string alone, in corpus order, so that a run may
end within them: the first of a string is remembered and its others are marked as they come.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .column_bwt import Files, columns
from .storage import new_path, partitions_for, remove, staged
from .wordhash import _ODD, _powers, mix, row_blocks, span_hashes, text_bytes

SPAN, K = 100, 32
#: K-grams in a SPAN-byte string; also the column of the anchor in an aligned string.
WINDOW = SPAN - K + 1
WIDTH = WINDOW - 1 + SPAN
BLOCK = 4 << 20
#: Bytes of hashes in a range, strings that are inserted together, blocks that make an anchor hot.
RANGE_BYTES, RUN, HOT = 32 << 20, 1 << 15, 2048
_SLICE = 1 << 20


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, anchor, first start, last start): runs of SPAN-byte strings with one anchor.

    Strings lie within a row. Ties of a hash go to the left; the run's starts are consecutive.
    """
    n = len(data)
    inside = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= SPAN)
    inside[offsets[:-1][long]] += 1
    inside[offsets[1:][long] - SPAN + 1] -= 1
    inside = np.cumsum(inside, dtype=np.int8)[:n].astype(bool)
    out: list[tuple] = []
    low_bits = np.uint64(_SLICE - 1)
    inverse = pow(_ODD, -1, 1 << 64)
    for at in range(0, max(0, n - SPAN + 1), _SLICE - SPAN):
        part = data[at:at + _SLICE]
        starts = min(_SLICE - SPAN, len(part) - SPAN + 1)
        if starts <= 0 or not inside[at:at + starts].any():
            continue
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(len(part), _ODD)[:len(part)], dtype=np.uint64)])
            grams = mix((sums[K:] - sums[:-K]) * _powers(len(part) + 1, inverse)[:len(sums) - K])
        best = (grams & ~low_bits) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= WINDOW:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if span < WINDOW:
            best = np.minimum(best[:len(best) - (WINDOW - span)], best[WINDOW - span:])
        here = np.flatnonzero(inside[at:at + starts])
        anchor = (best[here] & low_bits).astype(np.int64)
        new = np.ones(len(here), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (here[1:] != here[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(here)) - 1
        out.append((grams[anchor[first]], anchor[first] + at, here[first] + at, here[last] + at))
    if not out:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


class _Block:
    """A block file's texts with their anchors, and the strings that its repeated anchors send."""

    def __init__(self, path: str, block: int):
        place, folder = fs.FileSystem.from_uri(path)
        with place.open_input_file(f"{folder}/{block:012d}.arrow") as f:
            table = pa.ipc.open_file(f).read_all()
        self.doc_id = table.column(0).combine_chunks()
        self.data, self.offsets = text_bytes(table.column(1))
        self.hash, self.anchor, self.first, self.last = anchored(self.data, self.offsets)

    def strings(self, repeated: np.ndarray, hot: np.ndarray):
        """(key, start, end, column, distinct number) of the runs to compare, in text order.

        Runs of hot anchors are cut into single strings, whose key is their own hash, made odd; other
        keys are made even."""
        found = np.flatnonzero(_within(self.hash, repeated))
        key, first, last, column = self.hash[found], self.first[found], self.last[found], WINDOW - 1 - (self.anchor - self.first)[found]
        cut = _within(key, hot)
        if cut.any():
            times = np.where(cut, last - first + 1, 1)
            row = np.repeat(np.arange(len(key)), times)
            step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            single = cut[row]
            first, last, column = first[row] + step, np.where(single, first[row] + step, last[row]), np.where(single, WINDOW - 1, column[row])
            key = key[row]
            key[single] = span_hashes(self.data, first[single], first[single] + SPAN) | np.uint64(1)
            key[~single] &= ~np.uint64(1)
        else:
            key = key & ~np.uint64(1)
        end = last + SPAN
        with np.errstate(over="ignore"):
            same = mix(key * np.uint64(3) + span_hashes(self.data, first, end) + mix(column.astype(np.uint64)))
        _, at, number = np.unique(same, return_index=True, return_inverse=True)
        return key, first, end, column, at, number


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[start:end] of each pair as a binary array."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[index])]).cast(pa.binary())


def _write_blocks(docs: DataFrame, path: str) -> DataFrame:
    """(block, bytes) of the block files; a block's rows are sorted by doc_id, null first, equal ones as they lie."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        place, folder = fs.FileSystem.from_uri(path)
        place.create_dir(folder, recursive=True)
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            draft = f"{folder}/.{uuid.uuid4().hex}"
            table = pa.Table.from_batches(held).combine_chunks()
            table = table.take(pc.sort_indices(table, [("doc_id", "ascending")], null_placement="at_start"))
            with place.open_output_stream(draft) as f, pa.ipc.new_file(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            place.move(draft, f"{folder}/{number:012d}.arrow")
            made = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size])], names=["block", "bytes"])
            held, size, number = [], 0, number + 1
            return made

        for batch in batches:
            for part in row_blocks(batch, "text", BLOCK // 4):
                n = int(text_bytes(part.column(1))[1][-1])
                if held and size + n > BLOCK:
                    yield flush()
                held.append(part)
                size += n
        if held:
            yield flush()

    return staged(rows.mapInArrow(run, "block long, bytes long"), "blocks")


def range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of each anchor, of `parts` even ones. Anchors are least hashes, which crowd at 0, so they are hashed again."""
    return (mix(hashes) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _repeated_anchors(blocks: DataFrame, path: str, parts: int) -> DataFrame:
    """(block, repeated, hot): the anchors' hashes of each block that occur elsewhere, by hash range."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                hashes, n = np.unique(_Block(path, block).hash, return_counts=True)
                part = range_of(hashes, parts)
                by = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[by], np.arange(parts + 1))
                used = np.unique(part).astype(np.int32)
                own = [by[edges[p]:edges[p + 1]] for p in used]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), block)), pa.array([hashes[o].tobytes() for o in own], pa.binary()), pa.array([np.packbits(n[o] > 1).tobytes() for o in own], pa.binary())], names=["part", "block", "hashes", "several"])

    def meet(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(h)) for b, h in zip(table.column("several").to_pylist(), blobs)]).astype(bool)
        hashes = np.concatenate(blobs)
        order = np.argsort(hashes, kind="stable")
        sorted_hashes = hashes[order]
        edge = np.flatnonzero(np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]]))
        times = np.repeat(np.diff(np.append(edge, len(order))), np.diff(np.append(edge, len(order))))
        again = np.zeros(len(hashes), bool)
        again[order] = times > 1
        hot = np.zeros(len(hashes), bool)
        hot[order] = times > HOT
        again |= several
        block = table.column("block").to_pylist()
        edges = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
        own = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
        picked = [x for s, o in enumerate(own) if (x := (block[s], hashes[o][again[o]].tobytes(), hashes[o][hot[o]].tobytes()))[1]]
        return pa.table({"block": pa.array([x[0] for x in picked], pa.int64()), "repeated": pa.array([x[1] for x in picked], pa.binary()), "hot": pa.array([x[2] for x in picked], pa.binary())})

    sent = blocks.select("block").repartition(partitions_for(blocks.sparkSession, 0)).mapInArrow(send, "part int, block long, hashes binary, several binary")
    return sent.repartition(parts, "part").groupBy("part").applyInArrow(meet, "block long, repeated binary, hot binary")


def _joined(blobs: list) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b, np.uint64) for b in blobs if b)]))


def _sent_strings(anchors: DataFrame, path: str, parts: int) -> DataFrame:
    """One row for each distinct string of a block: key, block, number, col, bytes and its first place."""
    names = ["key", "block", "number", "col", "bytes", "doc_id", "idx", "pos"]

    def send(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        block = _Block(path, number)
        key, first, end, column, at, of = block.strings(_joined(table.column("repeated").to_pylist()), _joined(table.column("hot").to_pylist()))
        row = np.searchsorted(block.offsets, first[at], side="right") - 1
        return pa.table([
            pa.array(key[at].view(np.int64)), pa.array(np.full(len(at), number)), pa.array(np.arange(len(at), dtype=np.int32)), pa.array(column[at].astype(np.int16)), _gather(block.data, first[at], end[at]),
            block.doc_id.take(pa.array(row)), pa.array(row.astype(np.int32)), pa.array((first[at] - block.offsets[row]).astype(np.int64)),
        ], names=names)

    return anchors.repartition(parts, "block").groupBy("block").applyInArrow(send, "key long, block long, number int, col short, bytes binary, doc_id long, idx int, pos long")


def mark_repeats(text: pa.Array, column: np.ndarray, folder: str) -> np.ndarray:
    """For strings in corpus order, aligned at their columns: a row of WINDOW flags each, of the SPAN-byte
    strings it covers that one before it covers too. Of strings with equal bytes and column the first is
    inserted; the others repeat it whole. Files of the rounds lie in a folder of `folder` while this runs."""
    code = text.dictionary_encode().indices.to_numpy().astype(np.int64)
    own = np.sort(np.unique(code * WIDTH + column, return_index=True)[1])
    flags = np.arange(WINDOW) <= pc.binary_length(text).to_numpy().astype(np.int64)[:, None] - SPAN
    column = column[own]
    data, offsets = text_bytes(text.take(pa.array(own)))
    n, size = len(own), np.diff(offsets)
    end = column + size
    matrix = np.zeros(n * WIDTH, np.uint8)
    matrix[np.repeat(np.arange(n) * WIDTH + column - offsets[:-1], size) + np.arange(len(data))] = data
    matrix = np.asfortranarray(matrix.reshape(n, WIDTH))
    marks = np.zeros((2 * WINDOW, n), bool)
    with Files(folder) as files:
        for c, order, common in columns(matrix, files):
            if c >= WINDOW:
                continue  # too near the end for SPAN bytes
            near = common >= SPAN
            several = near.copy()
            several[:-1] |= near[1:]
            at = np.flatnonzero(several)
            row, group = order[at], np.cumsum(~near[at])
            inside = (column[row] <= c) & (c + SPAN <= end[row])
            row, group = row[inside], group[inside]
            if len(row):
                edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                first = np.repeat(np.minimum.reduceat(row, edge), np.diff(np.append(edge, len(row))))
                marks[c, row[row != first]] = True
    flags[own] = marks[column[:, None] + np.arange(WINDOW), np.arange(n)[:, None]]
    return flags


def _marked(strings: DataFrame, partitions: int, path: str) -> DataFrame:
    """(block, numbers, marks): marks of the strings, back by block."""
    order = ["key", "doc_id", "block", "idx", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        first: tuple[int, bytes] | None = None  # of a single string, whose run may have been cut

        def out(table: pa.Table) -> pa.RecordBatch:
            nonlocal first
            text, key = table.column("bytes").combine_chunks(), table.column("key").to_numpy()
            column = table.column("col").to_numpy().astype(np.int64)
            lead = 1 if first is not None and key[0] == first[0] else 0
            marks = mark_repeats(pa.concat_arrays([pa.array([first[1]], text.type), text]) if lead else text, np.concatenate([np.full(lead, WINDOW - 1), column]), f"{path}/rounds")[lead:]
            single = key[-1] & 1 and len(text[-1].as_py()) == SPAN
            if single:
                start = int(np.searchsorted(key, key[-1]))
                first = first if lead and start == 0 else (int(key[-1]), text[start].as_py())
            else:
                first = None
            marked = np.flatnonzero(marks.any(axis=1))
            block, number = table.column("block").to_numpy()[marked], table.column("number").to_numpy()[marked]
            by = np.argsort(block, kind="stable")
            edge = np.flatnonzero(np.diff(block[by], prepend=-1))
            cut = [by[a:b] for a, b in zip(edge, np.append(edge[1:], len(by)))]
            raw = np.packbits(marks[marked], axis=1)
            return pa.RecordBatch.from_arrays([pa.array([int(block[c[0]]) for c in cut], pa.int64()), pa.array([number[c].astype(np.int32).tobytes() for c in cut], pa.binary()), pa.array([raw[c].tobytes() for c in cut], pa.binary())], names=["block", "numbers", "marks"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= RUN:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("key").to_numpy()
                cut = len(key) if key[-1] & 1 and key[0] == key[-1] else int(np.searchsorted(key, key[-1]))
                if cut:
                    yield out(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = len(key) - cut
        if size:
            yield out(pa.Table.from_batches(held).combine_chunks())

    return strings.repartition(partitions, "key").sortWithinPartitions(*order).mapInArrow(run, "block long, numbers binary, marks binary")


def _removal(block: _Block, repeated: np.ndarray, hot: np.ndarray, numbers: list, marks: list) -> np.ndarray:
    """Flag of each byte of a block that goes."""
    n = len(block.data)
    edge = np.zeros(n + 1, np.int64)
    if len(repeated):
        _, first, end, _, at, of = block.strings(repeated, hot)
        flags = np.zeros((len(at), -(-WINDOW // 8)), np.uint8)
        for a, b in zip(numbers, marks):
            if a:
                flags[np.frombuffer(a, np.int32)] = np.frombuffer(b, np.uint8).reshape(-1, flags.shape[1])
        flags = np.unpackbits(flags, axis=1, count=WINDOW).astype(bool)
        again = np.ones(len(first), bool)  # all but a distinct string's first place repeat it
        again[at] = False
        for low in range(0, len(first), 20_000):
            own = slice(low, low + 20_000)
            starts = end[own] - first[own] - SPAN + 1  # SPAN-byte strings in each
            row = np.repeat(np.arange(len(starts)), starts)
            step = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
            gone = again[own][row] | flags[of[own][row], step]
            place = (first[own][row] + step)[gone]
            edge[place] += 1  # each start lies in one run
            edge[place + SPAN] -= 1
    return np.cumsum(edge)[:n] > 0


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256; with
    texts also `kept` (binary, the bytes that stay) and `spans` (array of start, end in bytes).

    Null texts are empty. Rows come in the order of doc_id, null first; of equal doc_ids the row that lies
    first in the input is the earlier. Texts under SPAN bytes never lose any.
    """
    spark = docs.sparkSession
    path = new_path(spark, "texts")
    blocks = _write_blocks(docs, path)
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    partitions = partitions_for(spark, total // 4)
    by_block = partitions_for(spark, total)  # counted, as the rows that come are far smaller than the blocks that a task reads
    anchors = staged(_repeated_anchors(blocks, path, max(partitions, int(total * 16 // WINDOW // RANGE_BYTES) + 1)), "anchors")
    results = staged(_marked(_sent_strings(anchors, path, by_block), partitions, path), "marks")
    remove(spark, f"{path}/rounds")  # what lost tasks left
    every = blocks.select("block", *[F.lit(None).cast("binary").alias(c) for c in ("repeated", "hot", "numbers", "marks")])
    empty = lambda df, *none: df.select("block", *[F.lit(None).cast("binary").alias(c) if c in none else F.col(c) for c in ("repeated", "hot", "numbers", "marks")])
    back = every.union(empty(anchors, "numbers", "marks")).union(empty(results, "repeated", "hot"))

    def finish(table: pa.Table) -> pa.Table:
        block = _Block(path, table.column("block")[0].as_py())
        gone = _removal(block, _joined(table.column("repeated").to_pylist()), _joined(table.column("hot").to_pylist()), table.column("numbers").to_pylist(), table.column("marks").to_pylist())
        rows = []
        for low, high in zip(block.offsets[:-1], block.offsets[1:]):
            own, data = gone[low:high], block.data[low:high]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            kept = data[~own].tobytes()
            rows.append((int(high - low), int(own.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept if texts else None, edges.reshape(-1, 2).tolist() if texts else None))
        n, removed, spans, sha, kept, where = zip(*rows)
        out = {"doc_id": block.doc_id, "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha)}
        if texts:
            out |= {"kept": pa.array(kept, pa.binary()), "spans": pa.array(where, pa.list_(pa.list_(pa.int64())))}
        return pa.table(out)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<array<long>>" if texts else "")
    return back.repartition(by_block, "block").groupBy("block").applyInArrow(finish, schema)
