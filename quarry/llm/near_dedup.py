"""MinHash near-dedup by a multi-index Hamming join.

A text's set is its distinct word shingles. Equal sets form a class, which goes on as one. A class has
a signature of POSITIONS MinHash values of b = 16 bits; the distance of two is the number of positions
that differ. By the pigeonhole, of CHUNKS chunks of positions one has at most ERRORS differing
positions in any pair at distance CHUNKS * (ERRORS + 1) - 1 or less, so classes are indexed under every
chunk with every choice of ERRORS positions left out, and all such pairs meet under some key. At
similarity 0.8 a pair differs in 12.8 of 64 positions on average; more than the 27 that are guaranteed
to be found comes up about once in a hundred thousand such pairs, and less the closer they are.

Under a key, members are first paired with its smallest one alone. Confirmed links make components.
Where members of a key are still apart, blocks of them are compared by signature: first each key gives
only a spanning forest of its closest pairs across components, and once these are joined, all pairs
across components within the distance. So no pair is lost, and copies of one text never make all their
pairs. Before texts are fetched, a set's odd sketch rules pairs out: it has BITS bits, and each shingle flips
one, so two sketches differ in no more bits than the sets have shingles that aren't common. A pair whose
sketches differ in more than the similarity allows sets of their sizes is no link, without any error; sketches
of sets of some thousand shingles fill up and rule out less. A link needs the full sets.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import staged
from .tables import row_key, unique_name
from .wordhash import SPACED, mix, row_blocks, words_of

POSITIONS = 64
CHUNKS = 14
ERRORS = 1
#: Largest distance at which every pair is found.
REACH = CHUNKS * (ERRORS + 1) - 1
#: Size of the odd sketch.
BITS = 2048
WORDS, SIMILARITY = 5, 80
#: Members of a key that are compared at once, and the distance of pairs that are probably linked.
BLOCK, CLOSE = 1024, 13
#: Rounds of spanning forests at most; a round without a new pair ends them.
FORESTS = 3
#: Bits of a set's number that are kept at first; tests take few, so that sets collide.
NODE_BITS = 64


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of all texts, row offsets).

    A text with fewer than n words has one shingle, all its words; one without words has none. The
    number of words takes part in the hash.
    """
    _, _, _, first, words = words_of(column, SPACED)
    rows = len(first) - 1
    count = np.diff(first)
    grams = np.zeros(max(0, len(words)), np.uint64)
    row = np.repeat(np.arange(rows), count)
    within = np.arange(len(words)) - first[row] if len(words) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        padded = np.concatenate([words, np.zeros(n, np.uint64)])
        for i in range(n):
            inside = within + i < count[row]
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, padded[i:i + len(words)], np.uint64(0))
    keep = (within + n <= count[row]) | ((within == 0) & (count[row] < n))
    grams, row = mix(grams[keep] + np.minimum(count[row], n)[keep].astype(np.uint64)), row[keep]
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(rows + 1))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(6_364_136)
    return rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


def signatures(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint16 matrix, POSITIONS for each row; rows with an empty set are zero."""
    rows = len(offsets) - 1
    out = np.zeros((rows, POSITIONS), np.uint16)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if not len(full):
        return out
    starts = offsets[:-1][full]
    high = grams ^ (grams >> np.uint64(29))
    with np.errstate(over="ignore"):
        for k, (a, b) in enumerate(zip(*_multipliers())):
            low = np.minimum.reduceat(high * a + b, starts)
            out[full, k] = (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def sketches(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Odd sketches, BITS / 64 words for each row: a bit is set if an odd number of shingles fall on it."""
    rows, each = len(offsets) - 1, BITS // 64
    out = np.zeros(rows * each, np.uint64)
    at = np.repeat(np.arange(rows) * each, np.diff(offsets)) + (grams >> np.uint64(32)).astype(np.int64) % each
    np.bitwise_xor.at(out, at, np.uint64(1) << (grams >> np.uint64(58)))
    return out.reshape(rows, each)


def packed(sig: np.ndarray, sketch: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Signatures as bytes: 16 bits for each of POSITIONS, the odd sketch, then the set's size."""
    return [r.tobytes() for r in np.concatenate([np.ascontiguousarray(x).view(np.uint8) for x in (sig, sketch, size.astype(np.int64)[:, None])], 1)]


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    end = 2 * POSITIONS + BITS // 8
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), end + 8)
    return np.ascontiguousarray(raw[:, :2 * POSITIONS]).view(np.uint16), np.ascontiguousarray(raw[:, 2 * POSITIONS:end]).view(np.uint64), np.ascontiguousarray(raw[:, end:]).view(np.int64)[:, 0]


def near(a: tuple, b: tuple, percent: int) -> np.ndarray:
    """For rows of two unpacked signatures: within the distance, with sketches that differ in no more bits
    than the similarity allows sets of these sizes to differ in."""
    apart = np.maximum(np.bitwise_count(a[1] ^ b[1]).sum(1, dtype=np.int64), np.abs(a[2] - b[2]))
    return ((100 + percent) * apart <= (100 - percent) * (a[2] + b[2])) & ((a[0] != b[0]).sum(1) <= REACH)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """The index keys of each signature: a row for each signature, a column for each chunk and position left out."""
    edges = np.linspace(0, POSITIONS, CHUNKS + 1).astype(int)
    out, values = [], sig.astype(np.uint64)
    with np.errstate(over="ignore"):
        for c, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
            for skip in range(low, high):
                key = np.full(len(sig), (c * POSITIONS + skip + 1) * 0x632BE59BD9B4E019 % (1 << 64), np.uint64)
                for p in range(low, high):
                    if p != skip:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, p])
                out.append(key)
    return np.stack(out, 1) if len(sig) else np.zeros((0, POSITIONS), np.uint64)


def shingled(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, tie, node, check, n_shingles, sig of docs; tie is the row's key, node and check two hashes of the set,
    null without words."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), row_key(*docs.columns).alias("tie"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, "text", 1 << 20):
                grams, offsets = shingle_sets(part.column(1), n)
                size = np.diff(offsets)
                with np.errstate(over="ignore"):
                    both = []
                    for own in (grams, mix(grams ^ np.uint64(0xA0761D6478BD642F))):
                        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
                        both.append(mix(sums[offsets[1:]] - sums[offsets[:-1]] + mix(size.astype(np.uint64))))
                node = (both[0] & np.uint64((1 << NODE_BITS) - 1)).view(np.int64)
                sig = signatures(grams, offsets)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array(node, mask=size == 0), pa.array(both[1].view(np.int64), mask=size == 0), pa.array(size.astype(np.int64)),
                    pa.array(packed(sig, sketches(grams, offsets), size), pa.binary()),
                ], names=["doc_id", "tie", "node", "check", "n_shingles", "sig"])

    return rows.mapInArrow(run, f"doc_id {kind}, tie struct<a:long,b:long>, node long, check long, n_shingles long, sig binary")


def _classes(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slim, classes): rows with equal node and check have equal sets and are one class, which node then names alone.
    Classes that share a node (64-bit hashes of 10**10 sets may) get a new one from both hashes."""
    made = staged(slim.filter("node is not null").groupBy("node", "check").agg(F.min("doc_id").alias("least"), F.min("tie").alias("tie"), F.first("sig").alias("sig")), "classes")
    several = made.groupBy("node").count().filter("count > 1")
    ids = staged(made.select("node", "check").join(several, "node", "left_semi").withColumn("id", F.xxhash64("node", "check")), "shared-nodes")
    if ids.limit(1).count():
        named = lambda df: df.join(ids, ["node", "check"], "left").withColumn("node", F.coalesce("id", "node")).drop("id")
        slim, made = staged(named(slim), "shingled"), staged(named(made), "classes")
    return slim.drop("check"), made.drop("check")


def _indexed(classes: DataFrame) -> DataFrame:
    """(key, node): each class under all its keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = chunk_keys(unpacked(batch.column(1))[0])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), POSITIONS))], names=["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose signatures don't rule a link out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(near(unpacked(batch.column(2)), unpacked(batch.column(3)), percent)))

    sig = lambda name: classes.select(F.col("node").alias(name), F.col("sig").alias(f"sig_{name}"))
    return pairs.join(sig("b"), "b").join(sig("a"), "a").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _pairs_of_key(node, label, block, low, high, sig, percent: int, forest: bool) -> np.ndarray:
    """Pairs (two rows of an array) of one key's blocks low and high across components that signatures don't rule
    out; with forest, of the probable ones just those that join components, the closest first."""
    found = [np.zeros((3, 0), np.int32)]
    one, two = (np.flatnonzero(block == low), np.flatnonzero(block == high))
    for at in range(0, len(one), 64):
        rows = one[at:at + 64]
        far = label[rows][:, None] != label[two][None]
        if low == high:
            far &= rows[:, None] < two[None]
        i, j = np.nonzero(far)
        for cut in range(0, len(i), 1 << 14):
            a, b = rows[i[cut:cut + (1 << 14)]], two[j[cut:cut + (1 << 14)]]
            d = (sig[0][a] != sig[0][b]).sum(1)
            ok = np.flatnonzero(d <= (CLOSE if forest else REACH))
            ok = ok[near(tuple(x[a[ok]] for x in sig), tuple(x[b[ok]] for x in sig), percent)]
            found.append(np.stack([d[ok], a[ok], b[ok]]).astype(np.int32))
    d, a, b = np.concatenate(found, 1)
    if not forest:
        return np.stack([node[a], node[b]])
    order = np.argsort(d, kind="stable")
    a, b = a[order], b[order]
    left = len(np.unique(np.append(label[a], label[b]))) - 1  # pairs of a spanning tree
    head: dict[int, int] = {}

    def root(x: int) -> int:
        while head.setdefault(x, x) != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    out = []
    for k in range(len(a)):
        if len(out) == left:
            break
        x, y = root(int(label[a[k]])), root(int(label[b[k]]))
        if x != y:
            head[x] = y
            out.append(k)
    return np.stack([node[a[out]], node[b[out]]]) if out else np.zeros((2, 0), np.int64)


def _across(members: DataFrame, classes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of members (key, node, label, n) of a key across components. A key with more than BLOCK
    members is cut into blocks by hash, and each two blocks meet in a group of their own."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    rows = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "label").join(classes.select("node", "sig"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(table: pa.Table) -> pa.RecordBatch:
            key, low, high, block, node, label = (table.column(c).to_numpy() for c in ("key", "low", "high", "block", "node", "label"))
            sig = unpacked(table.column("sig").combine_chunks())
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            pairs = [np.zeros((2, 0), np.int64)]
            for a, b in zip(new, np.append(new[1:], len(key))):
                pairs.append(_pairs_of_key(node[a:b], label[a:b], block[a:b], low[a], high[a], tuple(x[a:b] for x in sig), percent, forest))
            pairs = np.concatenate(pairs, 1)
            small, large = np.minimum(*pairs), np.maximum(*pairs)
            order = np.lexsort((large, small))
            small, large = small[order], large[order]
            fresh = np.ones(len(small), bool)
            fresh[1:] = (small[1:] != small[:-1]) | (large[1:] != large[:-1])
            return pa.RecordBatch.from_arrays([pa.array(small[fresh]), pa.array(large[fresh])], names=["a", "b"])

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= 4 * BLOCK:
                last = [held.column(c)[-1].as_py() for c in ("key", "low", "high")]
                same = np.logical_and.reduce([held.column(c).to_numpy() == v for c, v in zip(("key", "low", "high"), last)])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield out(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield out(held)

    order = ["key", "low", "high"]
    return rows.select(*order, "block", "node", "label", "sig").repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets have percent of their union in common."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, "text_b"):
                first = part.column(2).dictionary_encode()  # a head's text is read once for all its pairs here
                at = first.indices.to_numpy()
                (ga, oa), (gb, ob) = shingle_sets(first.dictionary, n), shingle_sets(part.column(3), n)
                linked = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    x, y = ga[oa[at[i]]:oa[at[i] + 1]], gb[ob[i]:ob[i + 1]]
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    linked[i] = 100 * common >= percent * (len(x) + len(y) - common)
                yield part.select(["a", "b"]).filter(pa.array(linked))

    return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, n: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, tie (`row_key` of all columns), n_shingles, component_id, group for each row of docs (doc_id, text, any more).

    component_id is the smallest doc_id of the row's component and group a number that is the component's
    own. Null and empty texts and texts without words are components of their own rows. A null doc_id
    takes part but is never a component_id unless its component has no other.
    """
    slim, classes = _classes(staged(shingled(docs, n), "shingled"))
    index = staged(_indexed(classes), "index")
    heads = index.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1").select("key", "head")
    shared = staged(index.join(heads, "key"), "shared-keys")
    stars = shared.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    pairs = staged(_close(stars, classes, percent), "pairs")
    ends = staged(shared.select("node").distinct(), "ends")
    wanted = ends.join(classes, "node").select("node", "tie")
    sources = docs.select(row_key(*docs.columns).alias("tie"), F.col("text").cast("string").alias("text"))
    texts = staged(sources.join(wanted, "tie").dropDuplicates(["node"]).select("node", "text"), "texts")
    links = staged(_confirmed(pairs, texts, n, percent), "links")
    labels = connected_components(links)
    forest, rounds = True, 0
    while True:
        placed = shared.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        apart = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low < high").select("key", "n")
        members = staged(placed.join(apart, "key"), "apart")
        new = staged(_across(members, classes, percent, forest).join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = new.limit(1).count() > 0
        if found:
            pairs = pairs.union(new)
            links = links.union(staged(_confirmed(new, texts, n, percent), "links"))
            labels = connected_components(links)
        if not forest:
            break
        rounds += 1
        forest = found and rounds < FORESTS
    grouped = classes.select("node", "least").join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("group"))
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    of_class = staged(grouped.join(least, "group").select("node", "group", "component_id"), "components")
    rows = slim.drop("sig").join(of_class, "node", "left")
    return rows.select("doc_id", "tie", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "group")


def near_dedup(docs: DataFrame, n: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id stays (null only if there is no
    other), of rows equal in that the one with the smaller row key. Rows without words all stay. Rows that are equal
    in every column are one."""
    rows = near_components(docs, n, percent)
    alone = rows.filter("group is null").select("tie")
    best = rows.filter("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("r")).select(F.col("r.tie").alias("tie"))
    key = unique_name(docs, "_near_key")
    keep = staged(alone.union(best).distinct().withColumnRenamed("tie", key), "kept")
    return docs.withColumn(key, row_key(*docs.columns)).join(keep, key).dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
