"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length within each source. A source whose target is T and whose
documents hold S words gives every document floor(T / S) times; the rest of the budget, R < S, is a
subset-sum problem over its length histogram. Each length gives its proportional share of documents, and
the words still missing are filled by a bounded-knapsack dynamic program, which may take shares back.
Which documents of a length are taken is decided by a seeded hash.

Only histograms move: (source, length) counts are pre-aggregated before they are shuffled, and ranks
within a hot (source, length) are found over hash buckets of bounded size.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import staged
from .tables import WORD, row_key, unique_name

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = 20_011
#: Sums that the dynamic program holds (9 bytes each).
TABLE = 1 << 22
#: Rows of one (source, length) that are ranked together.
BUCKET_ROWS = 256


def word_count(column: str = "text"):
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def nearest_subset(lengths: np.ndarray, counts: np.ndarray, target: int, table: int = TABLE) -> np.ndarray:
    """How many of each length (all positive) to take, of at most `counts`, for a sum nearest to target; the
    lower of two equally near sums.

    A bounded-knapsack dynamic program over the sums in units of the lengths' greatest common divisor. Where
    they fit `table` all sums are held and the result is exact. Longer documents' sums are held as a sorted
    list, exact until it is longer than the table; then sums closer than top / table count as one.
    """
    take = np.zeros(len(lengths), np.int64)
    if not len(lengths) or target <= 0:
        return take
    unit = int(np.gcd.reduce(lengths))
    size = lengths // unit
    low, rest = divmod(int(target), unit)
    want, top = low + (2 * rest > unit), low + 1 + int(size.max())
    order = np.argsort(-size, kind="stable").tolist()
    chunks = ((i, k) for i in order for k in _powers_to(min(int(counts[i]), top // int(size[i]))))
    if top <= table:
        reached, by_length, by_count = np.zeros(top + 1, bool), np.full(top + 1, -1, np.int32), np.zeros(top + 1, np.int32)
        reached[0] = True
        for i, k in chunks:
            if reached[want]:
                break
            w = k * int(size[i])
            if w <= top:
                at = np.flatnonzero(reached[:top + 1 - w] & ~reached[w:]) + w
                by_length[at], by_count[at] = i, k
                reached[at] = True
        sums = np.flatnonzero(reached)
        best = int(sums[np.argmin(np.abs(sums * unit - target))])
        while best:
            i, k = int(by_length[best]), int(by_count[best])
            take[i] += k
            best -= k * int(size[i])
        return take
    sums, steps = np.zeros(1, np.int64), []
    for i, k in chunks:
        more = sums + k * int(size[i])
        more = np.setdiff1d(more[more <= top], sums, assume_unique=True)
        steps.append((i, k, more))
        sums = np.union1d(sums, more)
        if len(sums) > table:
            sums = sums[np.unique(sums // (top // table + 1), return_index=True)[1]]
        if len(more) and more[min(np.searchsorted(more, want), len(more) - 1)] == want:
            break
    best = min([np.zeros(1, np.int64), *(s[2] for s in steps), sums], key=lambda x: int(np.abs(x * unit - target).min()) if len(x) else target)
    best = int(best[np.argmin(np.abs(best * unit - target))])
    for i, k, more in reversed(steps):
        if len(more) and more[min(np.searchsorted(more, best), len(more) - 1)] == best:
            take[i] += k
            best -= k * int(size[i])
    return take


def _powers_to(n: int) -> list[int]:
    """1, 2, 4, ... and a rest, which sum to n: their subsets sum to everything up to n."""
    out, k = [], 1
    while n > 0:
        out.append(min(k, n))
        n, k = n - k, k * 2
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum as near to budget as can be.

    Every length gives its proportional share, with what rounding leaves over carried on to the next length.
    What is missing then is filled by `nearest_subset`. Where its sum isn't the nearest that the lengths'
    divisor allows, some of the shares are taken back, in more and more words, and filled anew: all of them
    where the budget, or what is left out, or the number of possible sums fits the table, so that the result is
    exact there.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    counts = np.where(lengths > 0, counts, 0)
    total = int((lengths * counts).sum())
    budget = int(max(0, min(budget, total)))
    if 2 * budget > total:  # choose what is left out
        return counts - fit(lengths, counts, total - budget, table)
    if not budget:
        return np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(counts)
    used = used[np.argsort(lengths[used], kind="stable")]
    size, most = lengths[used], counts[used]
    share, words, given = np.zeros(len(used), np.int64), 0, 0
    for i, (w, n) in enumerate(zip(size.tolist(), most.tolist())):
        words += w * n
        share[i] = max(0, min(n, (budget * words // total - given) // w))
        given += w * int(share[i])
    unit, longest = int(np.gcd.reduce(size)), int(size.max())
    room = max(0, unit * table - 2 * longest)
    few = float(np.log2(most + 1.0).sum()) <= np.log2(table)  # so few documents that all their sums can be listed
    best, off = share, abs(given - budget)
    for words in (0, room // 256, room // 16, total if few else room):
        base = share - _taken_back(size, share, words)
        rest = budget - int((base * size).sum())
        some = base + nearest_subset(size, most - base, rest, table)
        if (far := abs(int((some * size).sum()) - budget)) < off:
            best, off = some, far
        if 2 * off <= unit or not base.any():
            break
    take = np.zeros(len(lengths), np.int64)
    take[used] = best
    return take


def _taken_back(size: np.ndarray, share: np.ndarray, words: int) -> np.ndarray:
    """Of each length some of `share`, `words` words in all at most: all if they fit, else few of many lengths."""
    if int((size * share).sum()) <= words:
        return share
    out, each = np.zeros(len(size), np.int64), 1
    while words > 0:
        more = np.minimum(share - out, each)
        more[np.cumsum(more * size) > words] = 0
        if not more.any():
            break
        out += more
        words -= int((more * size).sum())
        each *= 2
    return out


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add `target` (double) to one row per source: (source, source_size).

    Sources in code point order, null last, get the weights in turn. Targets share `share` of all
    words by weight; one above `most` times its source's size stops there and its excess is shared
    anew by weight, until none is above. The rank of a source comes from range partitions and their
    counts; the sharing needs two sums a round, so nothing that grows with the sources is collected.
    """
    ranked = staged(
        sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()),
        "sources",
    )
    counts = {r["_part"]: r["n"] for r in ranked.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one a partition
    before, offsets = 0, {}
    for part in sorted(counts):
        offsets[part] = before
        before += counts[part]
    if not counts:
        return sizes.withColumn("target", F.lit(0.0))
    start = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("_part"))
    rank = start + F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    level, pool = 0.0, None
    while True:
        stopped = F.col("_w") * F.lit(level) >= F.col("_cap")
        row = weighed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(stopped, F.col("_cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("_w"))).alias("open"), F.sum(stopped.cast("int")).alias("n"),
        ).first()
        if pool == row["n"] or not row["open"]:
            break
        pool = row["n"]
        level = (row["all"] * share - row["held"]) / row["open"]
    return weighed.select("source", "source_size", F.least("_cap", F.col("_w") * F.lit(level)).alias("target"))


def mix_plan(slim: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed: int = SEED) -> DataFrame:
    """slim (doc_id, source, size, tie, ...) with source_size, target and taken_times.

    taken_times is how many times the document enters the mix. Rows of a length are chosen by hash of seed,
    doc_id and tie, so reruns agree; rows equal in all of these are interchangeable.
    """
    hist = staged(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    targets = source_targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        full = int(target // total) if total else 0
        if target >= most * total:
            full = int(most)
        take = fit(rows["size"].to_numpy(), rows["n"].to_numpy(), 0 if full >= most else round(target - full * total))
        return rows.assign(full=full, extra=take)

    of_source = F.col("h.source").eqNullSafe(F.col("t.source"))
    joined = hist.alias("h").join(targets.alias("t"), of_source).select("h.source", "size", "n", "source_size", "target")
    lengths = staged(joined.groupBy("source").applyInPandas(plan, T.StructType([*joined.schema.fields, T.StructField("full", T.IntegerType()), T.StructField("extra", T.LongType())])), "plan")
    same = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))
    rows = slim.alias("d").join(lengths.alias("p"), same).select(*[F.col(f"d.`{c}`") for c in slim.columns], "source_size", "target", "full", "extra", "n")
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "tie"))
    chosen = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    parts = F.ceil(F.col("n") / F.lit(BUCKET_ROWS))
    rows = rows.withColumn("_b", F.pmod(F.col("_h"), parts))
    split = rows.filter(chosen)
    key = ["source", "size", "_b"]
    per = split.groupBy(*key).agg(F.count("*").alias("_m"))
    ahead = per.withColumn("_before", F.coalesce(F.sum("_m").over(Window.partitionBy("source", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.size") == F.col("b.size")) & (F.col("r._b") == F.col("b._b"))
    ranked = split.alias("r").join(ahead.alias("b"), on).select("r.*", "_before").withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*key).orderBy("_h", "doc_id", "tie")))
    decided = ranked.withColumn("taken_times", F.col("full").cast("long") + (F.col("_rank") <= F.col("extra")).cast("long")).drop("_before", "_rank")
    plain = rows.filter(~chosen).withColumn("taken_times", F.col("full").cast("long") + (F.col("extra") > 0).cast("long"))
    return plain.unionByName(decided).drop("full", "extra", "n", "_h", "_b")


def slim_rows(docs: DataFrame) -> DataFrame:
    """What the mix decides on: doc_id, source, size and a hash of the row as tie-break."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), row_key(*docs.columns).alias("tie"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source, any more columns) repeated or left out as the mix decides.

    Same columns as docs. Null texts have no words and are neither needed nor taken beyond floor(T / S)
    times; a null source is a source of its own, last in order. An empty table gives an empty one.
    Rows equal in every column are drawn separately and are interchangeable.
    """
    key, times = unique_name(docs, "_mix_key"), unique_name(docs, "_mix_times")
    slim = staged(slim_rows(docs), "mix-rows")
    plan = mix_plan(slim, weights, share, most, seed).groupBy(F.col("tie").alias(key)).agg(F.sum("taken_times").alias(times)).filter(F.col(times) > 0)
    rows = docs.withColumn(key, row_key(*docs.columns))
    distinct = rows.dropDuplicates([key])
    kept = distinct.join(plan, key)
    return kept.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
