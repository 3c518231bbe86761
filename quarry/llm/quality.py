"""Quality classifier: a sparse rule ensemble.

Shallow trees are boosted on statistics of labelled texts; every path from a root becomes a conjunctive
rule; a lasso-penalised logistic regression keeps few of the rules; and these are compiled into one
Spark column expression over the statistics. Only the fit runs on the driver, on a bounded sample.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import unique_name
from .wordhash import SPACED, mix, row_blocks, span_hashes, text_bytes, word_spans

#: Most labelled rows that a fit looks at.
SAMPLE = 20_000
STATS = (
    "n_words", "word_len", "symbols", "upper", "digits", "pipes", "bangs", "distinct", "adjacent", "top_word",
    "n_lines", "dup_lines", "line_words", "symbol_ends", "non_ascii", "stops",
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATS for each text; whole texts, null as empty, all zero for a text without words."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    out = np.zeros((rows, len(STATS)))
    if not len(data):
        return out
    starts, ends, first = word_spans(data, offsets, SPACED)
    words = np.diff(first).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    n = np.maximum(words, 1)
    row = np.repeat(np.arange(rows), np.diff(first))
    hashes = span_hashes(data, starts, ends)
    out[:, 0] = words
    out[:, 1] = np.bincount(row, ends - starts, rows) / n
    for k, flags in ((2, _SYMBOL[data]), (3, (data >= 65) & (data <= 90)), (4, (data >= 48) & (data <= 57)), (5, data == 124), (6, data == 33), (14, data >= 128)):
        out[:, k] = _per_row(flags, offsets) / size
    keys = hashes ^ mix(row.astype(np.uint64) + np.uint64(1))
    _, at, times = np.unique(keys, return_index=True, return_counts=True)
    out[:, 7] = np.bincount(row[at], minlength=rows) / n
    if len(hashes) > 1:
        same = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        out[:, 8] = np.bincount(row[1:][same], minlength=rows) / n
    most = np.zeros(rows)
    np.maximum.at(most, row[at], times)
    out[:, 9] = most / n
    s, e, line_first = word_spans(data, offsets, _NOT_NEWLINE)
    lines = np.diff(line_first).astype(float)
    line_row = np.repeat(np.arange(rows), np.diff(line_first))
    _, at = np.unique(span_hashes(data, s, e) ^ mix(line_row.astype(np.uint64) + np.uint64(1)), return_index=True)
    out[:, 10] = lines
    out[:, 11] = 1 - np.bincount(line_row[at], minlength=rows) / np.maximum(lines, 1)
    out[:, 12] = words / np.maximum(lines, 1)
    last = data[ends - 1] if len(ends) else data[:0]
    out[:, 13] = np.bincount(row[_SYMBOL[last] & (last != 46) & (last != 44)], minlength=rows) / n
    out[:, 15] = np.bincount(row[last == 46], minlength=rows) / n
    out[words == 0] = 0
    return out


def with_statistics(docs: DataFrame, column: str, name: str) -> DataFrame:
    """docs and one array<double> column with the STATS of a text column."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, column):
                values = statistics(part.column(part.schema.get_field_index(column)))
                offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(STATS))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Holds where every (statistic, above, bound) does: the statistic is > bound, or else <= it."""
    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, bound in self.parts:
            out &= (x[:, k] > bound) == above
        return out

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for k, above, bound in self.parts:
            value = F.col(stats)[k]
            out = out & ((value > F.lit(bound)) if above else (value <= F.lit(bound)))
        return out


def _grow(bins, cuts, grad, hess, rows, depth, parts, rules, leaf, rng):
    """Grow one tree on binned statistics; collects a rule for every node and the leaves' steps."""
    best = (1e-6, None, None)
    g, h = grad[rows].sum(), hess[rows].sum()
    if depth and len(rows) >= 20:
        for k in rng.choice(bins.shape[1], max(4, bins.shape[1] * 2 // 3), replace=False):
            b = bins[rows, k]
            gs = np.cumsum(np.bincount(b, grad[rows], len(cuts[k]) + 1))[:-1]
            hs = np.cumsum(np.bincount(b, hess[rows], len(cuts[k]) + 1))[:-1]
            ns = np.cumsum(np.bincount(b, minlength=len(cuts[k]) + 1))[:-1]
            ok = (ns >= 8) & (ns <= len(rows) - 8)
            gain = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), -1)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), k, int(gain.argmax()))
    if best[1] is None:
        leaf[rows] = -g / (h + 1)
        return
    _, k, cut = best
    bound = float(cuts[k][cut])
    for above in (False, True):
        sub = rows[(bins[rows, k] > cut) == above]
        path = (*parts, (int(k), above, bound))
        rules.append(path)
        _grow(bins, cuts, grad, hess, sub, depth - 1, path, rules, leaf, rng)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class RuleEnsemble:
    """intercept + sum of weights of the rules that hold, through a logistic link."""
    intercept: float
    rules: list[Rule]
    weights: list[float]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 5) -> RuleEnsemble:
        """Boost `trees` trees on half-samples, take their paths as rules, fit lasso logistic weights by
        accelerated proximal gradient. With one class or no rows, a constant near its share."""
        y = y.astype(float)
        base = (y.sum() + 0.5) / (len(y) + 1)
        start = float(np.log(base / (1 - base)))
        if not len(y) or y.min() == y.max():
            return cls(start, [], [])
        rng = np.random.default_rng(seed)
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 64), method="lower")) for k in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
        score, paths = np.full(len(y), start), []
        for _ in range(trees):
            p = _sigmoid(score)
            rows = np.sort(rng.choice(len(y), max(1, min(len(y), max(200, len(y) // 2))), replace=False))
            found: list = []
            leaf = np.zeros(len(y))
            _grow(bins, cuts, p - y, p * (1 - p), rows, depth, (), found, leaf, rng)
            step = np.zeros(len(y))
            # Rows outside the half-sample step as the leaf of their path does.
            done = np.zeros(len(y), bool)
            done[rows] = True
            step[rows] = leaf[rows]
            for path in found:
                if len(path) == depth or not any(q[:len(path)] == path and len(q) > len(path) for q in found):
                    inside = Rule(path).holds(x)
                    if (inside & done).any():
                        step[inside & ~done] = leaf[np.flatnonzero(inside & done)[0]]
            score += 0.2 * step
            paths += found
        rules = [Rule(p) for p in dict.fromkeys(paths)]
        if not rules:
            return cls(start, [], [])
        columns, unique = {}, []
        for r in rules:
            values = r.holds(x)
            if 0 < values.sum() < len(y) and (mark := np.packbits(values).tobytes()) not in columns:
                columns[mark] = values
                unique.append(r)
        a = np.stack(list(columns.values()), 1).astype(np.float32)
        w, b = np.zeros(a.shape[1]), start
        z, zb, t = w.copy(), b, 1.0
        rate = 4 / (float(np.linalg.norm(a, 2)) ** 2 / len(y) + 1)
        for _ in range(400):
            gap = _sigmoid(a @ z.astype(np.float32) + zb) - y
            new = z - rate * (a.T @ gap.astype(np.float32)) / len(y)
            new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
            nb = zb - rate * gap.mean()
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z, zb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
            w, b, t = new, nb, t2
        keep = np.flatnonzero(np.abs(w) > 1e-4)
        return cls(float(b), [unique[i] for i in keep], [float(w[i]) for i in keep])

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights):
            z += w * r.holds(x)
        return _sigmoid(z)

    def column(self, stats: str) -> Column:
        """The ensemble as a column expression over an array column of statistics."""
        z = F.lit(self.intercept)
        for r, w in zip(self.rules, self.weights):
            z = z + F.when(r.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_quality(sample: DataFrame) -> RuleEnsemble:
    """Fit on (text, _label) rows, SAMPLE of them at most."""
    rows = with_statistics(sample, "text", "_stats").select("_label", "_stats").toPandas()
    rows = rows.sort_values("_label", kind="stable") if len(rows) else rows
    x = np.array(rows["_stats"].tolist(), float).reshape(len(rows), len(STATS))
    order = np.lexsort([*x.T, rows["_label"].to_numpy()]) if len(rows) else []
    return RuleEnsemble.fit(x[order], rows["_label"].to_numpy()[order])


def score_quality(docs: DataFrame, model: RuleEnsemble, text: str = "text", output: str = "score") -> DataFrame:
    """docs with `output`, the ensemble's score of the whole text (null as empty); a column of that name is replaced."""
    stats = unique_name(docs, "_quality_stats")
    return with_statistics(docs, text, stats).withColumn(output, model.column(stats)).drop(stats)
