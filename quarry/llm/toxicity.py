"""Toxicity: a factorization machine over hashed terms.

Terms are whole words and their first 4, 5 and 6 bytes (inflected forms share a stem), hashed. On the
labelled sample Spark counts each term by class; the terms whose shares differ most are the machine's inputs,
and of the most frequent others those that do so in pairs, however little they tell alone. The machine adds to
linear weights an inner product of factors for each pair of terms that a text holds.
Known limit: of terms without a gap of their own only the FREQUENT most frequent are looked at in pairs.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import staged
from .wordhash import ALNUM, LOWER, row_blocks, span_hashes, text_bytes, word_spans

#: Most labelled rows that a fit looks at.
SAMPLE = 12_000
#: Hashed terms are numbers below this.
SPACE = 1 << 22
#: Terms that the machine weighs by their own gap, frequent ones that are looked at in pairs, and factors of each.
TERMS, FREQUENT, FACTORS = 1024, 512, 6
#: Least gap, in standard errors, of a pair that brings its terms in: far above what the largest of FREQUENT**2 / 2
#: pairs without any meaning reaches.
PAIR_GAP = 7.0
PREFIXES = (4, 5, 6)


def hashed_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every term of every text, repeats included; whole texts, A-Z lower-cased."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, ALNUM)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, terms = [row], [span_hashes(data, starts, ends)]
    for n in PREFIXES:
        long = ends - starts > n
        rows.append(row[long])
        terms.append(span_hashes(data, starts[long], starts[long] + n) + np.uint64(n))
    return np.concatenate(rows), (np.concatenate(terms) % np.uint64(SPACE)).astype(np.int64)


def _counts(sample: DataFrame) -> DataFrame:
    """(term, label, n): in how many sample texts of each class a term is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, "text"):
                row, term = hashed_terms(part.column(0))
                pair = np.unique(row * SPACE + term)
                label = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[pair // SPACE]
                keys, n = np.unique(label * SPACE + pair % SPACE, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys % SPACE), pa.array(keys // SPACE), pa.array(n.astype(np.int64))], names=["term", "label", "n"])

    return sample.select("text", "_label").mapInArrow(run, "term long, label long, n long").groupBy("term", "label").agg(F.sum("n").alias("n"))


def _gap(a, b, ones: int, zeros: int, root):
    """Difference of a term's shares in the classes, in standard errors; of columns or arrays, with their square root."""
    p, q = (a + 0.5) / (ones + 1), (b + 0.5) / (zeros + 1)
    gap, error = p - q, p * (1 - p) / ones + q * (1 - q) / zeros
    return root(gap * gap / error)


def choose_terms(sample: DataFrame, most: int = TERMS, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The terms whose presence tells the classes apart best, by signed root of the likelihood ratio, and the most
    frequent of the others. None where the sample lacks a class."""
    totals = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    if not ones or not zeros:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = staged(_counts(sample).groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b")), "toxic-terms")
    n = F.col("a") + F.col("b")
    by_gap = wide.filter(n >= 3).orderBy(_gap(F.col("a"), F.col("b"), ones, zeros, F.sqrt).desc(), "term").limit(most).select("term")
    by_number = wide.orderBy(n.desc(), "term").limit(most + frequent).select("term")
    first = [r["term"] for r in by_gap.collect()]
    more = [t for t in (r["term"] for r in by_number.collect()) if t not in set(first)][:frequent]
    return np.sort(np.array(first, np.int64)), np.sort(np.array(more, np.int64))


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Flags of the columns of x that take part in a pair whose joint presence, alone or with one of them only,
    tells the classes apart by PAIR_GAP and more than both columns do by themselves."""
    ones, zeros = int(y.sum()), int(len(y) - y.sum())
    both = [x[y == c].astype(np.float32) for c in (1, 0)]
    joint = [m.T @ m for m in both]
    own = _gap(np.diag(joint[0]), np.diag(joint[1]), ones, zeros, np.sqrt)
    differ = [np.diag(m)[:, None] + np.diag(m)[None] - 2 * m for m in joint]
    z = np.maximum(_gap(*joint, ones, zeros, np.sqrt), _gap(*differ, ones, zeros, np.sqrt))
    return ((z >= PAIR_GAP) & (z > 1.5 * np.maximum(own[:, None], own[None])) & ~np.eye(len(z), dtype=bool)).any(1)


def _presence(column: pa.Array, chosen: np.ndarray) -> np.ndarray:
    """0/1 matrix: which chosen terms each text holds."""
    out = np.zeros((len(column), len(chosen)), np.uint8)
    if len(chosen):
        row, term = hashed_terms(column)
        slot = np.full(SPACE, -1, np.int32)
        slot[chosen] = np.arange(len(chosen))
        at = slot[term]
        out[row[at >= 0], at[at >= 0]] = 1
    return out


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the terms that a text holds."""
    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, terms: np.ndarray, factors: int = FACTORS, rounds: int = 150, ridge: float = 1e-4, seed: int = 3) -> FactorizationMachine:
        """Full-batch Adam on logistic loss, classes weighed evenly up to a factor of 4."""
        share = (y.sum() + 0.5) / (len(y) + 2)
        bias = float(np.log(share / (1 - share)))
        rng = np.random.default_rng(seed)
        p = [np.array([bias], np.float32), np.zeros(len(terms), np.float32), rng.normal(0, 0.01, (len(terms), factors)).astype(np.float32)]
        if not len(terms) or not len(y) or y.min() == y.max():
            return cls(terms, bias, p[1], p[2])
        x, y = x.astype(np.float32), y.astype(np.float32)
        weight = np.where(y > 0, min(4.0, max(1.0, (1 - share) / share)), 1.0).astype(np.float32)
        m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        for t in range(1, rounds + 1):
            xv = x @ p[2]
            z = p[0][0] + x @ p[1] + 0.5 * ((xv**2).sum(1) - x @ (p[2] ** 2).sum(1))
            g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
            mass = x.T @ g
            grads = [np.array([g.sum()], np.float32), mass + ridge * p[1], x.T @ (g[:, None] * xv) - mass[:, None] * p[2] + ridge * p[2]]
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.99 * s[k] + 0.01 * d * d
                p[k] = p[k] - (0.05 if k < 2 else 0.01) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
        return cls(terms, float(p[0][0]), p[1], p[2])

    def score(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        xv = x @ self.v
        z = self.bias + x @ self.w + 0.5 * ((xv**2).sum(1) - x @ (self.v**2).sum(1))
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def fit_toxicity(sample: DataFrame) -> FactorizationMachine:
    """Fit on (text, _label) rows, SAMPLE of them at most. What reaches the driver is a bit for each row and chosen
    term. Without rows, or rows of one class only, every text scores the share of toxic rows, a quarter if there are no rows."""
    own, frequent = choose_terms(sample)
    terms = np.concatenate([own, frequent])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, "text"):
                bits = np.packbits(_presence(part.column(0), terms), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], names=["_label", "bits"])

    rows = sample.select("text", "_label").mapInArrow(run, "_label int, bits binary").toPandas().sort_values(["_label", "bits"])
    if not len(rows) or not len(terms):
        return FactorizationMachine.fit(np.zeros((len(rows), 0), np.uint8), rows["_label"].to_numpy(np.int64), np.zeros(0, np.int64))
    bits = np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), -1)
    x, y = np.unpackbits(bits, axis=1, count=len(terms)), rows["_label"].to_numpy()
    chosen = np.append(np.ones(len(own), bool), paired(x[:, len(own):], y))
    chosen = np.flatnonzero(chosen)[np.argsort(terms[chosen])]
    return FactorizationMachine.fit(x[:, chosen], y, terms[chosen])


def score_toxicity(docs: DataFrame, model: FactorizationMachine, text: str = "text", output: str = "score") -> DataFrame:
    """docs with `output`, the machine's score of the whole text (null as empty); a column of that name is replaced."""
    docs = docs.drop(output)
    schema = T.StructType([*docs.schema.fields, T.StructField(output, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, text):
                score = model.score(_presence(part.column(part.schema.get_field_index(text)), model.terms))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, output])

    return docs.mapInArrow(run, schema)
