"""Toxicity: a factorization machine over hashed terms.

A document is the set of its lower-cased words and of their beginnings, hashed into buckets. Buckets that tell the labels apart in a bounded sample get a
weight and a vector of factors; the score is the logistic function of the bias, the weights and all pairwise products of factors,
so that two terms together can weigh more, or less, than their sum.

Defined cases: a null or empty text has no terms and scores the logistic of the bias. Without training rows of both labels the
score is the share of label 1 among them (0 if there are none). Repeated rows get equal scores; in training, rows of one doc_id
count once, by the least of their sets. Only the text is an input of a score; columns other than doc_id and text are ignored.

The sample is bounded by rows, not by the length of their texts, so sets of buckets stay with the executors: the driver gets counts of
buckets, and of each sampled row a bit for each chosen term.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common

BUCKETS, TERMS, FACTORS, THRESHOLD = 1 << 20, 1024, 8, 0.3
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 12_000
#: Sampled documents that hold a term, at least.
LEAST_DOCS = 5
#: ASCII letters to lower case, digits and all other than ASCII kept, the rest to spaces.
PREFIXES = (4, 5, 6)  # bytes
TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def buckets(text: bytes) -> np.ndarray:
    """Sorted distinct buckets of a text's terms: its words, and their beginnings, which stay alike where endings vary."""
    words, _, _, *beginnings = common.word_hashes(text.translate(TERM), PREFIXES)
    return common.distinct((np.concatenate([words, *beginnings]) & np.uint64(BUCKETS - 1)).astype(np.int32))


@dataclass(frozen=True)
class FactorizationMachine:
    terms: np.ndarray  # sorted buckets that count
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # a row of FACTORS for each of terms

    def logit(self, found: np.ndarray) -> float:
        if not len(self.terms) or not len(found):
            return self.bias
        at = np.searchsorted(self.terms, found)
        at = at[self.terms[np.minimum(at, len(self.terms) - 1)] == found]
        v = self.factors[at]
        return float(self.bias + self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(buckets(text)), -30, 30))))


def chosen_terms(one: np.ndarray, zero: np.ndarray, n1: int, n0: int, most: int) -> np.ndarray:
    """Buckets whose presence tells the labels apart best, by a signed log-odds z statistic; at least 5 documents hold each.

    one, zero: documents of label 1 and of label 0 that hold each bucket; n1, n0: all of them.
    """
    odds = np.log((one + 0.5) / (n1 - one + 0.5)) - np.log((zero + 0.5) / (n0 - zero + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (one + 0.5) + 1 / (n1 - one + 0.5) + 1 / (zero + 0.5) + 1 / (n0 - zero + 0.5))
    z[(one + zero < LEAST_DOCS) | (z < 3)] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] > 0]).astype(np.int32)


def bucket_counts(rows: Iterable[np.ndarray]) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r] += 1  # a row's buckets are distinct
    return out


def holds(rows: Iterable[np.ndarray], terms: np.ndarray) -> Iterator[np.ndarray]:
    """For each row, which of the terms it holds."""
    for r in rows:
        yield np.isin(terms, r, assume_unique=True)


def fitted(rows: list[np.ndarray], y: np.ndarray, epochs: int = 40) -> FactorizationMachine:
    one, zero = (bucket_counts(r for r, k in zip(rows, y, strict=True) if k == label) for label in (1, 0))
    terms = chosen_terms(one, zero, int(y.sum()), int(len(y) - y.sum()), TERMS)
    return descended(terms, np.array(list(holds(rows, terms)), np.uint8).reshape(len(rows), len(terms)), y, epochs)


def descended(terms: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 0.15, l2: float = 1e-5, seed: int = 7) -> FactorizationMachine:
    """Logistic loss, minibatches, per-weight steps; the same rows give the same model. x: for each row, 1 for the terms it holds."""
    none = FactorizationMachine(np.zeros(0, np.int32), float(np.log((y.sum() + 1e-9) / (len(y) - y.sum() + 1e-9))) if len(y) else -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < y.sum() < len(y) or not len(terms):
        return none
    rng = np.random.default_rng(seed)
    bias, w, v = none.bias, np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), FACTORS))
    sb, sw, sv = 1e-8, np.full(w.shape, 1e-8), np.full(v.shape, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 256):
            part = order[i : i + 256]
            b = x[part].astype(np.float64)
            s = b @ v
            logit = bias + b @ w + 0.5 * ((s**2).sum(1) - b @ (v**2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) / len(part)
            gw = b.T @ g + l2 * w
            gv = b.T @ (g[:, None] * s) - (b.T @ g)[:, None] * v + 10 * l2 * v
            sb, sw, sv = sb + g.sum() ** 2, sw + gw**2, sv + gv**2
            bias -= rate * g.sum() / np.sqrt(sb)
            w -= rate * gw / np.sqrt(sw)
            v -= rate * gv / np.sqrt(sv)
    return FactorizationMachine(terms, float(bias), w, v)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, where: str = "true") -> FactorizationMachine:
    def hashed(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, y, text in rows:
            yield doc_id, y, buckets(text).tobytes()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for y, x in zip(b.column("y").to_pylist(), b.column("x"), strict=True):
                counts[int(y > 0), np.frombuffer(x.as_py(), np.int32)] += 1
        held = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[1, held]), pa.array(counts[0, held])], ["bucket", "one", "zero"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(h).tobytes() for h in holds((np.frombuffer(x.as_py(), np.int32) for x in b.column("x")), terms)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(bits, pa.binary())], ["doc_id", "y", "bits"])

    sample = common.labelled_sample(docs, labels, "toxic", bound, where)
    sets = common.map_docs(sample, hashed, "doc_id long, y int, x binary", "doc_id", "y", batch=100)
    held = common.cut(sets.groupBy("doc_id", "y").agg(F.min("x").alias("x")), "term-sets")
    n = held.agg(F.coalesce(F.sum((F.col("y") > 0).cast("long")), F.lit(0)).alias("n1"), F.count("*").alias("n")).first()
    counts = held.mapInArrow(counted, "bucket int, one long, zero long").groupBy("bucket").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    got = counts.where(f"one + zero >= {LEAST_DOCS}").toArrow()  # at most BUCKETS rows
    one, zero = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    at = got.column("bucket").to_numpy()
    one[at], zero[at] = got.column("one").to_numpy(), got.column("zero").to_numpy()
    terms = chosen_terms(one, zero, n.n1, n.n - n.n1, TERMS)
    rows = sorted(held.mapInArrow(marked, "doc_id long, y int, bits binary").collect())  # at most bound rows of TERMS bits
    x = np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8), count=len(terms)) for r in rows], np.uint8).reshape(len(rows), len(terms))
    return descended(terms, x, np.array([int(r.y > 0) for r in rows], np.int64))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def toxicity(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """One scored row per document. No shuffle."""

    def scored(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            s = model.score(text)
            yield doc_id, held_out(doc_id), s, int(s >= threshold)

    return common.map_docs(common.as_docs(docs), scored, SCHEMA, "doc_id")


def trained(spark, sf_dir: str) -> FactorizationMachine:
    return fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), where=f"{common.crc_mod4()} != 2")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), trained(spark, sf_dir))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of docs that score below the threshold."""
    model = trained(spark, sf_dir)
    return common.filtered(docs, lambda text: model.score(text) < THRESHOLD)
