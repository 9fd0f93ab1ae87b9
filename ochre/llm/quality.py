"""Ordinal quality classifier: a cumulative-link (proportional odds) model on hashed text.

A document's score is the sum of one shared weight vector over its hashed features
(distinct words and punctuation runs, and levels of repetition and punctuation);
ordered thresholds turn it into the probability of each grade or better:
``P(grade > j) = sigmoid(score - threshold_j)``.  From these come the expected grade
and tail probabilities.

The fit uses at most ``max_rows`` labelled documents, those with the smallest hashes
of their ids, and of these as many as have at most ``max_bytes`` of features (4 bytes
each), every one whole; they come to the driver, so the two parameters bound its memory.
Scoring is one pass without a shuffle; the weights (4 bytes a hash bucket) are sent
to each executor once.

Defined results: null or empty text has no word features and gets the score of its
empty levels; several grades of a document count as the lowest; of rows that share a
``doc_id`` one is trained on; rows without a grade are not trained on; equal texts get
equal scores wherever they stand; a long text is scored whole; with fewer than two grades
present every document gets the one grade there is (the best grade if there is none);
tables may be empty; other columns pass through, and input columns named like an output
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import blocks, map_arrow, temporary, text_bytes, written
from .hashing import LOWER, mixed, piece_hashes, runs

#: log2 of the hash buckets.
BITS = 18
OUTPUTS = ("score", "expected_grade", "tail", "keep")


def features(data: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text: indices one text after the other, and where each starts (one more than texts)."""
    texts = len(bounds) - 1
    lowered = LOWER[data]
    starts, lengths, text = runs(lowered, bounds)
    hashes = piece_hashes(lowered, starts, lengths)
    n = np.bincount(text, minlength=texts)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    punctuation = np.bincount(text[(lowered[starts] < 128) & ~_ALNUM[lowered[starts]]], minlength=texts) if len(text) else np.zeros(texts)
    key = (text.astype(np.int64) << bits) | (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)
    key = np.unique(key)
    distinct = np.bincount(key >> bits, minlength=texts)
    share = lambda part: np.where(n > 0, np.floor(10 * part / np.maximum(n, 1)), 11).astype(np.int64)
    levels = np.stack([share(np.bincount(text, again, texts)), share(punctuation), share(np.minimum(distinct, n)), np.minimum(n, 64) // 8])
    own = mixed((levels + np.arange(1, len(levels) + 1)[:, None] * 1000).astype(np.uint64)) & np.uint64((1 << bits) - 1)
    key = np.unique(np.concatenate([key, ((np.arange(texts) << bits) | own.astype(np.int64)).ravel()]))
    return (key & (1 << bits) - 1).astype(np.int32), np.searchsorted(key, np.arange(texts + 1) << bits)


_ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def scores(self, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each document's sum by itself, in the order of its features."""
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        return np.bincount(doc, self.weights[index].astype(np.float64), len(starts) - 1)

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j, a row a document."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def fit_ordinal(index: np.ndarray, starts: np.ndarray, grades: np.ndarray, n_grades: int, bits: int = BITS, steps: int = 1000, batch: int = 256, rate: float = 0.1, sparse: float = 0.04, seed: int = 7) -> OrdinalModel:
    """Maximum likelihood by AdaGrad in about ``steps`` shuffled batches, with weights shrunk towards 0 by ``sparse`` over the root of the rows; thresholds stay in order."""
    weights, squares = np.zeros(1 << bits), np.full(1 << bits, 1e-8)
    present = np.unique(grades)
    if len(present) < 2:
        only = int(present[0]) if len(present) else n_grades - 1
        return OrdinalModel(weights.astype(np.float32), np.where(np.arange(n_grades - 1) < only, -50.0, 50.0), bits)
    share = np.array([(grades > j).mean() for j in range(n_grades - 1)]).clip(1e-6, 1 - 1e-6)
    thresholds = np.log((1 - share) / share)
    t_squares = np.full(n_grades - 1, 1e-8)
    sparse /= np.sqrt(len(grades))
    lengths, rng = np.diff(starts), np.random.default_rng(seed)
    for _ in range(-(-steps // max(1, -(-len(grades) // batch)))):
        order = rng.permutation(len(grades))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            n = lengths[own]
            at = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            idx, doc = index[at], np.repeat(np.arange(len(own)), n)
            score = np.bincount(doc, weights[idx], len(own))
            y = grades[own]
            padded = np.concatenate([[-np.inf], thresholds, [np.inf]])
            high, low = _sigmoid(padded[y + 1] - score), _sigmoid(padded[y] - score)  # P(grade <= y), P(grade < y)
            p = np.maximum(high - low, 1e-12)
            d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
            slope = (d_high - d_low) / len(own)  # of the loss by the score
            grad = np.bincount(idx, slope[doc], 1 << bits)
            touched = np.flatnonzero(grad)
            squares[touched] += grad[touched] ** 2
            pace = rate / np.sqrt(squares[touched])
            moved = weights[touched] - pace * grad[touched]
            weights[touched] = np.sign(moved) * np.maximum(np.abs(moved) - pace * sparse, 0)
            t_grad = np.array([(np.where(y == j + 1, d_low, 0) - np.where(y == j, d_high, 0)).sum() for j in range(n_grades - 1)]) / len(own)
            t_squares += t_grad**2
            thresholds = np.maximum.accumulate(thresholds - rate * t_grad / np.sqrt(t_squares))
    return OrdinalModel(weights.astype(np.float32), thresholds, bits)


def fit(documents: DataFrame, grades: DataFrame, n_grades: int, max_rows: int = 20_000, bits: int = BITS, min_rows: int = 3, max_bytes: int = 192 << 20) -> OrdinalModel:
    """Fits on ``documents`` with ``grades`` (doc_id, grade from 0), on features that at least ``min_rows`` of those have.

    They are taken in the order of a hash of their ids, each with all its features: at most
    ``max_rows``, and as many as fit in ``max_bytes`` of features.
    """
    graded = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    sample = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # bounded, so it may be broadcast
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "grade")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            index, starts = features(*text_bytes(batch, "text"), bits)
            own = [index[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(own, pa.binary())], names=["doc_id", "grade", "index"])

    one = map_arrow(rows, extract, "doc_id long, grade int, index binary").groupBy("doc_id").agg(F.min(F.struct("index", "grade")).alias("_r"))  # a row a document of the sample
    with temporary(documents.sparkSession):
        kept = written(one.select("doc_id", "_r.grade", "_r.index"), "graded")
        sizes = kept.select("doc_id", F.xxhash64("doc_id").alias("h"), F.octet_length("index").cast("long").alias("n")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
        fits = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), max_bytes, "right"))
        if fits < len(sizes):
            some = documents.sparkSession.createDataFrame([(x,) for x in sizes["doc_id"].to_pylist()[:fits]], "doc_id long")
            kept = kept.join(F.broadcast(some), "doc_id", "left_semi")  # at most max_rows ids
        found = kept.toArrow().sort_by("doc_id")
    parts = [np.frombuffer(x, np.int32) for x in found["index"].to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    index = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    common = np.bincount(index, minlength=1 << bits)[index] >= min_rows
    starts, index = np.concatenate([[0], np.cumsum(common)])[starts], index[common]
    return fit_ordinal(index, starts, found["grade"].to_numpy().astype(np.int64), n_grades, bits)


def score(documents: DataFrame, model: OrdinalModel, tail_grade: int, least: float = 0.5, prefix: str = "") -> DataFrame:
    """``documents`` with ``score``, ``expected_grade``, ``tail`` (the probability of ``tail_grade`` or better) and ``keep`` (whether that is at least ``least``), all with ``prefix`` before their names."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)
    names = [prefix + c for c in OUTPUTS]
    kept = [c for c in documents.columns if c not in names]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in blocks(batches, "text"):
            scores = own.scores(*features(*text_bytes(batch, "text"), own.bits))
            above = own.above(scores)
            tail = above[:, tail_grade - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (scores, above.sum(axis=1), tail, tail >= least))], names=[*batch.schema.names, *names])

    rows = documents.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType(list(rows.schema.fields))
    for name, kind in zip(names, ("double", "double", "double", "boolean")):
        schema = schema.add(name, kind)
    return map_arrow(rows, rate, schema)
