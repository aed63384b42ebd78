"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become tf-idf vectors of hashed byte trigrams and of words that come again after a few
words; a truncated singular value decomposition
of the labelled ones gives the latent space.  The labelled vectors are broadcast, every
document's cosine with all of them is computed exactly in blocks, and its nearest neighbours
vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common as C
from engram.llm.toxicity import training_rows

TRIGRAMS = 2048
#: A word that comes again after 1 to so many words is a term of its own for each distance.
DISTANCES = 12
FEATURES = TRIGRAMS + DISTANCES
#: Weight of those terms.
REPEAT_WEIGHT = 5.0
DIMENSIONS = 64
NEIGHBOURS = 31
SHARPNESS = 8
ROWS = 256
_TABLES = np.random.default_rng(4242).integers(0, TRIGRAMS, (3, 256), dtype=np.uint16)


@dataclass
class Model:
    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    prior: float


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, FEATURES): counts of hashed byte trigrams that stay within a row, and for each
    distance the percentage of a row's words that repeat the word so far before."""
    rows = len(offsets) - 1
    out = np.zeros((rows, FEATURES), dtype=np.float32)
    if len(data) < 3:
        return out
    code = _TABLES[0][data[:-2]] ^ _TABLES[1][data[1:-1]] ^ _TABLES[2][data[2:]]
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    inside = owner[:-2] == owner[2:]
    flat = owner[:-2][inside] * TRIGRAMS + code[inside]
    out[:, :TRIGRAMS] = np.bincount(flat, minlength=rows * TRIGRAMS).reshape(rows, TRIGRAMS)
    words, row = C.word_hashes(data, offsets)
    number = np.maximum(np.bincount(row, minlength=rows), 1)
    for far in range(1, DISTANCES + 1):
        again = row[far:][(words[far:] == words[:-far]) & (row[far:] == row[:-far])]
        out[:, TRIGRAMS + far - 1] = 100 * np.bincount(again, minlength=rows) / number
    return out


def blocks(column: pa.Array):
    """(first row, counts) of at most ROWS rows at a time."""
    for begin in range(0, len(column), ROWS):
        for row, data, offsets in C.slices(column.slice(begin, ROWS)):
            yield begin + row, counts(data, offsets)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _weighted(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(found) * weights)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all documents hold each feature, and how many there are."""

    def run(batches):
        total, rows = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for _, found in blocks(batch.column(0)):
                total += (found > 0).sum(axis=0)
                rows += len(found)
        feature = np.append(np.arange(FEATURES), FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(np.append(total, rows))],
                                         names=["feature", "n"])

    sums = (C.texts(docs).select("text").mapInArrow(run, "feature long, n long")
            .groupBy("feature").agg(F.sum("n").alias("n"))).toArrow()
    out = np.zeros(FEATURES + 1, dtype=np.int64)
    out[np.asarray(sums["feature"])] = np.asarray(sums["n"])
    return out[:-1], int(out[-1])


def learn(docs: DataFrame, labels: DataFrame, condition, per_class: int = 2_000) -> Model:
    """Fit on at most 2 * per_class labelled documents; document frequencies count all documents."""
    known = labels.filter(condition).groupBy("quality").count().toPandas()
    share = {int(q): int(n) for q, n in zip(known["quality"], known["count"], strict=True)
             if q in (0, 1)}
    prior = share.get(1, 0) / max(sum(share.values()), 1)
    seen, rows = document_frequencies(docs)
    weights = np.log((1 + rows) / (1 + seen)).astype(np.float32) + 0.1
    weights[TRIGRAMS:] *= REPEAT_WEIGHT

    def run(batches):
        for batch in batches:
            y = np.asarray(batch.column(1))
            for row, found in blocks(batch.column(0)):
                x = _weighted(found, weights).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.array(y[row:row + len(x)], pa.int32())], names=["x", "y"])

    train = training_rows(docs, labels, "quality", condition, per_class)
    found = train.mapInArrow(run, "x binary, y int").toArrow()
    y = np.asarray(found["y"]).astype(np.float32)
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float16).reshape(-1, FEATURES)
    x = x.astype(np.float32)
    order = np.lexsort((y, x @ np.linspace(1, 2, FEATURES, dtype=np.float32)))
    x, y = x[order], y[order]
    # Truncated decomposition by subspace iteration.
    basis = np.random.default_rng(9).standard_normal((FEATURES, DIMENSIONS + 16)).astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ turn[:DIMENSIONS].T).astype(np.float32)
    sample = np.array([np.sum(y == 0), np.sum(y == 1)], dtype=float)
    votes = np.array([1 - prior, prior]) / np.maximum(sample, 1)
    votes = (votes / max(votes.max(), 1e-12))[y.astype(int)].astype(np.float32)
    return Model(weights, axes, _unit(x @ axes).astype(np.float32), y, votes, prior)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row.

    Texts without a trigram (null and empty ones too), and all texts when no label could be
    learned, get the share of good labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vote(found):
        fit = shared.value
        point = _unit(_weighted(found, fit.weights) @ fit.axes)
        near = point @ fit.vectors.T
        if near.shape[1] > NEIGHBOURS:
            best = np.argpartition(near, -NEIGHBOURS, axis=1)[:, -NEIGHBOURS:]
        else:
            best = np.broadcast_to(np.arange(near.shape[1]), near.shape)
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** SHARPNESS * fit.votes[best]
        total = weight.sum(axis=1)
        good = (weight * fit.labels[best]).sum(axis=1)
        known = (total > 1e-12) & (found.sum(axis=1) > 0)
        return np.where(known, good / np.where(known, total, 1), fit.prior)

    def run(batches):
        for batch in batches:
            for row, found in blocks(batch.column(1)):
                score = (vote(found).astype(float) if len(shared.value.labels)
                         else np.full(len(found), shared.value.prior))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(found)), pa.array(np.clip(score, 0, 1))],
                    names=["doc_id", "score"])

    return C.texts(docs).mapInArrow(run, "doc_id long, score double")
