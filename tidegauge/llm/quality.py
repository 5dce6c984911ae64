"""Quality by a naive Bayes support vector machine on n-gram indicators.

Every whole text has indicators of hashed n-grams: byte trigrams, words, and
runs of one to three word shapes (case, digits, symbols, length, repetition of
the word before). Indicators are scaled by the log ratio of the classes' smoothed
counts; a linear hinge-loss model is fitted by dual coordinate descent on the
scaled indicators of a bounded labelled sample; a logistic map, fitted on sampled
rows that the descent did not see, turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import labelled
from tidegauge.llm.common import crc_mod
from tidegauge.llm.shingles import U64, mix, slices, word_hashes, word_spans

#: About so many labelled rows of each class are used to fit.
PER_CLASS = {0: 6000, 1: 6000}
BITS = 15
SIZE = 3 << BITS  # trigrams, words, shapes
SMOOTH, COST, EPOCHS = 1.0, 0.1, 12

_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP = 1, 2, 4, 8, 16
_FLAG = np.zeros(256, np.uint8)
_FLAG[65:91] = _UPPER
_FLAG[97:123] = _FLAG[0x80:] = _LOWER
_FLAG[48:58] = _DIGIT
_FLAG[33:48] = _FLAG[58:65] = _FLAG[91:97] = _FLAG[123:127] = _SYMBOL
_FLAG[[44, 46]] = _STOP


@dataclass
class Model:
    weights: np.ndarray
    scale: np.ndarray  # slope and bias of the logistic map


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the indicators that are set, in order."""
    docs = len(offsets) - 1
    there = np.zeros((docs, SIZE), bool)
    row = np.repeat(np.arange(docs), np.diff(offsets))
    if len(data) > 2:
        gram = data[:-2].astype(np.uint32) | (data[1:-1].astype(np.uint32) << 8) | (data[2:].astype(np.uint32) << 16)
        same = row[:-2] == row[2:]
        there[row[:-2][same], ((gram * np.uint32(2654435761)) >> np.uint32(32 - BITS))[same]] = True
    starts, ends, rows = word_spans(data, offsets)
    if len(starts):
        owner = np.repeat(np.arange(docs), np.diff(rows))
        hashes = word_hashes(data, starts, ends)
        there[owner, (1 << BITS) + (hashes >> U64(64 - BITS)).astype(np.int64)] = True
        shape = np.bitwise_or.reduceat(_FLAG[data], starts).astype(np.uint64)
        again = np.zeros(len(starts), np.uint64)
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        long = np.minimum(ends - starts, 15).astype(np.uint64) // U64(4)
        code = shape | (again << U64(5)) | (long << U64(6))
        run = code + U64(1)
        for n in range(1, 4):
            if n > 1:
                run = run[:-1] * U64(1021) + code[n - 1 :] + U64(1)
            if not len(run):
                break
            ok = owner[: len(run)] == owner[n - 1 :]
            there[owner[: len(run)][ok], (2 << BITS) + (mix(run * U64(4) + U64(n)) >> U64(64 - BITS)).astype(np.int64)[ok]] = True
    flat = np.flatnonzero(there.ravel())
    return flat // SIZE, flat % SIZE


#: Rows of the indicator table that are held at once.
ROWS_AT_ONCE = 256


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for at in range(0, len(column), ROWS_AT_ONCE):
        for first, data, offsets in slices(column.slice(at, ROWS_AT_ONCE)):
            row, feature = features(data, offsets)
            yield len(offsets) - 1, row, feature


def margins(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = [np.bincount(row, weights[feature], docs) / np.sqrt(np.maximum(np.bincount(row, minlength=docs), 1)) for docs, row, feature in _pieces(column)]
    return np.concatenate(out) if out else np.zeros(0)


def fit(table: pa.Table, weight: dict[int, float]) -> Model:
    """Log-count ratios, dual coordinate descent on four fifths of the rows, calibration on the last fifth."""
    label = table["label"].to_numpy().astype(np.int64)
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(SIZE), np.array([1.0, 0.0 if not len(label) else 3.0 if label[0] else -3.0]))
    rows: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for docs, row, feature in _pieces(table["text"].combine_chunks()):
            rows += np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, docs)))
    tuned = np.arange(len(rows)) % 5 == 4
    if len(np.unique(label[~tuned])) < 2 or len(np.unique(label[tuned])) < 2:
        tuned[:] = False
    counts = np.full((2, SIZE), SMOOTH)
    for i in np.flatnonzero(~tuned):
        counts[label[i], rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # every row has length about 1 times its mean squared ratio: long texts weigh no more than short ones
    y = np.where(label == 1, 1.0, -1.0)
    w, alpha, order = np.zeros(SIZE), np.zeros(len(rows)), np.flatnonzero(~tuned)
    norm = np.array([np.sqrt(max(1, len(r))) for r in rows])
    square = np.array([(ratio[r] ** 2).sum() for r in rows]) / norm**2
    share = np.bincount(label[~tuned], minlength=2) / max(1, (~tuned).sum())
    cost = COST / (2 * np.maximum(share, 1e-9))
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in rng.permutation(order):
            if square[i] == 0:
                continue
            r = rows[i]
            slope = y[i] * (w[r] * ratio[r]).sum() / norm[i] - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[label[i]])
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * y[i] * ratio[r] / norm[i]
                alpha[i] = new
    weights = w * ratio
    margin = np.array([weights[r].sum() for r in rows]) / norm
    on = tuned if tuned.any() else ~tuned
    each = np.array([weight.get(0, 1.0), weight.get(1, 1.0)])[label]
    return Model(weights, labelled.logistic(margin[on, None], label[on].astype(float), each[on]))


def train(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] | None = None) -> Model:
    """A model from ``labels`` (doc_id, quality) of rows whose crc32(doc_id) mod 3 is not 1."""
    return labelled.fitted(docs, labels, "quality", crc_mod(F.col("doc_id"), 3) != 1, per_class or PER_CLASS, fit)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id long, text string).

    Null texts count as empty; an empty text has no indicators and the score of
    margin 0. Repeated rows score alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights, whatever the data

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            p = labelled.probability(margins(batch.column(1), fitted.weights)[:, None], fitted.scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``."""
    rows = scored(docs, train(docs, labels))
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
