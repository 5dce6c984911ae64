"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters; the chain of a text is all its tokens, however many.
The labels O (clean) and T (toxic) have emission weights on hashed features of
the token (its word and its beginnings of 3 to 8 bytes) and a transition matrix.
Forward-backward runs over all texts of a slice at once, on the odds of T against
O: chains are laid out in pieces side by side, the product of a piece's 2 x 2
matrices carries the state over it, and the pieces then start from the state that
the ones before (or behind) them left.

Labels are per document, so tokens get theirs first: in a toxic document a token
is T if one of its features is seen in toxic documents far more often than in
clean ones; all tokens of clean documents are O. Document scores come from a
logistic regression on the expected number of toxic tokens, the greatest
marginal and the expected share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import labelled
from tidegauge.llm.common import crc_mod
from tidegauge.llm.shingles import U64, _power_tables, mix, slices

#: Tokens of a piece at least and at most; in between it has the root of the longest chain's tokens.
PIECE = (64, 4096)
#: About so many labelled rows of each class are used to fit.
PER_CLASS = {0: 4000, 1: 4000}
BITS = 18
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A feature marks tokens of toxic documents if so many toxic documents have it, at such a precision.
MARK_DOCS, MARK_PRECISION = 5, 0.9
#: Passes over the training texts, and steps (a slice each) at least.
PASSES, STEPS, RATE, RIDGE = 4, 40, 0.5, 1e-6

_rng = np.random.default_rng(77)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_VALUE[65:91] = _VALUE[97:123]
_VALUE[0x80:0x9F] = _VALUE[0xA0:0xBF]  # also folds the case of most two-byte letters
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True


@dataclass
class Model:
    weights: np.ndarray
    transitions: np.ndarray  # [from, to], 0 clean and 1 toxic
    document: np.ndarray

    @staticmethod
    def neutral() -> "Model":
        return Model(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), np.array([0.0, 0.0, 0.0, -1.0]))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, first token of each row (one more at the end), and features [token, 7]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros((0, len(PREFIXES) + 1), np.int32)
    solid = _LETTER[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_VALUE[data] * power[:n], out=sums[1:])
    found = np.empty((len(starts), len(PREFIXES) + 1), np.int32)
    for k, length in enumerate((*PREFIXES, 0)):
        stop = np.minimum(starts + length, ends) if length else ends
        found[:, k] = (mix((sums[stop] - sums[starts]) * inverse[starts] + U64(k)) >> U64(64 - BITS)).astype(np.int32)
    return starts, ends, np.searchsorted(starts, offsets), found


def _step(x: np.ndarray, to: tuple[float, float], other: tuple[float, float]) -> np.ndarray:
    """Odds behind a 2 x 2 matrix with the rows ``other`` (for O) and ``to`` (for T)."""
    return np.clip((to[0] + to[1] * x) / (other[0] + other[1] * x), 1e-12, 1e12)


def _products(e: np.ndarray, a: np.ndarray) -> list[np.ndarray]:
    """Entries 00, 01, 10, 11 of each piece's product of (transposed transitions x emissions), up to a factor."""
    m00, m01, m10, m11 = np.ones(e.shape[1]), np.zeros(e.shape[1]), np.zeros(e.shape[1]), np.ones(e.shape[1])
    for t in range(len(e)):
        x, y = e[t] * m10, e[t] * m11
        m00, m01, m10, m11 = a[0, 0] * m00 + a[1, 0] * x, a[0, 0] * m01 + a[1, 0] * y, a[0, 1] * m00 + a[1, 1] * x, a[0, 1] * m01 + a[1, 1] * y
        if t % 8 == 7:
            whole = m00 + m01 + m10 + m11
            m00, m01, m10, m11 = m00 / whole, m01 / whole, m10 / whole, m11 / whole
    return [m00, m01, m10, m11]


def _backward(e: np.ndarray, sizes: np.ndarray, end: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Odds from the right at all places of pieces, given those at the last one of each."""
    right = np.tile(end, (len(e), 1))
    for t in range(len(e) - 2, -1, -1):
        right[t] = np.where(t + 1 < sizes, _step(e[t + 1] * right[t + 1], a[1], a[0]), right[t])
    return right


def forward_backward(scores: np.ndarray, rows: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of T from the left (own emission included), from the right, and exp(scores), for each token.

    ``rows``: the first token of each text, and one more at the end.
    """
    counts = np.diff(rows)
    if not len(scores):
        return np.zeros(0), np.zeros(0), np.zeros(0)
    size = int(np.clip(int(counts.max()) ** 0.5, *PIECE))
    pieces = -(-counts // size)
    head = np.cumsum(pieces) - pieces  # first piece of each text
    at = np.arange(rows[-1]) - np.repeat(rows[:-1], counts)
    piece, place = np.repeat(head, counts) + at // size, at % size
    emit, a = np.exp(np.clip(scores, -25, 25)), np.exp(transitions)
    e = np.ones((size, int(pieces.sum())))
    e[place, piece] = emit
    sizes = np.bincount(piece)
    some = pieces > 0
    last = (head + pieces - 1)[some]
    inner = np.setdiff1d(np.arange(len(sizes)), last)
    m = np.ones((4, len(sizes)))
    m[:, inner] = _products(e[:, inner], a)

    start = np.ones(len(sizes))  # odds that the piece before predicts
    for k in range(1, int(pieces.max())):
        i = head[pieces > k] + k
        start[i] = _step(start[i - 1], (m[2, i - 1], m[3, i - 1]), (m[0, i - 1], m[1, i - 1]))
    left = np.empty_like(e)
    left[0] = e[0] * start
    for t in range(1, size):
        left[t] = np.clip(e[t] * _step(left[t - 1], a[:, 1], a[:, 0]), 1e-12, 1e12)

    end, own = np.ones(len(sizes)), np.ones(len(sizes))  # own: what a piece hands to the one before it
    own[last] = (e[:, last] * _backward(e[:, last], sizes[last], end[last], a))[0]
    for k in range(2, int(pieces.max()) + 1):
        i = (head + pieces)[pieces >= k] - k
        end[i] = _step(own[i + 1], a[1], a[0])
        own[i] = _step(own[i + 1], (m[1, i], m[3, i]), (m[0, i], m[2, i]))
    right = _backward(e, sizes, end, a)
    return left[place, piece], right[place, piece], emit


def _scores(weights: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Sum of the features' weights for each token, a column at a time."""
    out = np.zeros(len(found))
    for k in range(found.shape[1]):
        out += weights.take(found[:, k])
    return out


def marginals(found: np.ndarray, rows: np.ndarray, model: Model) -> np.ndarray:
    """Probability of T for each token."""
    if not len(found):
        return np.zeros(0)
    left, right, _ = forward_backward(_scores(model.weights, found), rows, model.transitions)
    odds = left * right
    return odds / (1 + odds)


def document_features(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
    counts = np.diff(rows)
    sums = np.concatenate([[0.0], np.cumsum(p)])
    expected = np.maximum(sums[rows[1:]] - sums[rows[:-1]], 0)
    most = np.zeros(len(counts))
    if len(p):
        full = np.flatnonzero(counts)
        most[full] = np.maximum.reduceat(p, rows[:-1][full])
    return np.column_stack([np.log1p(expected), most, np.log1p(100 * expected / np.maximum(counts, 1))])


def _pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens' rows, features) of slices of the texts: features of all texts are never held at once."""
    for first, data, offsets in slices(texts):
        _, _, rows, found = tokens(data, offsets)
        yield first, rows, found


def _marks(texts: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Which features mark tokens of toxic documents."""
    seen = np.zeros((2, 1 << BITS), np.int32)
    for first, rows, found in _pieces(texts):
        for i in range(len(rows) - 1):
            seen[toxic[first + i], np.unique(found[rows[i] : rows[i + 1]])] += 1
    rate = seen / np.maximum(np.bincount(toxic, minlength=2), 1)[:, None]
    return (seen[1] >= MARK_DOCS) & (rate[1] >= MARK_PRECISION * (rate[1] + rate[0] + 1e-12)) & (rate[1] > 0)


def fit(table: pa.Table, weight: dict[int, float]) -> Model:
    """The field's weights by AdaGrad on the exact likelihood gradient of all chains of a slice at a time, then the document regression."""
    model = Model.neutral()
    if table.num_rows == 0:
        return model
    toxic, texts = table["label"].to_numpy().astype(np.int64), table["text"].combine_chunks()
    if toxic.min() == toxic.max():
        model.document = np.array([0.0, 0.0, 0.0, 3.0 if toxic.min() == 1 else -3.0])
        return model
    with np.errstate(over="ignore"):
        model.weights, model.transitions = _ascend(texts, toxic, _marks(texts, toxic))
        features = np.concatenate([document_features(marginals(found, rows, model), rows) for _, rows, found in _pieces(texts)])
    w = np.array([weight.get(0, 1.0), weight.get(1, 1.0)])[toxic]
    model.document = labelled.logistic(features, toxic.astype(float), w)
    return model


def _ascend(texts: pa.Array, toxic: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights that the likelihood's gradient leads to; a step sees all chains of a slice."""
    weights, trans = np.zeros(1 << BITS), np.zeros((2, 2))
    mass_w, mass_t = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6)
    count = sum(1 for _ in slices(texts))
    for _ in range(max(PASSES, -(-STEPS // max(1, count)))):
        for first, rows, f in _pieces(texts):
            if not len(f):
                continue
            y = np.zeros(len(f), bool)
            for k in range(f.shape[1]):
                y |= marked.take(f[:, k])
            y &= np.repeat(toxic[first : first + len(rows) - 1], np.diff(rows)) == 1
            left, right, e = forward_backward(_scores(weights, f) - 2.0, rows, trans)  # a prior against T
            odds = left * right
            gap, chains = y - odds / (1 + odds), np.count_nonzero(np.diff(rows))
            slope = sum(np.bincount(f[:, k], gap, 1 << BITS) for k in range(f.shape[1])) / chains - RIDGE * weights
            pair = np.ones(len(f), bool)  # a token and the next one of its text
            pair[rows[1:][rows[1:] > 0] - 1] = False
            pair = np.flatnonzero(pair)
            a = (1 / (1 + left[pair]), left[pair] / (1 + left[pair]))
            b = (1.0, e[pair + 1] * right[pair + 1])
            cells = [[a[i] * np.exp(trans[i, j]) * b[j] for j in (0, 1)] for i in (0, 1)]
            whole = cells[0][0] + cells[0][1] + cells[1][0] + cells[1][1]
            seen = np.bincount(2 * y[pair] + y[pair + 1], minlength=4).reshape(2, 2)
            expected = np.array([[(cells[i][j] / whole).sum() for j in (0, 1)] for i in (0, 1)])
            slope_t = (seen - expected) / chains - RIDGE * trans
            mass_w += slope**2
            mass_t += slope_t**2
            weights += RATE * slope / np.sqrt(mass_w)
            trans += 0.2 * RATE * slope_t / np.sqrt(mass_t)
    # the prior against T is spread over the features, so that scoring needs the weights only
    return (weights - 2.0 / (len(PREFIXES) + 1)).astype(np.float32), trans


def train(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] | None = None) -> Model:
    """A model from ``labels`` (doc_id, toxic) of rows whose crc32(doc_id) mod 5 is not 0."""
    return labelled.fitted(docs, labels, "toxic", crc_mod(F.col("doc_id"), 5) != 0, per_class or PER_CLASS, fit)


_SCHEMA = "doc_id long, score double, expected double, spans array<struct<start:int,stop:int,probability:double>>"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, expected, spans) of each row of ``docs`` (doc_id long, text string).

    ``expected`` is the expected number of toxic tokens and ``spans`` the maximal
    runs of tokens whose marginal is at least a half, as character offsets of
    the whole text. Texts without letters, empty and null texts have no spans and
    the score of a text without toxic tokens. Repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the data
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            out, expected, spans = [], [], []
            with np.errstate(over="ignore"):
                for _, data, offsets in slices(batch.column(1)):
                    starts, ends, rows, found = tokens(data, offsets)
                    p = marginals(found, rows, fitted)
                    features = document_features(p, rows)
                    out.append(labelled.probability(features, fitted.document))
                    expected.append(np.expm1(features[:, 0]))
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    hit = np.flatnonzero(p >= 0.5)
                    owner = np.searchsorted(rows, hit, "right") - 1
                    fresh = np.ones(len(hit), bool)
                    fresh[1:] = (np.diff(hit) != 1) | (np.diff(owner) != 0)
                    here: list[list] = [[] for _ in range(len(offsets) - 1)]
                    for i, o, f in zip(hit.tolist(), owner.tolist(), fresh.tolist()):
                        base = chars[offsets[o]]
                        if f:
                            here[o].append({"start": int(chars[starts[i]] - base), "stop": int(chars[ends[i]] - base), "probability": float(p[i])})
                        else:
                            here[o][-1]["stop"] = int(chars[ends[i]] - base)
                            here[o][-1]["probability"] = max(here[o][-1]["probability"], float(p[i]))
                    spans += here
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out)), pa.array(np.concatenate(expected)), pa.array(spans, kind)], ["doc_id", "score", "expected", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, _SCHEMA)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of each row of ``docs``."""
    rows = scored(docs, train(docs, labels))
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with their columns."""
    model, columns, spark = train(docs, labels), docs.columns, docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts, scores = batch.column(batch.schema.get_field_index("text")), []
            with np.errstate(over="ignore"):
                for _, data, offsets in slices(texts):
                    _, _, rows, found = tokens(data, offsets)
                    scores.append(labelled.probability(document_features(marginals(found, rows, fitted), rows), fitted.document))
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < 0.5))

    return docs.mapInArrow(keep, docs.schema).select(*columns)
