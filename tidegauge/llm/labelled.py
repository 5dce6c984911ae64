"""A bounded sample of labelled texts, and a logistic calibration, for the two classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NOTHING = pa.table({"text": pa.array([], pa.string()), "label": pa.array([], pa.int32())})


def fitted(docs: DataFrame, labels: DataFrame, label: str, allowed: F.Column, per_class: dict[int, int], fit: Callable[[pa.Table, dict[int, float]], object]) -> object:
    """The model that ``fit`` makes of a seeded sample of labelled rows, as (text, label) in doc_id order.

    ``fit`` also gets how many labelled rows of its class a sampled row stands
    for. ``allowed`` says which rows of ``labels`` may be learnt from. Rows whose
    label or doc_id is null are no labels; a doc_id that is labelled twice counts
    with its greater label. The sample's expected size is bounded by ``per_class``
    (documented parameter), so it may be broadcast and learnt by one task; the
    model comes back to the driver, the texts don't. Without labelled texts (empty
    tables, or labels of other documents) ``fit`` gets none. Other columns are ignored, whatever their names.
    """
    known = labels.where(allowed & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    found = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    share = {k: min(1.0, per_class[k] / n) for k, n in found.items() if n}
    if not share:
        return fit(_NOTHING, {})
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    limit = F.coalesce(*[F.when(F.col("_label") == k, F.lit(v)) for k, v in share.items()])
    chosen = known.where(draw < limit).select(F.col("doc_id").alias("_doc"), "_label")
    texts = docs.select(F.col("doc_id").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc") == F.col("_doc")).select("text", F.col("_label").alias("label"), "doc")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.select(["text", "label"]) for b in batches if b.num_rows]
        table = pa.Table.from_batches(parts) if parts else _NOTHING
        got = np.bincount(table["label"].to_numpy(), minlength=2) if table.num_rows else np.zeros(2)
        model = fit(table, {k: n / max(1, got[k]) for k, n in found.items()})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    one = rows.repartition(1).sortWithinPartitions("doc", "text").mapInArrow(learn, "model binary")
    found_model = one.first()  # no row where the join is empty: an empty plan has no partition
    return pickle.loads(found_model["model"]) if found_model else fit(_NOTHING, {})


def logistic(features: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, bias last, of a weighted ridge logistic regression by damped Newton steps."""
    x = np.column_stack([features, np.ones(len(features))])
    beta, weight = np.zeros(x.shape[1]), weight / weight.sum() * len(weight) if len(weight) else weight
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (target - p)) - ridge * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def probability(features: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ beta[:-1] + beta[-1], -30, 30)))
