"""Regularised gradient boosting of regression trees on binned features, grown from histograms that Spark sums.

Features become the numbers of their quantile bins, once. A level of a tree is
one job: every task sums the gradients of its rows by (node, feature, bin), the
sums are combined before and after one small shuffle, and the driver, which sees
nodes x features x bins numbers whatever the rows, splits the nodes. Tasks find a
row's node and prediction from the trees themselves, so that no job rewrites the
rows; every REFRESH trees the predictions are written once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.shared import written

#: Bins of a feature at most; trees after which predictions are written.
BINS, REFRESH = 255, 25
_SUMS = "node int, feature int, bin int, g double, h double"


@dataclass
class Settings:
    """``leaves``: None grows whole levels, a number the best of their splits up to so many leaves."""

    rounds: int = 800
    step: float = 0.05
    depth: int = 6
    leaves: int | None = None
    rows: float = 0.8
    columns: float = 0.8
    l1: float = 0.1
    l2: float = 1.0
    least: float = 1.0
    patience: int | None = None
    seed: int = 42


@dataclass
class Tree:
    """Nodes in order of creation: feature (-1: a leaf), last bin that goes left, first child (the other one follows), value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    child: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.child[node] = feature, cut, len(self.feature)
        for x, v in ((self.feature, -1), (self.cut, 0), (self.child, 0), (self.value, 0.0)):
            x += [v, v]
        return self.child[node], self.child[node] + 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at, feature, cut, child = np.zeros(len(bins), np.int64), *(np.array(x) for x in (self.feature, self.cut, self.child))
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            here = at[inner]
            at[inner] = child[here] + (bins[inner, feature[here]] > cut[here])

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Model:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    bins = np.frombuffer(b"".join(column("bins").to_pylist()), np.uint8).reshape(-1, width)
    return bins, column("draw").to_numpy(), column("y").to_numpy(), column("f").to_numpy(), column("held").to_numpy(zero_copy_only=False)


def _drawn(draw: np.ndarray, share: float, round_: int, seed: int) -> np.ndarray:
    """Which rows a round draws, by a digest of their number and the round."""
    with np.errstate(over="ignore"):
        x = draw.view(np.uint64) ^ (np.uint64(round_ + 1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def _summed(width: int, since: list[Tree], tree: Tree, wanted: list[int], columns: list[int], settings: Settings, round_: int):
    """Batches to their sums of gradients by (node, feature, bin); node -1 has the squared error of the rows held out."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(tree.feature), -1)
        place[wanted] = np.arange(len(wanted))
        total = np.zeros((2, len(wanted), len(columns), BINS + 1))
        error, held_rows = 0.0, 0
        for batch in batches:
            bins, draw, y, f, held = _arrays(batch, width)
            g = f + sum((t.predict(bins) for t in since), np.zeros(len(y))) - y
            error, held_rows = error + float((g[held] ** 2).sum()), held_rows + int(held.sum())
            used = ~held & _drawn(draw, settings.rows, round_, settings.seed)
            at = place[tree.nodes(bins)]
            used &= at >= 0
            at, g, bins = at[used], g[used], bins[used]
            for k, c in enumerate(columns):
                cell = at * (BINS + 1) + bins[:, c]
                for s, w in enumerate((g, None)):
                    total[s, :, k] += np.bincount(cell, w, len(wanted) * (BINS + 1)).reshape(len(wanted), -1)
        node, feature, bin_ = np.nonzero(total[1])
        parts = (np.append(np.array(wanted)[node], -1), np.append(np.array(columns)[feature], -1), np.append(bin_, -1), np.append(total[0][node, feature, bin_], error), np.append(total[1][node, feature, bin_], held_rows))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], ["node", "feature", "bin", "g", "h"])

    return sums


def shrunk(g, settings: Settings):
    """A sum of gradients less what L1 takes."""
    return np.sign(g) * np.maximum(np.abs(g) - settings.l1, 0)


def best_split(g: np.ndarray, h: np.ndarray, settings: Settings) -> tuple[float, int, int]:
    """(gain, feature's place, last bin on the left) of the best split of a node with these sums (features x bins); the first of equal ones."""
    left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    all_g, all_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
    score = lambda a, b: shrunk(a, settings) ** 2 / (b + settings.l2)
    gain = (score(left_g, left_h) + score(all_g - left_g, all_h - left_h) - score(all_g, all_h)) / 2
    gain[(left_h < settings.least) | (all_h - left_h < settings.least)] = -np.inf
    at = int(np.argmax(gain))
    return float(gain.flat[at]), *divmod(at, gain.shape[1])


def grown(rows: DataFrame, since: list[Tree], columns: list[int], settings: Settings, round_: int, width: int) -> tuple[Tree, float]:
    """The next tree, and the mean squared error of the rows held out before it."""
    tree, level, found, error = Tree(), [0], {}, float("nan")
    for depth in range(settings.depth + 1):
        sums = rows.mapInArrow(_summed(width, since, tree, level, columns, settings, round_), _SUMS).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
        loss = sums[sums["node"] < 0]
        error = float(loss["g"].sum() / loss["h"].sum()) if loss["h"].sum() else float("nan")
        sums, g, h = sums[sums["node"] >= 0], np.zeros((len(level), len(columns), BINS + 1)), np.zeros((len(level), len(columns), BINS + 1))
        index = tuple(x.map({v: i for i, v in enumerate(names)}).to_numpy(int) for x, names in ((sums["node"], level), (sums["feature"], columns)))
        g[(*index, sums["bin"])], h[(*index, sums["bin"])] = sums["g"], sums["h"]
        following: list[int] = []
        for i, node in enumerate(level):
            tree.value[node] = -settings.step * float(shrunk(g[i, 0].sum(), settings) / (h[i, 0].sum() + settings.l2))
            gain, k, cut = best_split(g[i], h[i], settings) if depth < settings.depth else (0.0, 0, 0)
            if gain > 1e-12:
                following += tree.split(node, columns[k], cut)
                found[node] = gain
        level = following
        if not level:
            break
    if settings.leaves:
        _pruned(tree, found, settings.leaves)
    return tree, error


def _pruned(tree: Tree, gains: dict[int, float], leaves: int) -> None:
    """Keep the splits that a growth from the best to the next best leaf makes, up to ``leaves`` of them."""
    kept, open_ = set(), [0]
    while len(kept) < leaves - 1 and (ready := [n for n in open_ if n in gains]):
        node = max(ready, key=lambda n: (gains[n], -n))
        kept.add(node)
        open_.remove(node)
        open_ += [tree.child[node], tree.child[node] + 1]
    for node in gains:
        if node not in kept:
            tree.feature[node] = -1


def _binned(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` and ``bins``, a byte per feature; missing values are in the first bin."""
    edges, features = model.edges, model.features

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            found = np.column_stack([np.where(np.isnan(v := column(f"_x{k}").to_numpy(zero_copy_only=False)), 0, np.searchsorted(e, v, "left") + 1) for k, e in enumerate(edges)]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*[column(c) for c in keep], pa.array([r.tobytes() for r in found], pa.binary())], [*keep, "bins"])

    chosen = rows.select(*keep, *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"_x{k}") for k, f in enumerate(features)])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[: len(keep)])
    return chosen.mapInArrow(cut, f"{kept}, bins binary")


def fit(train: DataFrame, features: list[str], target: str, key: list[str], held: str | None = None, settings: Settings = Settings()) -> Model:  # noqa: B008
    """A model of ``target``. Rows where ``held`` is true are not learnt from: with ``patience`` the trees end where their error was least.

    ``key`` names a row, for the draws of rounds. Rows without target take no part.
    """
    rows = train.where(F.col(target).isNotNull()).withColumns({"y": F.col(target).cast("double"), "draw": F.xxhash64(*key), "held": F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)})
    shares = [k / (BINS - 1) for k in range(1, BINS - 1)]
    cuts = rows.where("not held").stat.approxQuantile(list(features), shares, 1 / (8 * BINS))
    base = rows.where("not held").agg(F.avg("y")).first()[0] or 0.0
    model, width = Model(list(features), [np.unique(c) for c in cuts], float(base), []), len(features)
    rows = written(_binned(rows, model, ["draw", "y", "held"]).withColumn("f", F.lit(model.base)))
    rng, best, since = np.random.default_rng(settings.seed), (float("inf"), 0), []
    for round_ in range(settings.rounds):
        columns = sorted(rng.choice(width, max(1, round(settings.columns * width)), replace=False).tolist())
        tree, error = grown(rows, since, columns, settings, round_, width)
        if error < best[0]:
            best = error, round_
        if settings.patience and round_ - best[1] >= settings.patience:
            break
        model.trees.append(tree)
        since.append(tree)
        if len(since) == REFRESH:
            rows, since = written(_moved(rows, since, width)), []
    if settings.patience and best[0] < float("inf"):
        model.trees = model.trees[: best[1]] or model.trees[:1]
    return model


def _moved(rows: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, *_, f, _ = _arrays(batch, width)
            yield batch.set_column(batch.schema.get_field_index("f"), "f", pa.array(f + sum(t.predict(bins) for t in trees)))

    return rows.mapInArrow(moved, rows.schema)


def predicted(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` and ``prediction`` of each row."""
    base, trees, width = model.base, model.trees, len(model.features)
    binned = _binned(rows, model, keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in binned.schema.fields[:-1])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), np.uint8).reshape(-1, width)
            found = base + sum((t.predict(bins) for t in trees), np.zeros(len(bins)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*batch.schema.names[:-1], "prediction"])

    return binned.mapInArrow(apply, f"{kept}, prediction double")
