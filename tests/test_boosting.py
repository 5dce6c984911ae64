"""Boosted trees against a plain search over all splits, and how they stop."""

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import boosting
from tidegauge.session import prepare


def plain(x, y, cuts, s):
    """Boosting by trying every split of every node on the rows themselves."""
    f, trees = np.full(len(y), y.mean()), []
    t = lambda g: np.sign(g) * max(abs(g) - s.l1, 0)
    score = lambda g: t(g.sum()) ** 2 / (len(g) + s.l2)
    for _ in range(s.rounds):
        g, value = f - y, np.zeros(len(y))
        todo, leaves = [(np.arange(len(y)), 0)], []
        while todo:
            at, depth = todo.pop()
            best = (1e-12, None)
            for k in range(x.shape[1]) if depth < s.depth else ():
                for c in cuts[k]:
                    left = x[at, k] <= c
                    if min(left.sum(), (~left).sum()) >= s.least:
                        gain = (score(g[at[left]]) + score(g[at[~left]]) - score(g[at])) / 2
                        if gain > best[0] + 1e-9:
                            best = (gain, left)
            if best[1] is None:
                leaves.append(at)
                value[at] = -s.step * t(g[at].sum()) / (len(at) + s.l2)
            else:
                todo += [(at[best[1]], depth + 1), (at[~best[1]], depth + 1)]
        f = f + value
        trees.append(leaves)
    return f, trees


def table(spark, x, y, **more):
    names = [f"x{k}" for k in range(x.shape[1])]
    rows = [(k, *map(float, r), float(v), *[bool(m[k]) for m in more.values()]) for k, (r, v) in enumerate(zip(x, y))]
    return prepare(spark).createDataFrame(rows, "k long, " + ", ".join(f"{n} double" for n in names) + ", y double" + "".join(f", {n} boolean" for n in more)).repartition(3), names


def test_trees_are_those_of_a_plain_search(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.integers(0, 9, 160), rng.normal(size=160).round(1), rng.integers(0, 2, 160)]).astype(float)
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1] * x[:, 2] + rng.normal(size=160) * 0.1
    s = boosting.Settings(rounds=4, step=0.3, depth=3, rows=1.0, columns=1.0, least=3)
    rows, names = table(spark, x, y)
    model = boosting.fit(rows, names, "y", ["k"], settings=s)
    got = boosting.predicted(rows, model, ["k"]).orderBy("k").toPandas()["prediction"].to_numpy()
    want, _ = plain(x, y, [np.unique(x[:, k])[:-1] for k in range(3)], s)
    assert np.allclose(got, want, atol=1e-9)
    assert len(model.trees) == 4 and np.mean((want - y) ** 2) < np.var(y) / 2


def test_leaves_draws_and_early_stop(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 3)
    rng = np.random.default_rng(1)
    x, noise = rng.normal(size=(400, 4)), rng.normal(size=400)
    y = np.where(x[:, 0] > 0, 3.0, -1.0) + np.abs(x[:, 1])
    held = np.arange(400) % 4 == 0
    y[held] += noise[held]
    x[5, 2] = np.nan
    rows, names = table(spark, x, y, held=held)
    few = boosting.fit(rows, names, "y", ["k"], "held", boosting.Settings(rounds=7, step=0.5, leaves=4, seed=3))
    assert len(few.trees) == 7 and all(t.feature.count(-1) >= 1 and len(set(t.nodes(rng.integers(0, 256, (2000, 4)).astype(np.uint8)))) <= 4 for t in few.trees)
    again = boosting.fit(rows, names, "y", ["k"], "held", boosting.Settings(rounds=7, step=0.5, leaves=4, seed=3))
    assert [(t.feature, t.cut) for t in again.trees] == [(t.feature, t.cut) for t in few.trees]
    assert np.allclose([v for t in again.trees for v in t.value], [v for t in few.trees for v in t.value])
    stopped = boosting.fit(rows, names, "y", ["k"], "held", boosting.Settings(rounds=40, step=0.9, depth=4, patience=3))
    assert 1 <= len(stopped.trees) < 40
    errors = [np.mean((np.array(boosting.predicted(rows.where("held"), boosting.Model(stopped.features, stopped.edges, stopped.base, stopped.trees[:n]), ["y"]).withColumn("e", F.pow(F.col("prediction") - F.col("y"), 2)).agg(F.avg("e")).first()))) for n in (0, len(stopped.trees))]
    assert errors[1] < errors[0]
    drawn = boosting._drawn(np.arange(20_000), 0.8, 3, 42)
    assert abs(drawn.mean() - 0.8) < 0.02 and (drawn != boosting._drawn(np.arange(20_000), 0.8, 4, 42)).mean() > 0.2
    nothing = boosting.fit(rows.limit(0), names, "y", ["k"], settings=boosting.Settings(rounds=1))
    assert boosting.predicted(rows, nothing, ["k"]).count() == 400
