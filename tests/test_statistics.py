"""Quantiles by selection, tails of distributions, and least squares from sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import tails
from tidegauge.operators import least_squares, quantiles
from tidegauge.session import prepare


def test_quantiles_of_odd_columns(spark):
    """Ties of most rows, one value, wide and tiny ranges, infinite and missing values, a null key; against linear interpolation of the sorted values."""
    rng = np.random.default_rng(1)
    groups = {
        "plain": rng.normal(size=2000), "tied": np.r_[np.full(900, 3.5), rng.normal(size=50)], "one": np.array([7.0]), "wide": np.r_[1e300, -1e300, 5e-324, 0.0, rng.normal(size=40) * 1e-200, rng.normal(size=40) * 1e100],
        "near": 1 + np.arange(30) * 2.0**-52, "endless": np.r_[np.inf, np.inf, -np.inf, rng.normal(size=9)], None: rng.integers(0, 5, 200).astype(float), "greatest": np.array([1.7e308, -1.7e308, 0.0]),
    }
    data = [(k, float(v)) for k, x in groups.items() for v in x] + [("plain", None), ("plain", float("nan")), ("none", None)]
    shares = [0.0, 0.1, 0.5, 0.905, 1.0]
    rows = prepare(spark).createDataFrame(data, "k string, v double").repartition(3)
    got = {(r.k, r.share): (r.n, r.value) for r in quantiles.quantiles(rows, "k", "v", shares).collect()}
    assert len(got) == len(groups) * len(shares)
    for k, x in groups.items():
        x = np.sort(x)
        for s in shares:
            at = s * (len(x) - 1)
            low, high = x[math.floor(at)], x[math.ceil(at)]
            want = low + (at - math.floor(at)) * (high - low)
            n, value = got[k, s]
            assert n == len(x) and (value == want or (math.isnan(value) and math.isnan(want)) or abs(value - want) <= 1e-15 * abs(want)), (k, s)
    assert quantiles.quantiles(rows.limit(0), "k", "v", shares).count() == 0


@pytest.mark.parametrize("t, df, p", [  # tables of Student's t
    (12.7062047364, 1, 0.05), (4.30265272991, 2, 0.05), (2.22813885196, 10, 0.05), (2.04227245630, 30, 0.05), (3.16927266, 10, 0.01), (0.0, 5, 1.0), (1.959963986, 1e7, 0.05), (636.619248769, 1, 0.001), (-2.22813885196, 10, 0.05),
])
def test_student(spark, t, df, p):
    row = prepare(spark).createDataFrame([(t, float(df))], "t double, df double").select(tails.student(F.col("t"), F.col("df")).alias("p")).first()
    assert row.p == pytest.approx(p, rel=1e-6)


def test_normal_and_log_gamma(spark):
    z = [0.0, 1e-9, 0.5, 1.0, 1.959963985, 2.5758293035, 2.82, 2.83, 5.0, 10.0, -1.0, 30.0]
    got = prepare(spark).createDataFrame([(x,) for x in z], "z double").select("z", tails.normal(F.col("z")).alias("p"), tails.log_gamma(F.abs("z") + 0.01).alias("g")).collect()
    for r in got:
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-11)
        assert r.g == pytest.approx(math.lgamma(abs(r.z) + 0.01), rel=1e-11, abs=1e-11)
    assert spark.range(1).select(tails.student(F.lit(1.0), F.lit(0.0)).alias("p"), tails.normal(F.lit(None)).alias("q")).first() == (None, None)


def test_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) * [1, 100, 1e-3] + [1e6, 5, 0]
    y = 4 + x @ [2.0, -0.5, 30.0] + rng.normal(size=300)
    data = [("a", *map(float, r), float(v)) for r, v in zip(x, y)] + [("a", None, 1.0, 1.0, 1.0), ("a", float("nan"), 1.0, 1.0, 1.0)]
    data += [("dependent", float(k), float(2 * k), 1.0, float(k)) for k in range(10)] + [("few", 1.0, 2.0, 3.0, 4.0)]
    rows = prepare(spark).createDataFrame(data, "g string, x0 double, x1 double, x2 double, y double")
    fit = {r.g: r for r in least_squares.solved(least_squares.gram(rows, ["x0", "x1", "x2"], "y", ["g"]), ["x0", "x1", "x2"], ["g"]).collect()}
    want, rss, *_ = np.linalg.lstsq(np.column_stack([np.ones(300), x - x.mean(0)]), y, rcond=None)
    assert [fit["a"][c] for c in ("x0", "x1", "x2")] == pytest.approx(want[1:], rel=1e-8) and fit["a"].n == 300
    assert fit["a"].rss == pytest.approx(rss[0], rel=1e-6) and fit["a"].intercept == pytest.approx(want[0] - want[1:] @ x.mean(0), rel=1e-8)
    assert fit["dependent"].x1 is None and fit["few"].x0 is None
