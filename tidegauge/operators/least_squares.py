"""Ordinary least squares from sums alone: one combined aggregation, and a solver that is a row of expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(rows: DataFrame, features: list[str], target: str, by: list[str]) -> DataFrame:
    """Sums of products of the centred columns per group (``p_i_j``, the target last), means (``m_i``) and ``n``.

    Rows with a null or NaN in any column take no part. Products are sums of
    co-moments, which stay exact where raw sums of squares would cancel.
    """
    columns = [*features, target]
    for c in columns:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    parts = [F.count("*").alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)]]
    parts += [(F.covar_pop(x, y) * F.count("*")).alias(f"p_{i}_{j}") for i, x in enumerate(columns) for j, y in enumerate(columns) if i <= j]
    return rows.groupBy(*by).agg(*parts)


def solved(sums: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """``keep``, n, intercept, a coefficient per feature, ``rss`` and ``tss`` by a Cholesky factor; null coefficients where the features are dependent."""
    k = len(features)
    low: dict[tuple[int, int], str] = {}
    for i in range(k + 1):  # the target is the last row: its factors solve the system on the way
        for j in range(min(i, k - 1) + 1):
            value: Column = F.col(f"p_{j}_{i}")
            for m in range(j):
                value = value - F.col(low[i, m]) * F.col(low[j, m])
            value = F.when(value > 1e-12 * F.col(f"p_{j}_{j}"), F.sqrt(value)) if i == j else F.try_divide(value, F.col(low[j, j]))
            low[i, j] = f"_l_{i}_{j}"
            sums = sums.withColumn(low[i, j], value)
    for j in reversed(range(k)):
        value = F.col(low[k, j])
        for m in range(j + 1, k):
            value = value - F.col(low[m, j]) * F.col(f"_b_{m}")
        sums = sums.withColumn(f"_b_{j}", F.try_divide(value, F.col(low[j, j])))
    intercept, explained = F.col(f"m_{k}"), F.lit(0.0)
    for j in range(k):
        intercept = intercept - F.col(f"_b_{j}") * F.col(f"m_{j}")
        explained = explained + F.col(low[k, j]) * F.col(low[k, j])
    tss = F.col(f"p_{k}_{k}")
    return sums.select(*keep, "n", intercept.alias("intercept"), *[F.col(f"_b_{j}").alias(f) for j, f in enumerate(features)], (tss - explained).alias("rss"), tss.alias("tss"))
