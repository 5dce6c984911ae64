"""Exponentially weighted means along series of any length: affine recurrences (``operators.scan``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.scan import Maps, scanned


def decay(alpha: float | None = None, span: float | None = None, com: float | None = None) -> float:
    """The share of a mean that a step takes from its new value."""
    return alpha if alpha is not None else 2 / (span + 1) if span is not None else 1 / (1 + com)


def _recurrences(name: str, x: Column, alpha: float, adjust: bool) -> Maps:
    """The recurrences behind a mean; a row without value leaves them as they are."""
    one = F.when(x.isNotNull(), F.lit(1.0))
    kept = F.when(x.isNotNull(), F.lit(1 - alpha))
    seen = {f"_n_{name}": (F.lit(1.0), one, None)}
    if adjust:
        return seen | {f"_sum_{name}": (kept, x, None), f"_weight_{name}": (kept, one, None)}
    return seen | {f"_mean_{name}": (kept, x * alpha, x)}


def with_ewm(series: DataFrame, columns: dict[str, tuple[str, dict]], key: str = "symbol", order: tuple[str, ...] = ("date",)) -> DataFrame:
    """``series`` with new columns name -> (input, arguments of the weighting).

    Inputs are SQL expressions and may use new columns that stand before;
    arguments are ``alpha``, ``span`` or ``com``, ``adjust`` (default true) and
    ``min_periods``. Rows whose input is null take no part: they repeat the mean,
    which doesn't age, and a mean is null until ``min_periods`` (at least one)
    values have come. Rows with a null key are a series. ``order`` must break the
    ties of a series.
    """
    rows, waiting = series, dict(columns)
    while waiting:  # inputs that need a mean of this round wait for the next one
        ready = {n: v for n, v in waiting.items() if not any(w in v[0] for w in waiting)} or waiting
        maps: Maps = {}
        for name, (source, given) in ready.items():
            how = {k: v for k, v in given.items() if k not in ("adjust", "min_periods")}
            maps |= _recurrences(name, F.expr(source).cast("double"), decay(**how), given.get("adjust", True))
        rows = scanned(rows, key, list(order), maps)
        for name, (_, given) in ready.items():
            mean = F.col(f"_sum_{name}") / F.nullif(F.col(f"_weight_{name}"), F.lit(0.0)) if given.get("adjust", True) else F.col(f"_mean_{name}")
            rows = rows.withColumn(name, F.when(F.col(f"_n_{name}") >= max(1, given.get("min_periods", 0)), mean))
        rows = rows.drop(*maps)
        waiting = {n: v for n, v in waiting.items() if n not in ready}
    return rows.drop("place", "part")
