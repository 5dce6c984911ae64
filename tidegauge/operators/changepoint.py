"""Change points of a series by penalised least squares, pruned exact dynamic programming on a grid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Penalty factor, least length of a series, grid step and least segment.
PENALTY, LEAST, JUMP, SEGMENT = 0.5, 100, 5, 2
# Fixed value: values on either side of a point that its direction and magnitude compare.
AROUND = 20


def breakpoints(values: np.ndarray, penalty: float = PENALTY, jump: int = JUMP, segment: int = SEGMENT) -> list[int]:
    """Starts of new segments of the z-scored values, without the end; none for a constant series.

    The cost of a segment is its squared deviation from its mean; every segment
    adds ``penalty * ln(n)``. Ties go to the earlier last break.
    """
    n, spread = len(values), values.std()
    if n < 2 or spread == 0:
        return []
    z = (values - values.mean()) / spread
    s, q = np.concatenate([[0.0], np.cumsum(z)]), np.concatenate([[0.0], np.cumsum(z * z)])
    price = penalty * math.log(n)
    ends = [t for t in range(jump, n, jump) if t >= segment] + [n]
    best, last, open_ = {0: -price}, {}, [0]
    for t in ends:
        a = np.array([x for x in open_ if t - x >= segment], np.int64)
        if not len(a):
            continue
        before = np.array([best[x] for x in a.tolist()])
        total = before + (q[t] - q[a]) - (s[t] - s[a]) ** 2 / (t - a) + price
        at = int(np.argmin(total))
        best[t], last[t] = float(total[at]), int(a[at])
        alive = set(a[total - price <= best[t]].tolist())
        open_ = [x for x in open_ if x in alive or t - x < segment] + [t]
    found, t = [], n
    while last.get(t, 0) > 0:
        t = last[t]
        found.append(t)
    return found[::-1]


def change_points(series: DataFrame, least: int = LEAST, **options) -> DataFrame:
    """(symbol, date, place) of the change points of ``series`` (symbol, date, value); null values are dropped.

    A task has one symbol's daily values, at most a row per trading day.
    """

    def detect(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=["value"]).sort_values("date").reset_index(drop=True)
        places = breakpoints(frame["value"].to_numpy(float), **options) if len(frame) >= least else []
        out = frame.iloc[places][["symbol", "date"]].copy()
        out["place"] = np.array(places, np.int32)
        return out

    return series.select("symbol", "date", "value").groupBy("symbol").applyInPandas(detect, "symbol string, date date, place int")


def detected(returns: DataFrame, around: int = AROUND, **options) -> DataFrame:
    """(symbol, date, direction, magnitude) of the change points of ``returns`` (symbol, date, value).

    Direction (1 or -1) and magnitude come from the means of the ``around`` values
    from the point on and before it.
    """
    returns = returns.select("symbol", "date", "value").where("value is not null")
    w = Window.partitionBy("symbol").orderBy("date")
    gap = F.avg("value").over(w.rowsBetween(0, around - 1)) - F.avg("value").over(w.rowsBetween(-around, -1))
    found = change_points(returns, **options).join(returns.select("symbol", "date", gap.alias("gap")), ["symbol", "date"])
    return found.select("symbol", "date", F.when(F.col("gap") > 0, 1).otherwise(-1).alias("direction"), F.round(F.abs("gap"), 6).alias("magnitude"))
