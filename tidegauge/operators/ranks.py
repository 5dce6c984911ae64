"""Ranks over whole tables without a task that sorts them all, and permutations of ranks without any sort."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.shared import written

#: Rounds of ``shuffled``, and the prime of its digests.
ROUNDS, PRIME = 24, 2**31 - 1
# Fixed values of the digests: multipliers below the prime, one more round's constant a step further on.
_A, _B, _C, _STEP = 1103515245, 747796405, 1597334677, 362437


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows``, written, with ``place`` (0, 1, ... in ``order``) and ``part``, the number of a place's range.

    Ranges of ``order`` are sorted on their own; a window over one row per range
    adds what the ranges before hold. ``order`` must break all ties.
    """
    ordered = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    parts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", "_first", before.alias("_before"))
    return ordered.withColumn("part", part).join(parts, "part").withColumn("place", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_first", "_before")


def moved(place: np.ndarray, repeat: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Where permutation ``repeat`` of 0 to n - 1 moves ``place``.

    A swap-or-not shuffle: a round pairs places whose sum is a key modulo n, and
    a digest of the pair decides whether they swap. Any n is permuted exactly,
    each place on its own. All products stay below 2**63.
    """
    for r in range(rounds):
        k = _squared(repeat * _A + (_B + r * _STEP))
        other = ((k * PRIME + _squared(k + _C)) % n + n - place) % n
        swap = (_squared(np.maximum(place, other) % PRIME * _C + k) >> 9) & 1
        place = np.where(swap == 1, other, place)
    return place


def _squared(x: np.ndarray) -> np.ndarray:
    below = x % PRIME
    return below * below % PRIME


def shuffled(place: Column, repeat: Column, n: Column) -> Column:
    """``moved`` as a column. Expressions would hold a round's place several times, and so grow with a power of the rounds."""

    @F.pandas_udf("long")
    def move(place: pd.Series, repeat: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(moved(place.to_numpy(np.int64), repeat.to_numpy(np.int64), n.to_numpy(np.int64)))

    return move(place.cast("long"), repeat.cast("long"), n.cast("long"))


def shuffled_sql(source: str, place: str, repeat: str, n: str, rounds: int = ROUNDS) -> str:
    """The same in SQL: ``source`` with ``place`` moved; ``n`` is an expression."""
    for r in range(rounds):
        low = f"(({repeat}::bigint * {_A} + {_B + r * _STEP}) % {PRIME})"
        keyed = f"select *, {low} * {low} % {PRIME} as k_ from {source}"
        second = f"((k_ + {_C}) % {PRIME})"
        paired = f"select *, ((k_ * {PRIME} + {second} * {second} % {PRIME}) % {n} + {n} - {place}) % {n} as o_ from ({keyed})"
        bit = f"((greatest({place}, o_) % {PRIME} * {_C} + k_) % {PRIME})"
        source = f"(select * exclude (k_, o_) replace (case when ({bit} * {bit} % {PRIME}) // 512 % 2 = 1 then o_ else {place} end as {place}) from ({paired}))"
    return source


def adjusted(tests: DataFrame, p: str, tie: str) -> DataFrame:
    """``tests`` with ``adjusted``: Benjamini-Hochberg adjusted p-values, at most 1. ``tie`` must tell tests apart; null p-values take no part."""
    ranked = placed(tests.where(F.col(p).isNotNull()), p, tie)
    n = ranked.agg(F.count("*").alias("_m"))
    raised = ranked.join(F.broadcast(n)).withColumn("_raised", F.col(p) * F.col("_m") / (F.col("place") + 1))
    later = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)  # a row per range
    parts = raised.groupBy("part").agg(F.min("_raised").alias("_least")).select("part", F.min("_least").over(later).alias("_later"))
    # from the last place down: a frame up to the end would be gone through again for every row
    inside = F.min("_raised").over(Window.partitionBy("part").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0))
    return raised.join(parts, "part").withColumn("adjusted", F.least(F.lit(1.0), inside, "_later")).drop("part", "place", "_m", "_raised", "_later")
