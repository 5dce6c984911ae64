"""Exact quantiles of large tables by distributed selection: nothing is sorted, and no buffer holds the distinct values.

A wanted rank starts with the whole range of its group's values. A round counts
the values of the range in CELLS parts of equal width, and goes on with the part
that holds the rank, from its least to its greatest value. It ends where these
are equal. Counts are combined before they are shuffled, so a round moves at
most CELLS rows per task and rank, whatever the groups' sizes or ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.shared import written

#: Parts of a range that a round counts.
CELLS = 1024


def selected(rows: DataFrame, key: str, value: str, ranks: DataFrame) -> DataFrame:
    """(key, rank, value): the value of each of ``ranks`` (key, rank from 0) in its key's order. Nulls and NaN have no rank."""
    v = F.col(value).cast("double")
    rows = rows.select(F.col(key).alias("_k"), v.alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    spans = rows.groupBy("_k").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    state = written(ranks.select(F.col(key).alias("_k"), F.col("rank").alias("_r"), F.col("rank").alias("_left")).distinct().alias("r").join(spans.alias("s"), F.col("r._k").eqNullSafe(F.col("s._k"))).select("r._k", "_r", "_left", "_low", "_high"))
    done = state.where("_low = _high")
    while not state.where("_low < _high").isEmpty():
        wanted = state.where("_low < _high").withColumnRenamed("_k", "_key")
        inside = rows.join(wanted, F.col("_k").eqNullSafe(F.col("_key")) & F.col("_v").between(F.col("_low"), F.col("_high")))
        width = F.col("_high") / CELLS - F.col("_low") / CELLS  # of ranges up to the greatest double, too
        cell = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(CELLS - 1))).otherwise(F.when(F.col("_v") > F.col("_low"), 1).otherwise(0)).cast("int")
        endless = (F.col("_low") == float("-inf")) | (F.col("_high") == float("inf"))  # a first round parts the infinite values from the others
        cell = F.when(endless, F.when(F.col("_v") == float("-inf"), 0).when(F.col("_v") == float("inf"), 2).otherwise(1)).otherwise(cell)
        counts = inside.groupBy("_k", "_r", "_left", cell.alias("_cell")).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k", "_r").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = counts.withColumn("_b", before).where((F.col("_left") >= F.col("_b")) & (F.col("_left") < F.col("_b") + F.col("_n")))
        state = written(hit.select("_k", "_r", (F.col("_left") - F.col("_b")).alias("_left"), "_low", "_high"))
        done = done.unionByName(state.where("_low = _high"))
    return done.select(F.col("_k").alias(key), F.col("_r").alias("rank"), F.col("_low").alias("value"))


def quantiles(rows: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, share, n, value): linearly interpolated quantiles of each key's values; keys without values have no row."""
    v = F.col(value).cast("double")
    sizes = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(F.col(key).alias("_g")).agg(F.count("*").alias("n"))
    wanted = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("at", F.col("share") * (F.col("n") - 1))
    wanted = written(wanted.withColumn("low", F.floor("at")).withColumn("high", F.ceil("at")))
    ranks = wanted.select(F.col("_g").alias(key), F.explode(F.array("low", "high")).alias("rank"))
    found = selected(rows, key, value, ranks)
    side = lambda name: found.select(F.col(key).alias(f"_{name}_g"), F.col("rank").alias(f"_{name}"), F.col("value").alias(f"_{name}_v"))
    for name in ("low", "high"):
        wanted = wanted.join(side(name), F.col("_g").eqNullSafe(F.col(f"_{name}_g")) & (F.col(name) == F.col(f"_{name}")))
    return wanted.select(F.col("_g").alias(key), "share", "n", (F.col("_low_v") + (F.col("at") - F.col("low")) * (F.col("_high_v") - F.col("_low_v"))).alias("value"))
