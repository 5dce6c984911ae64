"""Classification metrics from a confusion table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, truth, guess, n): one combined aggregation; everything else is computed from these few rows."""
    return rows.groupBy(*keys, "truth", "guess").agg(F.count("*").alias("n"))


def per_class(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, precision, recall, f1, support) of each class that occurs; ratios without cases are 0."""
    sides = table.select(*keys, F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("is_truth")), F.struct(F.col("guess").alias("label"), F.lit(0).alias("is_truth")))).alias("x"), "truth", "guess", "n")
    hit = (F.col("truth") == F.col("guess")) & (F.col("x.is_truth") == 1)
    g = sides.groupBy(*keys, F.col("x.label").alias("label")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("x.is_truth") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("x.is_truth") == 0, F.col("n")).otherwise(0)).alias("guessed"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.select(*keys, "label", zero(F.try_divide("tp", "guessed")).alias("precision"), zero(F.try_divide("tp", "support")).alias("recall"), zero(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("guessed"))).alias("f1"), "support")


def scores(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, accuracy, macro_f1, n)."""
    accuracy = table.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    macro = per_class(table, keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))
    return accuracy.join(macro, keys) if keys else accuracy.join(macro)
