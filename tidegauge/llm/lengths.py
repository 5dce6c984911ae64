"""Token counts: an exact histogram of encoded lengths, and the answers that its suffix sums give.

Documents are aggregated by encoded length. For a context limit L the suffix
sums over lengths of at least L give how many documents and tokens reach it and
the corpus' tokens when every document is cut at L; prefix sums give quantiles.
Running sums are taken inside blocks of BLOCK lengths and over the blocks'
totals, so that no task orders all lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import written
from tidegauge.llm.tokens import default_path, encode_column

BLOCK = 1024


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(length, documents): how many rows of ``docs`` (text) encode to each length, as a written table.

    Null and empty texts have length 0. Every row counts, repeated ones too.
    """
    path = path or default_path()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, int] = {}
            for _, _, offsets in encode_column(batch.column(0), path):
                for n, c in zip(*(x.tolist() for x in np.unique(np.diff(offsets), return_counts=True))):
                    seen[n] = seen.get(n, 0) + c
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "documents"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lengths, "length long, documents long")
    return written(found.groupBy("length").agg(F.sum("documents").alias("documents")))


def context_table(histogram: DataFrame) -> DataFrame:
    """Per length L: documents, tokens, those of length at least L, the truncated total at L, and the share of documents up to L."""
    rows = histogram.withColumn("tokens", F.col("length") * F.col("documents")).withColumn("_block", F.floor(F.col("length") / BLOCK))
    totals = rows.groupBy("_block").agg(F.sum("documents").alias("_d"), F.sum("tokens").alias("_t"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("_block", F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_d_after"), F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_t_after"), F.sum("_d").over(everything).alias("_docs"), F.sum("_t").over(everything).alias("_tokens"))
    inside = Window.partitionBy("_block").orderBy(F.desc("length"))
    rows = rows.join(totals, "_block").withColumn("documents_ge", F.sum("documents").over(inside) + F.col("_d_after")).withColumn("tokens_ge", F.sum("tokens").over(inside) + F.col("_t_after"))
    cut = F.col("_tokens") - F.col("tokens_ge") + F.col("length") * F.col("documents_ge")
    up_to = (F.col("_docs") - F.col("documents_ge") + F.col("documents")) / F.col("_docs")
    return rows.select("length", "documents", "tokens", "documents_ge", "tokens_ge", cut.alias("truncated_total"), up_to.alias("share_up_to"))


def quantile(table: DataFrame, q: float) -> DataFrame:
    """One row: the least length that a share ``q`` of the documents does not exceed (null for no documents)."""
    return table.where(F.col("share_up_to") >= q).agg(F.min("length").alias("length"))


def truncated_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, tokens): the corpus' tokens when every document is cut at the limit, for limits that are no lengths too."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(x,) for x in limits], "limit long")
    # sum of min(length, L) = truncated total at the least length m >= L, less (m - L) for every document of at least m
    first = F.expr("min(struct(length, truncated_total, documents_ge))")
    least = asked.join(table, F.col("length") >= F.col("limit"), "left").groupBy("limit").agg(first.alias("m"))
    total = table.agg(F.sum("tokens").alias("all_tokens"))
    cut = F.col("m.truncated_total") - (F.col("m.length") - F.col("limit")) * F.col("m.documents_ge")
    return least.join(total).select("limit", F.coalesce(cut, F.col("all_tokens"), F.lit(0)).alias("tokens"))
