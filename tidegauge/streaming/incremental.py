"""Incremental refresh with Structured Streaming: bars with watermarks, resume by key, indicators of new days only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.shared import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str, table: str = "events", schema: str = EVENTS) -> DataFrame:
    """The table's files as a stream: files that come later are picked up by the next run."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")  # a pattern: the table may be one file


def drained(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None) -> DataFrame | None:
    """Run a stream over what is there, and give what it wrote; with ``each``, hand it every micro-batch instead.

    With a ``checkpoint`` folder of one's own a later run goes on where this one ended.
    """
    spark, folder = stream.sparkSession, shared_dir(stream.sparkSession)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{folder}/checkpoint")
    if each:
        writer.outputMode(mode).foreachBatch(each).start().awaitTermination()
        return None
    writer.outputMode(mode).format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


#: Rows of a batch that goes to a Python worker of such a stream: a row can be a key's whole hour.
STATE_ROWS = 32


def stateful(spark: SparkSession, provider: str, run: Callable[[], DataFrame]) -> DataFrame:
    """What ``run`` gives while streams keep their state in stores of ``provider``, two for each core at most.

    A store writes files in every batch, whatever it holds: stores that wait for a
    core only add their files' time.
    """
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    settings = {"spark.sql.streaming.stateStore.providerClass": provider, "spark.sql.shuffle.partitions": str(stores), "spark.sql.execution.arrow.maxRecordsPerBatch": str(STATE_ROWS)}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return run()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def hourly_bars(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Bars of each type and hour, emitted once the watermark has passed them."""
    timed = events.withColumn("at", F.to_timestamp(F.col("ts").cast("timestamp"))).withWatermark("at", delay)
    order = F.struct("ts", "event_id")
    grouped = timed.groupBy(F.window("at", "1 hour"), "event_type").agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume"))
    return grouped.select(F.col("event_type").alias("symbol"), F.col("window.start").alias("hour"), "open", "high", "low", "close", "volume")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    timed = events.withColumn("at", F.to_timestamp(F.col("ts").cast("timestamp"))).withWatermark("at", "1 hour")
    grouped = timed.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("events"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def first_seen(events: DataFrame) -> DataFrame:
    """Each event_id once, whatever is delivered again within the watermark."""
    timed = events.withColumn("at", F.to_timestamp(F.col("ts").cast("timestamp"))).withWatermark("at", "1 day")
    return timed.dropDuplicatesWithinWatermark(["event_id"]).drop("at")


def refresh(spark: SparkSession, stored: str, events: DataFrame, batch: int) -> None:
    """Take a micro-batch of events: recompute the series it touches, and write the days whose figures changed.

    ``stored`` holds two tables by batch: ``parts``, what each batch adds to a day,
    and ``days``, the figures of the days that it changed (of a day the newest
    batch counts). A batch overwrites what itself wrote, and only looks at
    batches up to itself, so that one that is delivered again changes nothing.
    """
    order = F.struct("ts", "event_id")
    part = events.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date")).agg(F.max_by("value", order).alias("close"), F.max(order).alias("last"), F.count("*").alias("n"))
    part.write.mode("overwrite").parquet(f"{stored}/parts/batch={batch}")
    parts = spark.read.parquet(f"{stored}/parts").where(F.col("batch") <= batch)
    touched = parts.where(F.col("batch") == batch).groupBy("symbol").agg(F.min("date").alias("since"))
    days = parts.join(touched, "symbol").groupBy("symbol", "date", "since").agg(F.max_by("close", "last").alias("close"), F.sum("n").alias("n"))
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-4, 0)
    figures = days.withColumn("ma_5", F.when(F.count("close").over(w) == 5, F.round(F.avg("close").over(w), 6)))
    # averages reach four days back: a day's figures change only from the first day of the batch on
    figures.where("date >= since").drop("since").write.mode("overwrite").parquet(f"{stored}/days/batch={batch}")


def daily_state(spark: SparkSession, stored: str) -> DataFrame:
    """(symbol, date, close, n, ma_5): of each day the figures that the newest batch gave it."""
    rows = spark.read.parquet(f"{stored}/days").groupBy("symbol", "date").agg(F.max_by(F.struct("close", "n", "ma_5"), "batch").alias("f"))
    return rows.select("symbol", "date", "f.close", "f.n", "f.ma_5")


def incremental_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily figures after the event stream has been taken in micro-batches."""
    stored = shared_dir(spark)
    drained(source(spark, sf_dir), each=lambda events, batch: refresh(spark, stored, events, batch))
    return daily_state(spark, stored)
