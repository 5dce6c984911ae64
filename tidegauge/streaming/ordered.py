"""Exponentially weighted means of a stream, in the order of event time, by keyed state.

1. Rows wait in the state of their key and hour until the watermark has passed
   the hour, so that late rows find their place; then the hour comes out, once.
2. Every hour sorts its rows and composes their steps, which are affine maps of
   the mean (``operators.scan``), wherever it is.
3. The hours' last maps, a small row each, go to the state of their key, which
   carries the mean from hour to hour and gives what each hour starts from. The
   hours' rows pass it by, dealt by key and hour.
4. Each hour's start meets its rows again, and every row applies its map.

So a key of all rows is as many tasks as one of any other stream; what a task
holds at once is an hour of a key. What is kept of a key between batches is its
mean and the rows of hours that aren't over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.operators.scan import prefixes

#: State stores that keyed state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "symbol string, event_id long, us long, value double, mean double"
SPAN = "1 hour"
#: Groups that hours' rows are dealt to while they pass the keys' means by.
GROUPS = 256
#: A row of an hour with its composed map; ``a`` is NaN up to the hour's first value, ``known`` tells of an event_id.
_ROW = np.dtype([("event_id", "<i8"), ("known", "?"), ("us", "<i8"), ("value", "<f8"), ("a", "<f8"), ("b", "<f8")])
_LAST = np.iinfo(np.int64).max


def _composed(alpha: float):
    """The rows of an hour, to the same sorted and packed with their maps; the map of the whole hour, and its first value."""

    @F.arrow_udf("rows binary, a double, b double, first double")
    def composed(hours: pa.Array) -> pa.Array:
        sizes = hours.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = hours.flatten(), np.cumsum(sizes)
        rows, hour = np.zeros(len(flat), _ROW), np.repeat(np.arange(len(sizes)), sizes)
        column = lambda c, kind, none: flat.field(c).fill_null(none).to_numpy(zero_copy_only=False).astype(kind)
        rows["known"] = flat.field("event_id").is_valid().to_numpy(zero_copy_only=False)
        for c, kind, none in (("event_id", "i8", _LAST), ("us", "i8", 0), ("value", "f8", np.nan)):
            rows[c] = column(c, kind, none)
        rows = rows[np.lexsort((rows["event_id"], rows["us"], hour))]
        some = ~np.isnan(rows["value"])  # a row without value repeats the mean
        fresh = np.ones(len(rows), bool)
        fresh[1:] = hour[1:] != hour[:-1]
        a, b = prefixes(np.where(some, 1 - alpha, 1.0)[:, None], np.where(some, alpha * rows["value"], 0.0)[:, None], fresh)
        seen = np.cumsum(some)
        seen -= np.repeat((seen - some)[ends - sizes], sizes)
        rows["a"], rows["b"] = np.where(seen > 0, a[:, 0], np.nan), b[:, 0]
        first, at = np.full(len(sizes), np.nan), np.flatnonzero(some & (seen == 1))
        first[hour[at]] = rows["value"][at]
        packed = [rows[end - n : end].tobytes() for end, n in zip(ends, sizes)]
        whole = [pa.array(packed, pa.binary()), pa.array(a[ends - 1, 0]), pa.array(b[ends - 1, 0]), pa.array(first, from_pandas=True)]
        return pa.StructArray.from_arrays(whole, ["rows", "a", "b", "first"])

    return composed


class Starts(StatefulProcessor):
    """What each hour of a key starts from, by the maps of the hours before; packed rows (of other groups) pass as they are."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mean = handle.getValueState("mean", "mean double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[1] >= 0:
            for batch in rows:
                yield batch[["symbol", "at", "rows", "first"]].assign(start=np.nan)[["symbol", "at", "rows", "start", "first"]]
            return
        hours = pd.concat(list(rows)).sort_values("at")  # those of earlier batches were all before
        mean, starts = self.mean.get()[0] if self.mean.exists() else None, []
        for a, b, first in zip(hours["a"], hours["b"], hours["first"]):
            starts.append(mean)
            if pd.notna(first):  # an hour without values repeats the mean
                mean = float(a * (first if mean is None else mean) + b)
        if mean is not None:
            self.mean.update((mean,))
        yield pd.DataFrame({"symbol": hours["symbol"], "at": hours["at"], "rows": None, "start": pd.Series(starts, hours.index, dtype="float64"), "first": np.nan})

    def close(self) -> None:
        pass


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed hours and their starts, to rows with means."""
    for batch in batches:
        for k in range(batch.num_rows):
            symbol, packed, start, first = (batch.column(c)[k].as_py() for c in ("symbol", "rows", "start", "first"))
            rows, start = np.frombuffer(packed, _ROW), np.nan if start is None else start
            mean = np.where(np.isnan(rows["a"]), start, rows["a"] * (first if np.isnan(start) and first is not None else start) + rows["b"])
            columns = [pa.array([symbol] * len(rows), pa.string()), pa.array(rows["event_id"], mask=~rows["known"]), pa.array(rows["us"]), pa.array(rows["value"], from_pandas=True), pa.array(mean, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, ["symbol", "event_id", "us", "value", "mean"])


def ordered_means(events: DataFrame, alpha: float, delay: str = "1 hour") -> DataFrame:
    """(symbol, event_id, us, value, mean) of a stream of events, ``us`` their microseconds since the epoch.

    Each row once, when the watermark (``delay`` behind the latest row) has passed
    its hour; rows that come later than that are dropped. Rows without type are a
    series; rows without time are dropped.
    """
    at = F.col("ts").cast("timestamp")
    timed = events.where("ts is not null").select(F.coalesce("event_type", F.lit("")).alias("symbol"), "event_id", F.unix_micros(at).alias("us"), "value", at.alias("at"))
    hours = timed.withWatermark("at", delay).groupBy(F.window("at", SPAN), "symbol").agg(F.collect_list(F.struct("event_id", "us", "value")).alias("rows"))
    hours = hours.select("symbol", F.window_time("window").alias("at"), _composed(alpha)("rows").alias("hour"))
    group = F.pmod(F.xxhash64("symbol", "at"), F.lit(GROUPS)).cast("int")
    both = hours.select("symbol", "at", "hour", F.explode(F.array(F.lit(-1), group)).alias("group"))
    last = F.col("group") < 0
    dealt = both.select(F.when(last, F.col("symbol")).otherwise("").alias("series"), "group", "symbol", "at", F.when(~last, F.col("hour.rows")).alias("rows"), "hour.a", "hour.b", "hour.first")
    started = dealt.groupBy("series", "group").transformWithStateInPandas(Starts(), "symbol string, at timestamp, rows binary, start double, first double", "Append", "EventTime", eventTimeColumnName="at")
    met = started.groupBy(F.window("at", SPAN), "symbol").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("rows", "start", "first")])
    return met.select("symbol", "rows", "start", "first").mapInArrow(_means, OUT)
