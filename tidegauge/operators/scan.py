"""Recurrences along a series, ``y = a * y_before + b``, as an associative scan over sorted ranges.

A step of the recurrence is the affine map ``y -> a * y + b``, and maps of
consecutive rows compose into one. Rows are sorted by (key, order) in ranges of
bounded size, whatever a series' length:

1. each range composes its maps, row by row, from the identity: every row gets
   the map that leads from the range's start to it;
2. the last map of each range and series is a row of a small table, which is
   composed in order: what a range starts from;
3. every row applies its map to what its range starts from.

A series of all rows is so spread over as many tasks as one of any other
table, and short series share a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidegauge.shared import written

#: Name -> (a, b, start): a row's map, and a column whose first value that isn't null a series starts from (None: from 0).
Maps = dict[str, tuple[Column, Column, Column | None]]


def prefixes(a: np.ndarray, b: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The composed maps of each run of rows that begins where ``fresh``, up to each row, in log2(rows) vector steps.

    ``a`` and ``b`` have a row per step and a column per recurrence.
    """
    a, b, n = a.copy(), b.copy(), len(a)
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step = 1
    while step < n:
        at = np.flatnonzero(np.arange(n) - start >= step)  # rows whose map doesn't reach their run's start yet
        if not len(at):
            break
        b[at], a[at] = a[at] * b[at - step] + b[at], a[at] * a[at - step]
        step *= 2
    return a, b


def _composed(names: list[str], key: str, number: bool):
    """Sorted batches to the same with each row's composed maps; with ``number`` also with its range (``part``) and its place there."""

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, read = None, 0  # (part, key) and the maps of the row before; rows before
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if number:
                own, places = np.full(n, TaskContext.get().partitionId(), np.int64), np.arange(read, read + n)
                batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(places)], [*batch.schema.names, "part", "place"])
                read += n
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            a, b = (np.column_stack([column(f"{k}_{x}").to_numpy(zero_copy_only=False) for x in names]) for k in ("_a", "_b"))
            part, code = column("part").to_numpy(), column(key).dictionary_encode().indices.fill_null(-1).to_numpy()
            fresh = np.ones(n, bool)
            fresh[1:] = (part[1:] != part[:-1]) | (code[1:] != code[:-1])
            if last and last[0] == (part[0], column(key)[0].as_py()):
                a[0], b[0] = a[0] * last[1], a[0] * last[2] + b[0]
            a, b = prefixes(a, b, fresh)
            last = (part[-1], column(key)[-1].as_py()), a[-1], b[-1]
            for k, values in (("_a", a), ("_b", b)):
                for i, x in enumerate(names):
                    batch = batch.set_column(batch.schema.get_field_index(f"{k}_{x}"), f"{k}_{x}", pa.array(np.ascontiguousarray(values[:, i])))
            yield batch

    return composed


def _starts(names: list[str], key: str):
    """The ranges of a series (a row each), to what each starts from."""

    def starts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        out = {key: rows[key], "part": rows["part"]}
        for x in names:
            known = rows[f"_s_{x}"].dropna()
            state, states = float(known.iloc[0]) if len(known) else 0.0, []
            for a, b in zip(rows[f"_a_{x}"], rows[f"_b_{x}"]):
                states.append(state)
                state = a * state + b
            out[f"_y_{x}"] = states
        return pd.DataFrame(out)

    return starts


def scanned(rows: DataFrame, key: str, order: list[str], maps: Maps) -> DataFrame:
    """``rows`` with a column for each recurrence along ``order``, which must break the ties of a key's rows; and ``part`` and ``place``.

    Rows that have ``part`` and ``place`` of a scan before keep their ranges and
    aren't sorted into others. A map's null parts are the identity's: such a row carries on what was there before.
    """
    names, new = list(maps), "place" not in rows.columns
    columns = [*rows.columns, *(("part", "place") if new else ())]
    for x, (a, b, start) in maps.items():
        a, b = (F.coalesce(v.cast("double"), F.lit(w)) for v, w in ((a, 1.0), (b, 0.0)))
        rows = rows.withColumns({f"_a_{x}": a, f"_b_{x}": b, f"_s_{x}": (F.lit(0.0) if start is None else start.cast("double"))})
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order) if new else rows.repartition("part").sortWithinPartitions("part", "place")
    schema = StructType([*dealt.schema.fields, *((StructField("part", LongType()), StructField("place", LongType())) if new else ())])
    rows = written(dealt.mapInArrow(_composed(names, key, new), schema))
    ends = [e for x in names for e in (F.max_by(f"_a_{x}", "place").alias(f"_a_{x}"), F.max_by(f"_b_{x}", "place").alias(f"_b_{x}"), F.min_by(f"_s_{x}", F.when(F.col(f"_s_{x}").isNotNull(), F.col("place"))).alias(f"_s_{x}"))]
    kind = rows.schema[key].dataType.simpleString()
    starts = rows.groupBy(key, "part").agg(*ends).groupBy(key).applyInPandas(_starts(names, key), f"`{key}` {kind}, part long, " + ", ".join(f"`_y_{x}` double" for x in names))
    starts = starts.withColumnsRenamed({key: "_key", "part": "_part"})
    joined = rows.join(starts, (F.col("part") == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.select(*columns, *[(F.col(f"_a_{x}") * F.col(f"_y_{x}") + F.col(f"_b_{x}")).alias(x) for x in names])


def scan(rows: DataFrame, key: str, order: list[str], maps: Maps) -> DataFrame:
    """``rows`` with a column for each recurrence along ``order``."""
    return scanned(rows, key, order, maps).drop("place", "part")
