"""Table, column and batch helpers of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.shared import shared_dir, written  # noqa: F401

#: Words of the contracts: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(column) -> F.Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*columns, seed: str) -> F.Column:
    """A hex digest that orders rows in the same way in every run and engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def crc_mod(column, n: int) -> F.Column:
    """crc32 of the value as text, modulo ``n``."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a partition sorted by ``keys`` (non-null longs), with the groups' offsets."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = _starts(batch, keys)
        if rest and _row(rest[-1], keys, -1) == _row(batch, keys, 0):
            if len(cut) == 1:
                rest.append(batch)
                continue
            head, batch = batch.slice(0, cut[1]), batch.slice(cut[1])
            rest.append(head)
            cut = cut[1:] - cut[1]
        last = int(cut[-1])
        table = pa.Table.from_batches([*rest, *([batch.slice(0, last)] if last else [])]) if rest or last else None
        if table is not None:
            yield _table(table, keys)
        rest = [batch.slice(last)]
    if rest:
        yield _table(pa.Table.from_batches(rest), keys)


def _row(batch: pa.RecordBatch, keys: list[str], at: int) -> tuple:
    at = at % batch.num_rows
    return tuple(batch.column(batch.schema.get_field_index(k))[at].as_py() for k in keys)


def _starts(batch, keys: list[str]) -> np.ndarray:
    change = np.zeros(batch.num_rows, bool)
    change[0] = True
    for k in keys:
        v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def _table(table: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = table.combine_chunks()
    return table, np.append(_starts(table, keys), table.num_rows)
