"""Keyed merges of tables: upsert with the latest row winning, insert of new keys only, and resume by a done-set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must break all ties."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """``stored`` with the rows of ``batch`` in place of those with equal keys; of equal keys in a batch the greatest ``tie`` wins."""
    both = stored.withColumn("_fresh", F.lit(0)).unionByName(batch.withColumn("_fresh", F.lit(1)))
    return latest_per_key(both, keys, [F.desc("_fresh"), *[F.desc(c) for c in tie]]).drop("_fresh")


def upsert_counted(stored: DataFrame, batch: DataFrame, keys: list[str], tie: list[str], valid: Column) -> tuple[DataFrame, DataFrame]:
    """``upsert`` of the rows that are ``valid`` and have a key, and one row (written, failed) that counts the batch's rows."""
    ok = F.coalesce(valid, F.lit(False))
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return upsert(stored, batch.where(ok), keys, tie), batch.agg(F.count_if(ok).alias("written"), F.count_if(~ok).alias("failed"))


def updated(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``stored`` with the values of ``changes`` (key and some columns, a row per key) where a key matches; null changes nothing."""
    columns = [c for c in changes.columns if c != key]
    both = stored.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key, "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns])


def insert_new(stored: DataFrame, batch: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """``stored`` and the rows of ``batch`` whose keys it lacks, each once."""
    fresh = latest_per_key(batch.join(stored.select(*keys), keys, "left_anti"), keys, [F.asc(c) for c in tie])
    return stored.unionByName(fresh)


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``done``; rows without key stay."""
    return rows.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def quality_report(rows: DataFrame, unique: list[str], domains: dict[str, Column]) -> DataFrame:
    """(check, failures): rows beyond the first of each key, and rows that break a domain's predicate or leave it unknown."""
    keys = rows.groupBy(*unique).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("failures")).select(F.lit("unique " + ",".join(unique)).alias("check"), "failures")
    broken = rows.agg(F.array(*[F.struct(F.lit(name).alias("check"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failures")) for name, ok in domains.items()]).alias("c"))
    return keys.unionByName(broken.select(F.explode("c").alias("c")).select("c.*"))


def taken_pages(items: DataFrame, pages: DataFrame, key: list[str], start: Column) -> DataFrame:
    """The rows of ``items`` (key, page, ts, event_id) on the pages that a reader of each key gets to see.

    ``pages`` has the key and page of all pages, also of those without items. The
    reader ends at the second page in a row without items, and after a page whose oldest
    item is before ``start``; that page counts.
    """
    sizes = items.groupBy(*key, "page").agg(F.count("*").alias("_n"), F.min(F.struct("ts", "event_id"))["ts"].alias("_oldest"))
    along = Window.partitionBy(*key).orderBy("page")
    seen = pages.join(sizes, [*key, "page"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    ends = ((F.col("_n") == 0) & (F.coalesce(F.lag("_n").over(along), F.lit(1)) == 0)) | F.coalesce(F.col("_oldest") < start, F.lit(False))
    seen = seen.withColumn("_ends", ends.cast("int"))
    ended = F.coalesce(F.max("_ends").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.join(seen.withColumn("_ended", ended).where("_ended = 0").select(*key, "page"), [*key, "page"])
