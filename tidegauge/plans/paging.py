"""Queries over answers that are paged by a cursor, saved out of the pages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.shared import shared_dir
from tidegauge.sources import cursor
from tidegauge.sources.adapters import table
from tidegauge.streaming import incremental

QUERIES: dict[str, tuple] = {}
#: Channels of the pages, and items of an answer.
CHANNELS, ITEMS = 4, 10
#: The moment that the reader with a limit goes back to.
SINCE = "2024-01-02"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, page_id, url, moment): a page as an item; ids fall as time goes back, one an hour."""
    p = table(spark, sf_dir, "pages")
    moment = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 3600), "yyyy-MM-dd HH:mm:ss")
    return p.select(F.concat(F.lit("c"), (F.col("page_id") % CHANNELS).cast("string")).alias("channel"), "page_id", "url", moment.alias("moment"))


def save_answers(items: DataFrame, folder: str, newest_first: bool) -> None:
    """Save the items of each channel as answers of ITEMS, in order of their ids, under the cursor that asks for them.

    A name depends on what is saved alone, so that a task that is tried again writes the same files.
    """
    block = F.floor(F.col("page_id") / (CHANNELS * ITEMS))  # a block of ids holds ITEMS of each channel
    answers = items.groupBy("channel", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("page_id", "url", "moment")), asc=not newest_first).alias("items"))
    along = Window.partitionBy("channel").orderBy(F.desc("block") if newest_first else F.asc("block"))
    answers = answers.withColumn("cursor", F.coalesce(F.lag(F.element_at("items", -1)["page_id"]).over(along).cast("string"), F.lit(cursor.FIRST)))

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = cursor.fs.FileSystem.from_uri(folder)
        for rows in batches:
            for channel, at, found in zip(rows["channel"], rows["cursor"], rows["items"]):
                files.create_dir(f"{base}/{channel}")
                with files.open_output_stream(f"{base}/{channel}/{at}.json") as out:
                    out.write(json.dumps([{"Id": int(x["page_id"]), "FriendlyTitle": x["url"], "Date": x["moment"]} for x in found]).encode())
            yield pd.DataFrame({"saved": [len(rows)]})

    answers.select("channel", "cursor", "items").mapInPandas(save, "saved long").agg(F.sum("saved")).collect()


@query(f"select 'c' || page_id % {CHANNELS} as channel, page_id as id, url as title from pages")
def cursor_pages(spark, sf_dir):
    """All items of all channels, by following each channel's cursors."""
    folder = shared_dir(spark)
    save_answers(_items(spark, sf_dir), folder, newest_first=True)
    rows = cursor.registered(spark).read.format("cursor_pages").option("path", folder).load()
    return rows.select("channel", "id", "title")


@query(f"select 'c' || page_id % {CHANNELS} as channel, page_id as id, strftime(to_timestamp(1704067200 + page_id * 3600) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as moment from pages where page_id % {CHANNELS} in (1, 2) and to_timestamp(1704067200 + page_id * 3600) >= timestamptz '{SINCE} 00:00:00+00'")
def cursor_pages_since(spark, sf_dir):
    """Two channels back to a moment: the filters choose the chains and end them early."""
    folder = shared_dir(spark)
    save_answers(_items(spark, sf_dir), folder, newest_first=True)
    rows = cursor.registered(spark).read.format("cursor_pages").option("path", folder).schema("channel string, id long, moment string").load()
    return rows.where(F.col("channel").isin("c1", "c2") & (F.col("moment") >= SINCE))


@query(f"select 'c' || page_id % {CHANNELS} as channel, page_id as id, url as title from pages")
def stream_cursor_pages(spark, sf_dir):
    """The same items as a stream that is stopped half way and goes on at its cursors when more answers are saved."""
    folder, at = shared_dir(spark), shared_dir(spark)
    items = _items(spark, sf_dir)
    half = items.agg(F.floor(F.max("page_id") / 2)).first()[0] or 0
    block = CHANNELS * ITEMS
    parts = []
    for bound in (half // block * block, None):
        save_answers(items if bound is None else items.where(F.col("page_id") < bound), folder, newest_first=False)
        stream = cursor.registered(spark).readStream.format("cursor_pages").option("path", folder).load()
        out = shared_dir(spark)
        incremental.drained(stream, each=lambda rows, batch, out=out: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}"), checkpoint=at)
        parts.append(spark.read.schema(cursor.SCHEMA).option("recursiveFileLookup", True).parquet(out))
    return parts[0].unionByName(parts[1]).select("channel", "id", "title")
