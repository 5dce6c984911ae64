"""Domain tables from the driver's tables: bars, news, membership; as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sources of news are dealt dates over so many days, and one of five symbols or the whole market.
NEWS_DAYS = 2400
FIRST_NEWS = "1995-01-01"
MARKET = "MARKET"
SYMBOLS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table (as Spark estimates them) up to which ``spread`` deals it anew.
SPREAD_BYTES = 1 << 30


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of a small table that is read in fewer splits than there are cores, dealt by ``key`` so that all cores work on its texts; others as they are.

    A file of one row group is one task however large its texts are. Inputs of
    many files, or over SPREAD_BYTES, aren't shuffled, however many cores there are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores, key) if size <= SPREAD_BYTES and rows.rdd.getNumPartitions() < cores else rows


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: a symbol per order priority, orders as ticks. One combined aggregation."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count("*").alias("volume"),
    )


BARS = """bars as (select o_orderpriority as symbol, cast(o_orderdate as date) as date, arg_min(o_totalprice, o_orderkey) as open,
  max(o_totalprice) as high, min(o_totalprice) as low, arg_max(o_totalprice, o_orderkey) as close, count(*) as volume from orders group by 1, 2)"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(news_id, source, lang, text, date, symbol, score): a document per article, a score in [-1, 1] by digest."""
    docs = table(spark, sf_dir, "documents")
    symbol = F.element_at(F.array(*[F.lit(s) for s in (*SYMBOLS, MARKET)]), (F.col("doc_id") % 6 + 1).cast("int"))
    score = F.conv(F.substring(F.md5(F.concat(F.lit("s"), F.col("doc_id").cast("string"))), 1, 4), 16, 10).cast("double") / 32767.5 - 1
    return docs.select(
        F.col("doc_id").alias("news_id"), "source", "lang", "text",
        F.date_add(F.lit(FIRST_NEWS).cast("date"), (F.col("doc_id") * 7 % NEWS_DAYS).cast("int")).alias("date"),
        symbol.alias("symbol"), F.round(score, 4).alias("score"),
    )


NEWS = """news as (select doc_id as news_id, source, lang, text, cast(date '1995-01-01' + cast(doc_id * 7 % 2400 as integer) as date) as date,
  ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', 'MARKET'][cast(doc_id % 6 + 1 as integer)] as symbol,
  round(('0x' || substr(md5('s' || cast(doc_id as varchar)), 1, 4))::integer / 32767.5 - 1, 4) as score from documents)"""


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, symbol, from_date, to_date): two intervals per symbol of the bars, the second one open for odd symbols."""
    span = bars(spark, sf_dir).groupBy("symbol").agg(F.min("date").alias("d"))
    first = span.select("symbol", "d", F.lit(1).alias("part"))
    odd = F.substring("symbol", 1, 1).cast("int") % 2 == 1
    rows = first.unionByName(span.select("symbol", "d", F.lit(2).alias("part")))
    rows = rows.withColumn("from_date", F.when(F.col("part") == 1, F.col("d")).otherwise(F.date_add("d", 600)))
    rows = rows.withColumn("to_date", F.when(F.col("part") == 1, F.date_add("d", 400)).when(~odd, F.date_add("d", 1200)))
    return rows.select((F.substring("symbol", 1, 1).cast("int") * 2 + F.col("part")).alias("id"), "symbol", "from_date", "to_date")


MEMBERSHIP = """membership as (select cast(substr(symbol, 1, 1) as integer) * 2 + part as id, symbol,
  case when part = 1 then d else cast(d + 600 as date) end as from_date,
  case when part = 1 then cast(d + 400 as date) when cast(substr(symbol, 1, 1) as integer) % 2 = 0 then cast(d + 1200 as date) end as to_date
  from (select symbol, min(date) as d from bars group by symbol), (values (1), (2)) v(part))"""
