"""Joins, set operations, merges, cleaning and calendar queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.operators import merge
from tidegauge.sources.adapters import BARS, MARKET, MEMBERSHIP, NEWS, bars, membership, news, table

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


_MEMBERS = f"with {BARS}, {MEMBERSHIP}"
#: Open intervals end on this day.
TODAY = "2002-01-01"


@query(f"""{_MEMBERS} select b.symbol, b.date, min(m.id) as membership_id, any_value(round(b.close, 6)) as close from bars b join membership m
  on b.symbol = m.symbol and b.date >= m.from_date and b.date <= coalesce(m.to_date, date '{TODAY}') group by 1, 2""")
def membership_join(spark, sf_dir):
    """Bars on days of membership, both ends included; overlapping intervals give a row once."""
    b, m = bars(spark, sf_dir), membership(spark, sf_dir)
    inside = (b["symbol"] == m["symbol"]) & (b["date"] >= m["from_date"]) & (b["date"] <= F.coalesce(m["to_date"], F.lit(TODAY).cast("date")))
    return b.join(m, inside).select(b["symbol"], b["date"], m["id"], b["close"]).groupBy("symbol", "date").agg(F.min("id").alias("membership_id"), F.round(F.min("close"), 6).alias("close"))


@query(f"{_MEMBERS} select id, symbol, from_date, to_date, cast(row_number() over (order by to_date is not null, symbol, from_date) as integer) as place from membership")
def membership_active_first(spark, sf_dir):
    """Open memberships first; one row per membership, so the window is small."""
    return membership(spark, sf_dir).withColumn("place", F.row_number().over(Window.orderBy(F.col("to_date").isNotNull(), "symbol", "from_date")))


@query(f"""{_MEMBERS}, cur as (select distinct symbol from bars where volume >= 3 and symbol <> '1-URGENT')
  select m.symbol, case when c.symbol is null then 'close' else 'keep' end as action from membership m left join cur c using (symbol) where m.to_date is null
  union all select symbol, 'open' as action from (select symbol from cur except select symbol from membership where to_date is null)""")
def membership_diff(spark, sf_dir):
    """Cross-check of open memberships against a current list: close, keep or open."""
    current = bars(spark, sf_dir).where("volume >= 3 and symbol <> '1-URGENT'").select("symbol").distinct()
    held = membership(spark, sf_dir).where("to_date is null").select("symbol")
    kept = held.join(current.withColumn("_c", F.lit(1)), "symbol", "left").select("symbol", F.when(F.col("_c").isNull(), "close").otherwise("keep").alias("action"))
    return kept.unionByName(current.subtract(held).withColumn("action", F.lit("open")))


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R' and l_orderkey is not null)")
def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.not_done(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000) group by 1")
def valid_semi(spark, sf_dir):
    valid = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(valid, "o_custkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"with {BARS} select symbol, date, volume from bars b where exists (select 1 from (select o_orderpriority as symbol, cast(o_orderdate as date) as date from orders where o_totalprice > 300000) k where k.symbol = b.symbol and k.date = b.date)")
def composite_semi(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).distinct()
    return bars(spark, sf_dir).join(keys, ["symbol", "date"], "left_semi").select("symbol", "date", "volume")


@query("""select 'lineitem.l_orderkey' as reference, count(*) as orphans from lineitem where l_orderkey not in (select o_orderkey from orders)
  union all select 'orders.o_custkey', count(*) from orders where o_custkey not in (select c_custkey from customer)
  union all select 'labels.doc_id', count(*) from labels where doc_id not in (select doc_id from documents)""")
def fk_check(spark, sf_dir):
    parts = []
    for child, key, parent, other in (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id")):
        rows = table(spark, sf_dir, child).select(F.col(key).alias("k")).where("k is not null")
        parts.append(rows.join(table(spark, sf_dir, parent).select(F.col(other).alias("k")), "k", "left_anti").agg(F.lit(f"{child}.{key}").alias("reference"), F.count("*").alias("orphans")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _quotes(spark, sf_dir):
    """Stored quotes, and a batch that repeats keys and brings new ones."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0")


@query("""select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by (event_id % 3 <> 0) desc, event_id desc) as rn from events) where rn = 1""")
def upsert_latest_wins(spark, sf_dir):
    stored, batch = _quotes(spark, sf_dir)
    return merge.upsert(stored, batch, ["user_id", "event_type"], ["event_id"])


@query("select count(*) filter (where value >= 5 and event_id % 7 <> 0) as written, count(*) filter (where value < 5 or event_id % 7 = 0) as failed from events where event_id % 3 <> 0")
def upsert_counts(spark, sf_dir):
    """Rows of a batch that an upsert wrote, and those that it left out: a value below 5, or no key."""
    stored, batch = _quotes(spark, sf_dir)
    batch = batch.withColumn("user_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")))
    return merge.upsert_counted(stored, batch, ["user_id", "event_type"], ["event_id"], F.col("value") >= 5)[1]


@query("""with d as (select user_id, max(ts) as finished_at from events where event_type = 'purchase' group by 1)
  select r.run_id, case when d.user_id is null then 'running' else 'done' end as status, started_at, d.finished_at from (select user_id as run_id, min(ts) as started_at from events group by 1) r left join d on d.user_id = r.run_id""")
def run_log_updates(spark, sf_dir):
    """A log of runs, of which those that ended are updated by id."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "run_id")
    log = e.groupBy("run_id").agg(F.lit("running").alias("status"), F.min("ts").alias("started_at")).withColumn("finished_at", F.lit(None).cast(e.schema["ts"].dataType))
    ended = e.where("event_type = 'purchase'").groupBy("run_id").agg(F.lit("done").alias("status"), F.max("ts").alias("finished_at"))
    return merge.updated(log, ended, "run_id")


@query("""with s as (select user_id, event_type, event_id, value from events where event_id % 3 = 0 and value > 20), b as (select * from events where event_id % 3 <> 0)
  select * from s union all select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id) as rn from b
  where not exists (select 1 from s where s.user_id = b.user_id and s.event_type = b.event_type)) where rn = 1""")
def insert_skip_dup(spark, sf_dir):
    stored, batch = _quotes(spark, sf_dir)
    return merge.insert_new(stored.where("value > 20"), batch, ["user_id", "event_type"], ["event_id"])


@query("""select user_id, arg_min(event_id, (ts, event_id)) as event_id, min(ts) as ts from events group by user_id""")
def dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return merge.latest_per_key(rows, ["user_id"], [F.asc("ts"), F.asc("event_id")])


@query("select event_type, user_id from (select distinct event_type, user_id from events)")
def dedup_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", "user_id").distinct()


@query("select url_path, min(page_id) as first_page from (select page_id, regexp_replace(url, '[?#].*$', '') as url_path from pages) group by 1")
def ordered_dedup(spark, sf_dir):
    """Distinct URLs in the order in which they were first seen."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url_path"))
    return rows.groupBy("url_path").agg(F.min("page_id").alias("first_page")).orderBy("first_page")


@query(f"""with {NEWS}, d as (select news_id, case when news_id % 11 = 0 then null else date end as published, news_id in (select doc_id from labels) as done from news)
  select news_id, case when done then 'duplicate' when published is null then 'no_date' when published < date '1996-01-01' then 'too_old' when published > date '2000-12-31' then 'too_new' else 'ok' end as reason,
  published is null or (published >= date '1996-01-01' and published <= date '2000-12-31') as in_range from d""")
def date_range_reason(spark, sf_dir):
    """Why an article is taken or not, first reason first; a missing date passes the range."""
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("news_id")).distinct().withColumn("_done", F.lit(True))
    d = F.col("published")
    rows = news(spark, sf_dir).select("news_id", F.when(F.col("news_id") % 11 != 0, F.col("date")).alias("published")).join(done, "news_id", "left")
    reason = F.when(F.col("_done"), "duplicate").when(d.isNull(), "no_date").when(d < "1996-01-01", "too_old").when(d > "2000-12-31", "too_new").otherwise("ok")
    return rows.select("news_id", reason.alias("reason"), (d.isNull() | d.between("1996-01-01", "2000-12-31")).alias("in_range"))


@query(f"""with {BARS}, ind as (select symbol, date, close / nullif(lag(close) over (partition by symbol order by date), 0) - 1 as daily_return from bars),
  cp as (select symbol, date, case when daily_return > 0 then 1 else -1 end as direction from ind where abs(daily_return) > 3)
  select b.symbol, b.date, b.close, round(i.daily_return, 6) as daily_return, cast(c.direction as integer) as cp_direction from bars b left join ind i using (symbol, date) left join cp c using (symbol, date) where b.date >= date '1996-01-01'""")
def three_way_left(spark, sf_dir):
    """Prices with indicators and change markers. The filter on the date stays above the window."""
    b = bars(spark, sf_dir)
    w = Window.partitionBy("symbol").orderBy("date")
    ind = b.select("symbol", "date", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("daily_return"))
    cp = ind.where("abs(daily_return) > 3").select("symbol", "date", F.when(F.col("daily_return") > 0, 1).otherwise(-1).alias("cp_direction"))
    joined = b.select("symbol", "date", "close").join(ind, ["symbol", "date"], "left").join(cp, ["symbol", "date"], "left")
    return joined.where("date >= '1996-01-01'").select("symbol", "date", "close", F.round("daily_return", 6).alias("daily_return"), "cp_direction")


@query(f"""with {NEWS} select n.news_id, coalesce(n.lang, '') as lang, coalesce(cast(l.quality as varchar), '') as quality, n.symbol = '{MARKET}' as is_market from news n left join labels l on l.doc_id = n.news_id""")
def left_join_defaults(spark, sf_dir):
    """Left join on keys of different names; nulls become empty strings."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("news_id"), F.col("quality").cast("string").alias("quality"))
    rows = news(spark, sf_dir).select("news_id", "lang", "symbol").join(labels, "news_id", "left").na.fill("", ["lang", "quality"])
    return rows.select("news_id", "lang", "quality", (F.col("symbol") == MARKET).alias("is_market"))


@query(f"""with {BARS} select symbol from (select distinct symbol from bars where volume >= 9 except select distinct symbol from bars where volume >= 11) union select '{MARKET}'""")
def set_operations(spark, sf_dir):
    b = bars(spark, sf_dir)
    known = b.where("volume >= 9").select("symbol").subtract(b.where("volume >= 11").select("symbol"))
    return known.union(spark.createDataFrame([(MARKET,)], "symbol string")).distinct()


@query(f"""with {BARS} select date, cast(year(date) as integer) as year, cast(quarter(date) as integer) as quarter, cast(month(date) as integer) as month, cast(day(date) as integer) as day, cast(isodow(date) as integer) as day_of_week, isodow(date) >= 6 as is_weekend
  from (select cast(unnest(range(min(date), max(date) + interval 1 day, interval 1 day)) as date) as date from bars)""")
def dim_time(spark, sf_dir):
    """A row per day between the first and the last bar."""
    span = bars(spark, sf_dir).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    dow = F.weekday("date") + 1
    return days.select("date", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"), dow.alias("day_of_week"), (dow >= 6).alias("is_weekend"))


@query("""select o_orderkey, try_cast(case when o_orderkey % 7 = 0 then 'n/a' else cast(o_totalprice as varchar) end as double) as price, try_cast(case when o_orderkey % 5 = 0 then 'bad' else strftime(o_orderdate, '%Y-%m-%d') end as date) as day
  from orders where try_cast(case when o_orderkey % 7 = 0 then 'n/a' else cast(o_totalprice as varchar) end as double) > 0 and try_cast(case when o_orderkey % 5 = 0 then 'bad' else strftime(o_orderdate, '%Y-%m-%d') end as date) is not null""")
def coercing_cast(spark, sf_dir):
    """Texts that aren't numbers or dates become null, and rows without both go."""
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("p"), F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    rows = raw.select("o_orderkey", F.col("p").try_cast("double").alias("price"), F.col("d").try_cast("date").alias("day"))
    return rows.where((F.col("price") > 0) & F.col("day").isNotNull())


@query("""select 'unique l_orderkey,l_linenumber' as "check", cast(count(*) - count(distinct (l_orderkey, l_linenumber)) as bigint) as failures from lineitem
  union all select 'quantity positive', count(*) filter (where not coalesce(l_quantity > 0, false)) from lineitem
  union all select 'flag known', count(*) filter (where not coalesce(l_returnflag in ('A', 'N', 'R'), false)) from lineitem""")
def data_quality(spark, sf_dir):
    return merge.quality_report(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], {"quantity positive": F.col("l_quantity") > 0, "flag known": F.col("l_returnflag").isin("A", "N", "R")})


@query("select s_suppkey, coalesce(case when s_acctbal > 0 then s_acctbal end, 0) - coalesce(case when s_acctbal < 0 then -s_acctbal end, 0) as net_value from supplier")
def generated_column(spark, sf_dir):
    balance = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select("s_suppkey", (F.coalesce(F.when(balance > 0, balance), F.lit(0.0)) - F.coalesce(F.when(balance < 0, -balance), F.lit(0.0))).alias("net_value"))


@query("select n_nationkey, n_name, cast(row_number() over (order by n_regionkey, n_name) as integer) as id from nation")
def surrogate_ids(spark, sf_dir):
    """Ids by position in a dimension; fact tables get hashes of their keys instead."""
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.row_number().over(Window.orderBy("n_regionkey", "n_name")).alias("id"))


@query("""select user_id, sum(case when stop = 0 then 1 else 0 end)::bigint as taken, count(*) as seen from (select user_id, max(case when value < 0.5 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as stop from events) group by 1""")
def take_until_stop(spark, sf_dir):
    """Rows of each series before the first one that asks to stop."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "events").select("user_id", F.max((F.col("value") < 0.5).cast("int")).over(w).alias("stop"))
    return rows.groupBy("user_id").agg(F.count_if(F.col("stop") == 0).alias("taken"), F.count("*").alias("seen"))


#: Events of a page, and the moment at which a reader has gone back far enough.
PAGE, START = 5, "2024-01-04 00:00:00"


@query(f"""with e as (select user_id, event_id, ts, (row_number() over (partition by user_id order by ts desc, event_id desc) - 1) // {PAGE} as page, event_id % 4 > 0 as listed from events),
  p as (select user_id, page, count(*) filter (where listed) as urls, arg_min(ts, (ts, event_id)) filter (where listed) as oldest from e group by 1, 2),
  f as (select *, case when urls = 0 and lag(urls) over w = 0 then 1 when oldest < timestamp '{START}' then 1 else 0 end as ends from p window w as (partition by user_id order by page)),
  t as (select user_id, page from (select *, coalesce(sum(ends) over (partition by user_id order by page rows between unbounded preceding and 1 preceding), 0) as ended from f) where ended = 0)
  select user_id, event_id, cast(page as integer) as page from e join t using (user_id, page) where listed and event_id % 10 <> 0""")
def sequential_pages(spark, sf_dir):
    """What a reader takes who goes back page by page: up to the second empty page in a row, or with the page whose last item is too old; without what is known already."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.floor((F.row_number().over(w) - 1) / PAGE).cast("int").alias("page"), (F.col("event_id") % 4 > 0).alias("listed"))
    known = table(spark, sf_dir, "events").where("event_id % 10 = 0").select("event_id")
    return merge.taken_pages(e.where("listed"), e.select("user_id", "page").distinct(), ["user_id"], F.lit(START).cast("timestamp_ntz")).join(known, "event_id", "left_anti").select("user_id", "event_id", "page")


@query("select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as quantity from lineitem where ($1 is null) or true group by 1, 2".replace("where ($1 is null) or true ", ""))
def optional_predicate(spark, sf_dir):
    """A parameterised query whose filter vanishes when its parameter is null."""
    return spark.sql(
        "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as quantity from {lineitem} where :flag is null or l_returnflag = :flag group by 1, 2",
        args={"flag": None}, lineitem=table(spark, sf_dir, "lineitem"))


@query("""select event_id, case when value >= 30 then 'high' when value >= 10 then 'mid' else 'low' end as level, case when event_id % 4 = 0 then 0 else value end as corrected from events where ts >= (select max(ts) from events) - interval 7 day""")
def relative_cutoff_update(spark, sf_dir):
    """Rows of the last seven days, counted from the newest; cells that match a mask are replaced."""
    e = table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    rows = e.join(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr("interval 7 days"))
    return rows.select("event_id", F.when(F.col("value") >= 30, "high").when(F.col("value") >= 10, "mid").otherwise("low").alias("level"), F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value")).alias("corrected"))


@query("""select conv_id, count(*) as turns, string_agg(role || ': ' || text, ' | ' order by turn) as context from conversations group by conv_id""")
def context_text(spark, sf_dir):
    """The turns of each conversation in order, as one text."""
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(turns, lambda x: x["t"]), " | ").alias("context"))
