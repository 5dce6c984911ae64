"""Sources and sinks: what is written is read back and held against the tables it came from."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions import fixed_values
from tidegauge.shared import shared_dir
from tidegauge.sources import files
from tidegauge.sources.adapters import BARS, bars, table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


@query(f"with {BARS} select symbol, round(avg(close), 4) as mean_close, count(*) as n from bars where symbol in ('1-URGENT', '2-HIGH') group by symbol")
def csv_scan(spark, sf_dir):
    """Bars through CSV: declared schema, two of the columns, an early filter."""
    path = shared_dir(spark)
    bars(spark, sf_dir).write.option("header", True).csv(path)
    rows = files.read_csv(spark, path, "symbol string, date date, open double, high double, low double, close double, volume long", ["symbol", "close"], F.col("symbol").isin("1-URGENT", "2-HIGH"))
    return rows.groupBy("symbol").agg(F.round(F.avg("close"), 4).alias("mean_close"), F.count("*").alias("n"))


@query("select doc_id::varchar as doc_id, coalesce(quality::varchar, '') as quality, case when doc_id % 2 = 0 then '' else toxic::varchar end as toxic from labels")
def csv_strings(spark, sf_dir):
    path = shared_dir(spark)
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", F.when(F.col("doc_id") % 2 != 0, F.col("toxic")).alias("toxic"))
    rows.where("doc_id < 100").write.option("header", True).csv(path)
    rows.where("doc_id >= 100").write.mode("append").option("header", True).csv(path)
    return files.read_text_csv(spark, path, ["doc_id", "quality", "toxic"])


@query("select event_id, user_id, value from events where event_id % 5 <> 0")
def jsonl_scan(spark, sf_dir):
    """JSON lines of which every fifth is broken and some are blank."""
    path = shared_dir(spark)
    e = table(spark, sf_dir, "events")
    good = F.to_json(F.struct("event_id", "user_id", "value"))
    e.select(F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 5 == 0, F.concat(F.lit("{broken "), good)).otherwise(good).alias("value")).write.text(path)
    return files.read_json_lines(spark, path, "event_id long, user_id long, value double")


@query("""with u as (select page_id % 3 as file, row_number() over (partition by page_id % 3 order by page_id) - 1 as line, regexp_replace(url, '[?#].*$', '') as url from pages)
  select cast(arg_min(file, (file, line)) as integer) as file, cast(arg_min(line, (file, line)) as integer) as line, url from u group by url""")
def url_lists(spark, sf_dir):
    """All lines of URL lists, written a URL a line in sorted files of ranges and read back; each URL once."""
    path = shared_dir(spark)
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"), (F.col("page_id") % 3).alias("file"))
    rows.repartitionByRange("file", "page_id").sortWithinPartitions("file", "page_id").select("file", "url").write.partitionBy("file").text(path)
    return files.read_url_lists(spark, f"{path}/file=*", list_of=r"file=(\d+)").select(F.col("file").cast("int").alias("file"), "line", "url")


_SITEMAP = "<urlset><url><loc>https://a.example/x-1.html</loc></url><url><loc> https://a.example/y?a=1&amp;b=2 </loc></url><url><loc>https://a.example/z-3.html</loc></url></urlset>"


@query("select * from (values ('https://a.example/x-1.html'), ('https://a.example/z-3.html')) v(url)")
def sitemap(spark, sf_dir):
    rows = spark.createDataFrame([(_SITEMAP,)], "xml string")
    return rows.select(F.explode(files.sitemap_locations(F.col("xml"))).alias("url")).where(F.col("url").endswith(".html"))


_MONTHS = "1995-03", "1997-11"


@query(f"select strftime(o_orderdate, '%Y-%m') as month, 'https://a.example/' || o_orderkey || '.html' as url from orders where o_orderkey % 3 <> 0 and strftime(o_orderdate, '%Y-%m') between '{_MONTHS[0]}' and '{_MONTHS[1]}'")
def monthly_sitemaps(spark, sf_dir):
    """Pages of the monthly sitemaps of some months, out of an index of all months; other addresses don't count."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-M").alias("m"))
    located = lambda place: F.concat(F.lit("<loc>\n"), place, F.lit(" </loc>"))
    names = o.select("m").distinct().select(located(F.concat(F.lit("https://a.example/news-"), "m", F.lit(".xml"))).alias("x"))
    index = names.agg(F.concat_ws("", F.collect_list("x"), F.lit("<loc>https://a.example/about.xml</loc>")).alias("xml"))  # a place per month
    place = F.concat(F.lit("https://a.example/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 != 0, ".html").otherwise(".xml"))
    # a month has many sitemaps, each of keys of one thousand
    maps = o.groupBy("m", F.floor(F.col("o_orderkey") / 1000)).agg(F.concat_ws("", F.collect_list(located(place))).alias("xml")).withColumn("location", F.concat(F.lit("https://a.example/news-"), "m", F.lit(".xml")))
    wanted = index.select(F.explode(files.months_between(F.col("xml"), *_MONTHS)).alias("x")).select("x.*")
    return maps.join(wanted, "location").select("month", F.explode(files.sitemap_locations(F.col("xml"))).alias("url")).where(F.col("url").endswith(".html"))


@query("select r_name as name, cast(row_number() over (partition by r_name order by n_name) - 1 as integer) as place, n_name as term from nation join region on n_regionkey = r_regionkey")
def term_lists(spark, sf_dir):
    """Dictionaries in files, a section of terms per region, read back with the terms' places."""
    path = shared_dir(spark)
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    terms = F.array_join(F.transform(F.array_sort(F.collect_list("n_name")), lambda t: F.concat(F.lit('  - "'), t, F.lit('"'))), "\n")
    named.groupBy("r_name").agg(terms.alias("t")).select(F.concat("r_name", F.lit(":  # terms\n"), "t", F.lit("\n"))).write.text(path)
    return files.read_term_lists(spark, path)


_ANSWERS = ('[{"TradingDate": "2026-01-05", "IndexValue": 1.5}]', '{"data": [{"TradingDate": "2026-01-06", "IndexValue": 2.5}, {"IndexValue": 9}]}', '{"items": [{"TradingDate": "2026-01-07T00:00:00"}]}', '{"other": 1}')


@query("select * from (values (date '2026-01-05', 1.5::double), (date '2026-01-06', 2.5), (date '2026-01-07', null)) v(trading_date, index_value)")
def json_envelopes(spark, sf_dir):
    """Answers in three envelopes; fields renamed, absent ones null, rows without a date dropped."""
    rows = spark.createDataFrame([(a,) for a in _ANSWERS], "body string")
    found = rows.select(F.explode(files.unwrapped(F.col("body"), "struct<TradingDate: string, IndexValue: double>")).alias("r"))
    return found.select(F.substring("r.TradingDate", 1, 10).try_cast("date").alias("trading_date"), F.col("r.IndexValue").alias("index_value")).where("trading_date is not null")


@query("select 'region' as name, count(*) as n from region union all select 'nation', count(*) from nation union all select 'customer', count(*) from customer union all select 'orders', count(*) from orders")
def reloaded_tables(spark, sf_dir):
    """Four tables reloaded in the order of their references."""
    t = lambda name: table(spark, sf_dir, name)
    found = files.reload_tables({
        "orders": (t("orders"), {"o_custkey": ("customer", "c_custkey")}), "customer": (t("customer"), {"c_nationkey": ("nation", "n_nationkey")}),
        "nation": (t("nation"), {"n_regionkey": ("region", "r_regionkey")}), "region": (t("region"), {}),
    }, shared_dir(spark))
    parts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# Fields of an index row after its group and date, as answers name them and as they are stored.
INDEX_FIELDS = (
    ("IndexValue", "index_value"), ("IndexChange", "index_change"), ("PercentIndexChange", "percent_index_change"), ("ReferenceIndex", "reference_index"), ("OpenIndex", "open_index"), ("CloseIndex", "close_index"),
    ("HighestIndex", "highest_index"), ("LowestIndex", "lowest_index"), ("TotalMatchVolume", "total_match_volume"), ("TotalMatchValue", "total_match_value"), ("TotalDealVolume", "total_deal_volume"), ("TotalDealValue", "total_deal_value"),
    ("TotalVolume", "total_volume"), ("TotalValue", "total_value"), ("TotalStockUpPrice", "total_stock_up_price"), ("TotalStockDownPrice", "total_stock_down_price"), ("TotalStockNoChangePrice", "total_stock_no_change"),
    ("ForeignBuyValueTotal", "foreign_buy_value_total"), ("ForeignBuyVolumeTotal", "foreign_buy_volume_total"), ("ForeignSellValueTotal", "foreign_sell_value_total"), ("ForeignSellVolumeTotal", "foreign_sell_volume_total"),
)
INDEX_CODE = "VNINDEX"


@query(f"select case when o_orderkey % 7 = 0 then '{INDEX_CODE}' else 'G' || o_orderkey % 7 end as com_group_code, cast(o_orderdate as date) as trading_date, " + ", ".join(f"case when (o_orderkey + {k}) % 4 > 0 then o_orderkey * 2.0::double + {k} end as {stored}" for k, (_, stored) in enumerate(INDEX_FIELDS)) + " from orders where o_orderkey % 11 > 0")
def index_rows(spark, sf_dir):
    """Index rows out of answers in three envelopes: 23 fields, absent ones null, a default group, rows without date left out."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    value = lambda i: F.when((k + i) % 4 > 0, k * 2.0 + i)
    row = F.to_json(F.struct(F.when(k % 11 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("TradingDate"), F.when(k % 7 > 0, F.concat(F.lit("G"), (k % 7).cast("string"))).alias("ComGroupCode"), *[value(i).alias(name) for i, (name, _) in enumerate(INDEX_FIELDS)]))
    listed = o.groupBy(F.floor(k / 40).alias("answer")).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list(row)), F.lit("]")).alias("rows"))
    kind = F.col("answer") % 5  # a third of each envelope, and answers that hold no rows or aren't JSON
    body = F.when(kind == 0, F.col("rows")).when(kind < 3, F.concat(F.lit('{"ok": true, "data": '), "rows", F.lit("}"))).otherwise(F.concat(F.lit('{"items": '), "rows", F.lit(', "n": 1}')))
    bodies = listed.select(body.alias("body")).unionByName(listed.limit(1).select(F.explode(F.array(F.lit('{"other": 1}'), F.lit("not json"), F.lit("7"))).alias("body")))
    found = bodies.select(F.explode(files.variants(F.col("body"))).alias("v"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    rows = found.select(F.coalesce(F.nullif(get("ComGroupCode", "string"), F.lit("")), F.lit(INDEX_CODE)).alias("com_group_code"), F.substring(get("TradingDate", "string"), 1, 10).try_cast("date").alias("trading_date"), *[get(name, "double").alias(stored) for name, stored in INDEX_FIELDS])
    return rows.where("trading_date is not null")


@query("select symbol, from_date::date as from_date, to_date::date as to_date, to_date is null as active from (values " + ", ".join(f"('{s}', '{a}', {f'{b!r}' if b else 'null'})" for s, a, b in fixed_values.MEMBERSHIP) + ") v(symbol, from_date, to_date)")
def index_membership(spark, sf_dir):
    """The built-in membership as a relation."""
    rows = spark.createDataFrame(list(fixed_values.MEMBERSHIP), "symbol string, from_date string, to_date string")
    return rows.select("symbol", F.to_date("from_date").alias("from_date"), F.to_date("to_date").alias("to_date"), F.col("to_date").isNull().alias("active"))


@query("select user_id as run_id, arg_max(event_type, (ts, event_id)) as status, min(ts) as started_at, max(ts) as finished_at, count(*) as entries from events group by 1")
def run_log(spark, sf_dir):
    """The latest state of each run out of an append-only log."""
    path = shared_dir(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), "ts", "event_id")
    files.append_table(e.where("event_id % 2 = 0"), path)
    log = files.append_table(e.where("event_id % 2 = 1"), path)
    return log.groupBy("run_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count("*").alias("entries"))


@query("select r_regionkey, r_name, 'second' as run from region where r_regionkey > 1")
def replaced_table(spark, sf_dir):
    """A table that is written twice, the second time in place of the first."""
    path, rows = shared_dir(spark), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    files.replace_table(rows.withColumn("run", F.lit("first")), path)
    return files.replace_table(rows.where("r_regionkey > 1").withColumn("run", F.lit("second")), path)


@query(f"with {BARS} select 'all' as scope, count(*) as n, round(avg(close), 4) as mean_close, round(stddev_samp(close), 4) as std_close from bars")
def json_document(spark, sf_dir):
    """A nested result written as one JSON document and read back as a flat row."""
    path = shared_dir(spark)
    b = bars(spark, sf_dir).agg(F.lit("all").alias("scope"), F.struct(F.count("*").alias("n"), F.struct(F.round(F.avg("close"), 4).alias("mean"), F.round(F.stddev_samp("close"), 4).alias("std")).alias("close")).alias("observed"))
    b.write.json(path)
    return spark.read.schema(b.schema).json(path).select("scope", "observed.n", F.col("observed.close.mean").alias("mean_close"), F.col("observed.close.std").alias("std_close"))


@query("select event_id, case when event_id % 4 = 0 then null when event_id % 4 = 1 then null when event_id % 4 = 2 then null else value end as value from events")
def finite_values(spark, sf_dir):
    """Numbers that aren't finite become null where they are stored."""
    k = F.col("event_id") % 4
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", files.finite(v).alias("value"))


@query(None)
def saved_model(spark, sf_dir):
    """A fitted model that is saved, loaded and applied: largest difference of its predictions."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import LinearRegression

    from tidegauge.plans.models import HAR, _fit, _parts

    model, before = _fit(spark, sf_dir, HAR, LinearRegression(featuresCol="features", labelCol="rv5_fwd", solver="normal"))
    path = shared_dir(spark)
    model.save(path)
    after = PipelineModel.load(path).transform(_parts(spark, sf_dir, HAR)[1]).select("symbol", "date", F.col("prediction").alias("again"))
    return before.join(after, ["symbol", "date"]).agg(F.max(F.abs(F.col("prediction") - F.col("again"))).alias("largest_difference"), F.count("*").alias("n"))


@query("select * from (values ('nation_view', true), ('region_view', true)) v(name, is_temporary)")
def catalog_tables(spark, sf_dir):
    """Tables that the catalog knows."""
    for name in ("nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"{name}_view")
    return spark.createDataFrame([(t.name, t.isTemporary) for t in spark.catalog.listTables() if t.name in ("nation_view", "region_view")], "name string, is_temporary boolean")


@query(f"with {BARS}, r as (select symbol, date, close / nullif(lag(close) over (partition by symbol order by date), 0) - 1 as ret from bars) select symbol, cast(least(floor((greatest(least(ret, 5), -1) + 1) / 0.05), 119) as integer) as bin, count(*) as n from r where ret is not null group by 1, 2")
def chart_data(spark, sf_dir):
    """The data behind a chart: clipped returns in 120 bins per symbol."""
    w = Window.partitionBy("symbol").orderBy("date")
    r = bars(spark, sf_dir).select("symbol", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("ret")).where("ret is not null")
    place = F.least(F.floor((F.greatest(F.least("ret", F.lit(5.0)), F.lit(-1.0)) + 1) / 0.05), F.lit(119)).cast("int")
    return r.groupBy("symbol", place.alias("bin")).agg(F.count("*").alias("n"))
