"""Exploratory aggregations over bars, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.windows import change
from tidegauge.operators import quantiles
from tidegauge.sources.adapters import BARS, SYMBOLS, bars, table

QUERIES: dict[str, tuple] = {}


def over_bars(sql: str):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(bars(spark, sf_dir))

        QUERIES[f.__name__] = (run, f"with {BARS} {sql}")
        return f

    return register


def r6(column, name: str):
    return F.round(column, 6).alias(name)


_NUMBERS = ("open", "high", "low", "close", "volume")
_RETURNS = "(select *, close / nullif(lag(close) over (partition by symbol order by date), 0) - 1 as ret from bars)"


@over_bars(" union all ".join(
    f"select '{c}' as name, count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(min({c})::double, 4) as least, round(quantile_cont({c}, 0.25)::double, 4) as p25, "
    f"round(quantile_cont({c}, 0.5)::double, 4) as p50, round(quantile_cont({c}, 0.75)::double, 4) as p75, round(max({c})::double, 4) as most from bars" for c in _NUMBERS))
def eda_describe(b):
    """Count, mean, deviation and exact quantiles of every numeric column, in one pass."""
    figures = F.array(*[F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(F.col(c).cast("double")).alias("least"),
                                 F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"), F.max(F.col(c).cast("double")).alias("most")) for c in _NUMBERS])
    rows = b.agg(figures.alias("f")).select(F.explode("f").alias("f")).select("f.*")
    return rows.select("name", "n", "mean", "std", F.round("least", 4).alias("least"), *[F.round(F.col("p")[i], 4).alias(f"p{q}") for i, q in enumerate((25, 50, 75))], F.round("most", 4).alias("most"))


_NULLABLE = "(select *, close / nullif(lag(close) over w, 0) - 1 as daily_return, case when count(close) over w20 = 20 then avg(close) over w20 end as ma_20 from bars window w as (partition by symbol order by date), w20 as (partition by symbol order by date rows 19 preceding))"


@over_bars(" union all ".join(f"select '{c}' as name, count(*) - count({c}) as nulls, round(100 * avg(case when {c} is null then 1.0::double else 0 end), 2) as null_pct from {_NULLABLE}" for c in ("close", "daily_return", "ma_20")))
def null_report(b):
    w = Window.partitionBy("symbol").orderBy("date")
    b = b.withColumn("daily_return", change(F.col("close"))).withColumn("ma_20", F.when(F.count("close").over(w.rowsBetween(-19, 0)) == 20, F.avg("close").over(w.rowsBetween(-19, 0))))
    names = ("close", "daily_return", "ma_20")
    one = b.agg(F.array(*[F.struct(F.lit(c).alias("name"), F.count_if(F.col(c).isNull()).alias("nulls"), F.round(100 * F.avg(F.col(c).isNull().cast("double")), 2).alias("null_pct")) for c in names]).alias("f"))
    return one.select(F.explode("f").alias("f")).select("f.*")


@over_bars("select count(distinct date) as dates, count(distinct symbol) as symbols, array_to_string(list_sort(list(distinct symbol)), ',') as names from bars")
def distinct_counts(b):
    return b.agg(F.count_distinct("date").alias("dates"), F.count_distinct("symbol").alias("symbols"), F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("names"))


@over_bars("select symbol, count(*) as n from bars group by symbol")
def rows_per_symbol(b):
    return b.groupBy("symbol").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol")


@over_bars("select symbol, max(date) as last_date, arg_max(close, date) as last_close from bars group by symbol having max(date) = (select max(date) from bars)")
def current_members(b):
    last = b.groupBy("symbol").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"))
    return last.withColumn("_m", F.max("last_date").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("last_date = _m").drop("_m")


@over_bars("select symbol, round(avg(volume), 6) as mean_volume from bars group by symbol order by mean_volume desc, symbol limit 3")
def top_volume(b):
    return b.groupBy("symbol").agg(F.round(F.avg("volume"), 6).alias("mean_volume")).orderBy(F.desc("mean_volume"), "symbol").limit(3)


@over_bars("select strftime(date, '%Y-%m') as month, cast(sum(volume) as bigint) as volume from bars group by 1")
def monthly_volume(b):
    return b.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("volume").alias("volume"))


@over_bars(f"select symbol, round(stddev_samp(ret), 6) as return_std from {_RETURNS} group by symbol")
def return_vol(b):
    return b.withColumn("ret", change(F.col("close"))).groupBy("symbol").agg(r6(F.stddev_samp("ret"), "return_std"))


@over_bars(f"select symbol, round(corr(volume, abs(ret)), 6) as vol_ret_corr from {_RETURNS} where ret is not null group by symbol")
def vol_ret_corr(b):
    return b.withColumn("ret", change(F.col("close"))).where("ret is not null").groupBy("symbol").agg(r6(F.corr(F.col("volume").cast("double"), F.abs("ret")), "vol_ret_corr"))


@over_bars(f"select a.symbol as left_symbol, b.symbol as right_symbol, count(*) as days, round(corr(a.ret, b.ret), 6) as corr from {_RETURNS} a join {_RETURNS} b on a.date = b.date and a.symbol < b.symbol where a.ret is not null and b.ret is not null group by 1, 2")
def corr_matrix(b):
    """Correlations of all pairs of symbols: an equi-join on the date, whose rows per date are the index's members."""
    rows = b.withColumn("ret", change(F.col("close"))).where("ret is not null").select("symbol", "date", "ret")
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.date") == F.col("b.date")) & (F.col("a.symbol") < F.col("b.symbol")))
    return pairs.groupBy(F.col("a.symbol").alias("left_symbol"), F.col("b.symbol").alias("right_symbol")).agg(F.count("*").alias("days"), r6(F.corr("a.ret", "b.ret"), "corr"))


@over_bars("select count(*) as n, count(distinct symbol) as symbols, min(date) as first_date, max(date) as last_date, round(avg(close), 2) as mean_close, round(avg(volume), 2) as mean_volume from bars")
def summary_row(b):
    return b.agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.round(F.avg("close"), 2).alias("mean_close"), F.round(F.avg("volume"), 2).alias("mean_volume"))


@over_bars("select date, " + ", ".join(f"round(avg(close) filter (where symbol = '{s}'), 6) as \"{s}\"" for s in SYMBOLS) + " from bars group by date")
def pivot_close(b):
    return b.groupBy("date").pivot("symbol", list(SYMBOLS)).agg(F.round(F.avg("close"), 6))


@over_bars("select cast(year(date) as integer) as year, count(*) filter (where date < date '1997-01-01') as train, count(*) filter (where date >= date '1997-01-01') as test from bars group by 1")
def year_split_counts(b):
    return b.groupBy(F.year("date").alias("year")).agg(F.count_if(F.col("date") < "1997-01-01").alias("train"), F.count_if(F.col("date") >= "1997-01-01").alias("test"))


@over_bars("select case when date < date '1997-01-01' then 'train' else 'test' end as part, count(*) as n, min(date) as first_date, max(date) as last_date from bars group by 1")
def split_ranges(b):
    return b.groupBy(F.when(F.col("date") < "1997-01-01", "train").otherwise("test").alias("part")).agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def _histogram(b, value, bins: int):
    rows = b.select(value.cast("double").alias("x")).where("x is not null")
    span = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    place = F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), (F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    found = rows.join(F.broadcast(span)).groupBy(F.coalesce(place, F.lit(0)).cast("int").alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return found.select("bin", F.round(F.col("lo") + F.col("bin") * width, 4).alias("left_edge"), "n")


def _histogram_sql(value: str, bins: int) -> str:
    return f""", x as (select ({value})::double as x from bars), s as (select min(x) as lo, max(x) as hi from x)
      select cast(least(floor((x - lo) / nullif((hi - lo) / {bins}, 0)), {bins - 1}) as integer) as bin, round(any_value(lo) + cast(least(floor((x - lo) / nullif((hi - lo) / {bins}, 0)), {bins - 1}) as integer) * any_value((hi - lo) / {bins}), 4) as left_edge, count(*) as n from x, s where x is not null group by bin, cast(least(floor((x - lo) / nullif((hi - lo) / {bins}, 0)), {bins - 1}) as integer)"""


@over_bars(_histogram_sql("close", 60))
def histogram(b):
    return _histogram(b, F.col("close"), 60)


@over_bars(_histogram_sql("ln(1 + volume)", 40))
def log_histogram(b):
    return _histogram(b, F.log1p("volume"), 40)


def _events(f, sql: str) -> None:
    QUERIES[f.__name__] = (lambda spark, sf_dir: f(table(spark, sf_dir, "events")), sql)


def value_counts(e):
    return e.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(10)


_events(value_counts, "select event_type, count(*) as n from events group by 1 order by n desc, event_type limit 10")


def intraday_bars(e):
    """Hourly bars of events."""
    order = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("hour")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume"))


_events(intraday_bars, """select event_type as symbol, date_trunc('hour', ts) as hour, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*) as volume
  from events group by 1, 2""")


def json_remap(e):
    """A JSON field with alternatives and a default; rows without it are dropped."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.key")).cast("int")
    return e.withColumn("k", k).where("k is not null").groupBy((F.col("k") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.sum("k").alias("total"))


_events(json_remap, """select k % 10 as bucket, count(*) as n, round(avg(value), 4) as mean_value, cast(sum(k) as bigint) as total from
  (select value, cast(coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.key')) as integer) as k from events) where k is not null group by 1""")


def _lineitem(f, sql: str) -> None:
    QUERIES[f.__name__] = (lambda spark, sf_dir: f(table(spark, sf_dir, "lineitem")), sql)


def vwap_by_day(li):
    return li.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.round(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")), 8).alias("vwap"), F.sum("l_quantity").alias("quantity"))


_lineitem(vwap_by_day, "select cast(l_shipdate as date) as date, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 8) as vwap, sum(l_quantity) as quantity from lineitem group by 1")


def regression_metrics(li):
    """MAE, RMSE, R2 and MAPE (zero targets skipped) of a price guess."""
    rows = li.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    gap = F.col("y") - F.col("p")
    a = rows.agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.sum(gap * gap).alias("sse"), F.var_pop("y").alias("v"), F.count("*").alias("n"), F.avg(F.abs(F.try_divide(gap, F.col("y")))).alias("mape"))
    return a.select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), r6(1 - F.try_divide(F.col("sse"), F.col("v") * F.col("n")), "r2"), r6(F.col("mape"), "mape"))


_lineitem(regression_metrics, """select round(avg(abs(y - p)), 4) as mae, round(sqrt(avg((y - p) * (y - p))), 4) as rmse, round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0), 6) as r2, round(avg(abs((y - p) / nullif(y, 0))), 6) as mape
  from (select l_extendedprice as y, l_quantity * 1500.0::double as p from lineitem)""")


def interval_coverage(li):
    """Share of targets between two bounds, and the 90th percentile of a guess."""
    y, q = F.col("l_extendedprice"), F.col("l_quantity")
    return li.agg(r6(F.avg(y.between(q * 1000.0, q * 2000.0).cast("double")), "coverage"), F.round(F.percentile(q * 1500.0, F.lit(0.9)), 4).alias("p90"))


_lineitem(interval_coverage, "select round(avg(case when l_extendedprice between l_quantity * 1000.0::double and l_quantity * 2000.0::double then 1.0::double else 0 end), 6) as coverage, round(quantile_cont(l_quantity * 1500.0::double, 0.9), 4) as p90 from lineitem")


def ols_single(li):
    return li.agg(r6(F.regr_slope("l_extendedprice", "l_quantity"), "slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), r6(F.regr_r2("l_extendedprice", "l_quantity"), "r2"))


_lineitem(ols_single, "select round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem")


def best_model(li):
    """The guess with the best R2."""
    y, q = F.col("l_extendedprice"), F.col("l_quantity")
    guesses = {"flat": F.lit(38000.0), "linear": q * 1500.0, "taxed": q * 1500.0 * (1 + F.col("l_tax"))}
    one = li.agg(F.array(*[F.struct(F.lit(n).alias("model"), (1 - F.try_divide(F.sum(F.pow(y - p, 2)), F.var_pop(y) * F.count("*"))).alias("r2")) for n, p in guesses.items()]).alias("m"))
    best = one.select(F.explode("m").alias("m")).select("m.*").agg(F.max_by("model", F.struct("r2", "model")).alias("model"), F.max("r2").alias("r2"))
    return best.select("model", r6(F.col("r2"), "r2"))


_lineitem(best_model, """with g as (select l_extendedprice as y, unnest([{'model': 'flat', 'p': 38000.0::double}, {'model': 'linear', 'p': l_quantity * 1500.0::double}, {'model': 'taxed', 'p': l_quantity * 1500.0::double * (1 + l_tax)}], recursive := true) from lineitem),
  r as (select model, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) as r2 from g group by model) select model, round(r2, 6) as r2 from r order by r2 desc limit 1""")


#: Quantiles of prices.
SHARES = (0.01, 0.25, 0.5, 0.75, 0.9, 0.99)


def price_quantiles(spark, sf_dir):
    """Exact quantiles of all lines' prices, by selection: no task sorts or holds a group's values."""
    found = quantiles.quantiles(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", list(SHARES))
    return found.select("l_returnflag", "share", "n", F.round("value", 6).alias("value"))


QUERIES["price_quantiles"] = (
    price_quantiles,
    f"select l_returnflag, share, count(*) as n, round(quantile_cont(l_extendedprice, share), 6) as value from (select l_returnflag, l_extendedprice, unnest({list(SHARES)})::double as share from lineitem where l_extendedprice is not null) group by 1, 2".replace("quantile_cont(l_extendedprice, share)", "case " + " ".join(f"when share = {s} then quantile_cont(l_extendedprice, {s})" for s in SHARES) + " end"),
)
