"""Indicator queries over daily bars."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.windows import ALL, W, YEAR, change, frame, full, garman_klass, log_change, obv, parkinson, running
from tidegauge.operators.ewm import with_ewm
from tidegauge.sources.adapters import BARS, bars, table

QUERIES: dict[str, tuple] = {}


def _with_bars(sql: str) -> str:
    """``$`` stands where further named queries follow the bars; ``recursive`` before it if one is."""
    head, _, rest = sql.rpartition("$")
    kind = "recursive " if "recursive" in head else ""
    return f"with {kind}{BARS}{',' if '$' in sql else ''} {rest.strip()}"


def query(sql: str | None):
    """Register a function of the bars under its name, with the SQL that must give the same rows."""

    def register(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(bars(spark, sf_dir), *[F.col(x) for x in ("close", "high", "low", "open", "volume")])

        QUERIES[f.__name__] = (run, sql and _with_bars(sql))
        return run

    return register


def r6(column, name: str):
    return F.round(column, 6).alias(name)


KEY = ("symbol", "date")


@query("select symbol, date, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume from bars")
def ohlc_bars(b, c, h, l, o, v):
    return b.select(*KEY, r6(o, "open"), r6(h, "high"), r6(l, "low"), r6(c, "close"), "volume")


@query("""select symbol, date, round(close / nullif(lag(close) over w, 0) - 1, 6) as daily_return, round(ln(close / nullif(lag(close) over w, 0)), 6) as log_return,
  case when count(close) over w20 = 20 then round(avg(close) over w20, 6) end as ma_20, case when count(close) over w50 = 50 then round(avg(close) over w50, 6) end as ma_50
  from bars window w as (partition by symbol order by date), w20 as (partition by symbol order by date rows 19 preceding), w50 as (partition by symbol order by date rows 49 preceding)""")
def returns_and_ma(b, c, h, l, o, v):
    return b.select(*KEY, r6(change(c), "daily_return"), r6(log_change(c), "log_return"), r6(full(F.avg, c, frame(20), 20), "ma_20"), r6(full(F.avg, c, frame(50), 50), "ma_50"))


@query("""$ r as (select *, ln(close / nullif(lag(close) over (partition by symbol order by date), 0)) as lr from bars)
  select symbol, date, case when count(lr) over w = 20 then round(stddev_samp(lr) over w, 6) end as volatility_20 from r window w as (partition by symbol order by date rows 19 preceding)""")
def volatility_20(b, c, h, l, o, v):
    return b.withColumn("lr", log_change(c)).select(*KEY, r6(full(F.stddev_samp, F.col("lr"), frame(20), 20), "volatility_20"))


@query("""$ m as (select *, case when count(close) over w = 20 then avg(close) over w end as ma, case when count(close) over w = 20 then stddev_samp(close) over w end as sd
  from bars window w as (partition by symbol order by date rows 19 preceding))
  select symbol, date, round(ma + 2 * sd, 6) as bb_upper, round(ma - 2 * sd, 6) as bb_lower, round((close - (ma - 2 * sd)) / nullif(4 * sd, 0), 6) as bb_pctb, round(4 * sd / nullif(ma, 0), 6) as bb_bw from m""")
def bollinger(b, c, h, l, o, v):
    m = b.withColumn("ma", full(F.avg, c, frame(20), 20)).withColumn("sd", full(F.stddev_samp, c, frame(20), 20))
    ma, sd = F.col("ma"), F.col("sd")
    return m.select(*KEY, r6(ma + 2 * sd, "bb_upper"), r6(ma - 2 * sd, "bb_lower"), r6(F.try_divide(c - (ma - 2 * sd), 4 * sd), "bb_pctb"), r6(F.try_divide(4 * sd, ma), "bb_bw"))


@query("""$ s as (select *, coalesce(sign(close - lag(close) over (partition by symbol order by date)), 0) * volume as step from bars)
  select symbol, date, cast(sum(step) over w as double) as obv, round((close - max(close) over w) / nullif(max(close) over w, 0), 6) as drawdown
  from s window w as (partition by symbol order by date rows unbounded preceding)""")
def obv_drawdown(b, c, h, l, o, v):
    top = running(c, F.max)
    return b.withColumn("step", obv(c, v)).select(*KEY, running(F.col("step")).alias("obv"), r6(F.try_divide(c - top, top), "drawdown"))


@query("select symbol, date, round(volume / nullif(lag(volume) over (partition by symbol order by date), 0)::double - 1, 6) as volume_change from bars")
def volume_change(b, c, h, l, o, v):
    return b.select(*KEY, r6(change(v), "volume_change"))


@query("""$ r as (select *, abs(ln(close / nullif(lag(close) over (partition by symbol order by date), 0))) * sqrt(252.0::double) as rv from bars)
  select symbol, date, round(rv, 6) as rv, round(lag(rv) over (partition by symbol order by date), 6) as rv_d,
  case when count(rv) over w5 = 5 then round(avg(rv) over w5, 6) end as rv_w, case when count(rv) over w22 = 22 then round(avg(rv) over w22, 6) end as rv_m
  from r window w5 as (partition by symbol order by date rows between 5 preceding and 1 preceding), w22 as (partition by symbol order by date rows between 22 preceding and 1 preceding)""")
def har_panel(b, c, h, l, o, v):
    rv = F.col("rv")
    return b.withColumn("rv", F.abs(log_change(c)) * F.sqrt(F.lit(float(YEAR)))).select(
        *KEY, r6(rv, "rv"), r6(F.lag(rv).over(W()), "rv_d"), r6(full(F.avg, rv, frame(5, 1), 5), "rv_w"), r6(full(F.avg, rv, frame(22, 1), 22), "rv_m"))


@query("""$ g as (select symbol, date, ln(high / nullif(low, 0)) as hl, ln(close / nullif(open, 0)) as co from bars),
  q as (select *, 0.5::double * hl * hl - (2 * ln(2.0::double) - 1) * co * co as inner_ from g)
  select symbol, date, round(sqrt(hl * hl / (4 * ln(2.0::double))) * sqrt(252.0::double), 6) as parkinson_vol, round(case when inner_ >= 0 then sqrt(inner_) end * sqrt(252.0::double), 6) as gk_vol from q""")
def parkinson_gk(b, c, h, l, o, v):
    return b.select(*KEY, r6(parkinson(h, l), "parkinson_vol"), r6(garman_klass(o, h, l, c), "gk_vol"))


@query("select symbol, date, round(abs(ln(close / nullif(lag(close) over (partition by symbol order by date), 0))) / nullif(volume * close, 0) * 1e8, 6) as amihud from bars")
def amihud(b, c, h, l, o, v):
    return b.select(*KEY, r6(F.try_divide(F.abs(log_change(c)), v * c) * F.lit(1e8), "amihud"))


@query("""select symbol, date, lag(close) over w as close_lag1, lag(volume) over w as volume_lag1,
  case when count(volume) over w5 = 5 then round(avg(volume) over w5, 6) end as volume_ma5, cast(isodow(date) - 1 as integer) as day_of_week, cast(month(date) as integer) as month
  from bars window w as (partition by symbol order by date), w5 as (partition by symbol order by date rows between 5 preceding and 1 preceding)""")
def lag_features(b, c, h, l, o, v):
    return b.select(*KEY, F.lag(c).over(W()).alias("close_lag1"), F.lag(v).over(W()).alias("volume_lag1"), r6(full(F.avg, v, frame(5, 1), 5), "volume_ma5"), F.weekday("date").alias("day_of_week"), F.month("date").alias("month"))


def _target(low: int, high: int):
    sql = f"""$ r as (select *, ln(close / nullif(lag(close) over (partition by symbol order by date), 0)) as lr from bars)
      select symbol, date, case when count(lr) over w = 5 then round(stddev_samp(lr) over w * sqrt(252.0::double), 6) end as target
      from r window w as (partition by symbol order by date rows between {f'{-low} preceding' if low < 0 else f'{low} following'} and {high} following)"""

    def run(b, c, h, l, o, v):
        return b.withColumn("lr", log_change(c)).select(*KEY, r6(full(F.stddev_samp, F.col("lr"), W().rowsBetween(low, high), 5) * F.sqrt(F.lit(float(YEAR))), "target"))

    return sql, run


for _name, _low, _high in (("rv_target_ref", -3, 1), ("rv_target_fwd", 1, 5)):
    _sql, _run = _target(_low, _high)
    _run.__name__ = _name
    query(_sql)(_run)


@query("""select symbol, date, round(close / first_value(close) over (partition by symbol order by date) * 100, 6) as base100 from bars""")
def base100(b, c, h, l, o, v):
    return b.select(*KEY, r6(F.try_divide(c, F.first(c, ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) * 100, "base100"))


@query("""select symbol, max(date) as date, arg_max(close, date) as close, round((arg_max(close, date) - arg_max(open, date)) / nullif(arg_max(open, date), 0) * 100, 6) as change_pct from bars group by symbol""")
def latest_quote(b, c, h, l, o, v):
    last = b.groupBy("symbol").agg(F.max_by(F.struct("date", "open", "close"), "date").alias("x"))
    return last.select("symbol", F.col("x.date").alias("date"), F.col("x.close").alias("close"), r6(F.try_divide(F.col("x.close") - F.col("x.open"), F.col("x.open")) * 100, "change_pct"))


_SNAPSHOT = """$ m as (select *, case when count(close) over w = 20 then avg(close) over w end as ma_20, case when count(close) over w50 = 50 then avg(close) over w50 end as ma_50,
    case when count(close) over w = 20 then stddev_samp(close) over w end as sd, close / nullif(lag(close) over (partition by symbol order by date), 0) - 1 as ret,
    (close - max(close) over wu) / nullif(max(close) over wu, 0) as dd, row_number() over (partition by symbol order by date desc) as rn
    from bars window w as (partition by symbol order by date rows 19 preceding), w50 as (partition by symbol order by date rows 49 preceding), wu as (partition by symbol order by date rows unbounded preceding))
  select symbol, date, close, round(ret, 6) as daily_return, round(ma_20, 6) as ma_20, round(ma_50, 6) as ma_50, round((close - (ma_20 - 2 * sd)) / nullif(4 * sd, 0), 6) as bb_pctb, round(dd, 6) as drawdown,
    case when ma_50 is null then 'unknown' when close > ma_50 then 'above ma_50' else 'below ma_50' end as trend,
    case when sd is null or sd = 0 then 'unknown' when (close - (ma_20 - 2 * sd)) / (4 * sd) > 1 then 'over upper band' when (close - (ma_20 - 2 * sd)) / (4 * sd) < 0 then 'under lower band' else 'inside bands' end as band
  from m where rn = 1"""


@query(_SNAPSHOT)
def kpi_snapshot(b, c, h, l, o, v):
    """Latest quote with its indicators and their bands, per symbol."""
    m = b.select("*", full(F.avg, c, frame(20), 20).alias("ma_20"), full(F.avg, c, frame(50), 50).alias("ma_50"), full(F.stddev_samp, c, frame(20), 20).alias("sd"), change(c).alias("ret"), running(c, F.max).alias("top"))
    m = m.withColumn("rn", F.row_number().over(ALL().orderBy(F.desc("date")))).where("rn = 1")
    pctb = F.try_divide(c - (F.col("ma_20") - 2 * F.col("sd")), 4 * F.col("sd"))
    trend = F.when(F.col("ma_50").isNull(), "unknown").when(c > F.col("ma_50"), "above ma_50").otherwise("below ma_50")
    band = F.when(pctb.isNull(), "unknown").when(pctb > 1, "over upper band").when(pctb < 0, "under lower band").otherwise("inside bands")
    return m.select(*KEY, "close", r6(F.col("ret"), "daily_return"), r6(F.col("ma_20"), "ma_20"), r6(F.col("ma_50"), "ma_50"), r6(pctb, "bb_pctb"), r6(F.try_divide(c - F.col("top"), F.col("top")), "drawdown"), trend.alias("trend"), band.alias("band"))


@query("""select s.symbol, coalesce(max(b.date), date '2022-01-01') as last_date, cast(coalesce(max(b.date), date '2022-01-01') + 1 as date) as fetch_from
  from (select distinct symbol from bars union select 'MARKET') s left join bars b on b.symbol = s.symbol group by s.symbol""")
def high_water_mark(b, c, h, l, o, v):
    """The day after each symbol's last bar; symbols without bars begin at a default."""
    spark = b.sparkSession
    known = b.select("symbol").union(spark.createDataFrame([("MARKET",)], "symbol string")).distinct()
    last = known.join(b.groupBy("symbol").agg(F.max("date").alias("d")), "symbol", "left").select("symbol", F.coalesce("d", F.lit("2022-01-01").cast("date")).alias("last_date"))
    return last.withColumn("fetch_from", F.date_add("last_date", 1))


@query("select symbol, date, cast(dense_rank() over (order by symbol) - 1 as integer) as symbol_enc from bars")
def category_code(b, c, h, l, o, v):
    codes = b.select("symbol").distinct().withColumn("symbol_enc", F.dense_rank().over(Window.orderBy("symbol")) - 1)
    return b.select(*KEY).join(codes, "symbol").select(*KEY, "symbol_enc")


@query("select min(last) as earliest_last from (select symbol, max(date) as last from bars group by symbol)")
def earliest_last_date(b, c, h, l, o, v):
    return b.groupBy("symbol").agg(F.max("date").alias("last")).agg(F.min("last").alias("earliest_last"))


_ROWS = "select symbol, date, high, low, close, row_number() over (partition by symbol order by date) as rn, lag(close) over (partition by symbol order by date) as pc from bars"


@query(f"""recursive $ s as ({_ROWS}),
  r as (select symbol, rn, date, close as e12, close as e26, 0.0::double as sig from s where rn = 1
    union all select s.symbol, s.rn, s.date, r.e12 * (1 - 2 / 13.0::double) + s.close * (2 / 13.0::double), r.e26 * (1 - 2 / 27.0::double) + s.close * (2 / 27.0::double),
      r.sig * 0.8::double + 0.2::double * ((r.e12 * (1 - 2 / 13.0::double) + s.close * (2 / 13.0::double)) - (r.e26 * (1 - 2 / 27.0::double) + s.close * (2 / 27.0::double)))
    from r join s on s.symbol = r.symbol and s.rn = r.rn + 1)
  select symbol, date, round(e12 - e26, 5) as macd_line, round(sig, 5) as macd_signal, round(e12 - e26 - sig, 5) as macd_hist from r""")
def macd(b, c, h, l, o, v):
    e = with_ewm(b.select(*KEY, "close"), {"e12": ("close", dict(span=12, adjust=False)), "e26": ("close", dict(span=26, adjust=False)), "sig": ("e12 - e26", dict(span=9, adjust=False))})
    line = F.col("e12") - F.col("e26")
    return e.select(*KEY, F.round(line, 5).alias("macd_line"), F.round("sig", 5).alias("macd_signal"), F.round(line - F.col("sig"), 5).alias("macd_hist"))


def _rsi(b, first_is_zero: bool, adjust: bool):
    c = F.col("close")
    move = c - F.lag(c).over(W())
    move = F.coalesce(move, F.lit(0.0)) if first_is_zero else move
    g = b.select(*KEY, F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))).alias("gain"), F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))).alias("loss"))
    weights = dict(alpha=1 / 14, adjust=adjust, min_periods=14)
    return with_ewm(g, {"up": ("gain", weights), "down": ("loss", weights)})


def _wilder(first: int, start: str) -> str:
    return f"""recursive $ s as (select *, greatest({start}, 0) as g, greatest(-({start}), 0) as d from ({_ROWS})),
      r as (select symbol, rn, date, g as up, d as down from s where rn = {first}
        union all select s.symbol, s.rn, s.date, r.up * (13 / 14.0::double) + s.g / 14.0::double, r.down * (13 / 14.0::double) + s.d / 14.0::double from r join s on s.symbol = r.symbol and s.rn = r.rn + 1)"""


@query(_wilder(2, "close - pc") + """ select b.symbol, b.date, round(case when r.rn >= 15 then case when down = 0 then case when up > 0 then 100 end else 100 - 100 / (1 + up / down) end end, 5) as rsi_14
  from bars b left join r on r.symbol = b.symbol and r.date = b.date""")
def rsi_wilder(b, c, h, l, o, v):
    e = _rsi(b, False, False)
    value = F.when(F.col("down") == 0, F.when(F.col("up") > 0, F.lit(100.0))).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(F.col("up"), F.col("down"))))
    return e.select(*KEY, F.round(F.when(F.isnan("up"), None).otherwise(value), 5).alias("rsi_14"))


@query(_wilder(1, "coalesce(close - pc, 0)") + " select symbol, date, round(case when rn >= 14 then 100 - 100 / (1 + up / nullif(down, 0)) end, 5) as rsi_14 from r")
def rsi_refresh(b, c, h, l, o, v):
    e = _rsi(b, True, False)
    return e.select(*KEY, F.round(F.when(~F.isnan("up"), 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(F.col("up"), F.col("down")))), 5).alias("rsi_14"))


@query(f"""recursive $ s as (select *, greatest(close - pc, 0) as g, greatest(pc - close, 0) as d from ({_ROWS})),
  r as (select symbol, rn, date, g as up, d as down from s where rn = 2
    union all select s.symbol, s.rn, s.date, r.up * (13 / 14.0::double) + s.g, r.down * (13 / 14.0::double) + s.d from r join s on s.symbol = r.symbol and s.rn = r.rn + 1)
  select b.symbol, b.date, round(case when r.rn >= 15 then 100 - 100 / (1 + up / nullif(down, 0)) end, 5) as rsi_14 from bars b left join r on r.symbol = b.symbol and r.date = b.date""")
def rsi_adjusted(b, c, h, l, o, v):
    e = _rsi(b, False, True)
    return e.select(*KEY, F.round(F.when(~F.isnan("up"), 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(F.col("up"), F.col("down")))), 5).alias("rsi_14"))


@query(f"""recursive $ s as (select *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) as tr from ({_ROWS})),
  r as (select symbol, rn, date, tr as num, 1.0::double as den from s where rn = 1
    union all select s.symbol, s.rn, s.date, r.num * (13 / 14.0::double) + s.tr, r.den * (13 / 14.0::double) + 1 from r join s on s.symbol = r.symbol and s.rn = r.rn + 1)
  select symbol, date, round(case when rn >= 14 then num / den end, 5) as atr_14 from r""")
def atr(b, c, h, l, o, v):
    pc = F.lag(c).over(W())
    tr = b.select(*KEY, F.greatest(h - l, F.abs(h - pc), F.abs(l - pc)).alias("tr"))
    e = with_ewm(tr, {"atr": ("tr", dict(com=13, min_periods=14))})
    return e.select(*KEY, F.round(F.when(~F.isnan("atr"), F.col("atr")), 5).alias("atr_14"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as ticks of three series, each with a large share of all rows."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("at"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))


#: Ticks after which older ones don't show in a double any more.
_REACH = 480
_TICKS = f"""with t as (select l_returnflag as symbol, l_orderkey, l_linenumber, l_shipdate, list(l_extendedprice) over w as l, row_number() over (partition by l_returnflag order by l_shipdate, l_orderkey, l_linenumber, l_extendedprice) as rn
  from lineitem window w as (partition by l_returnflag order by l_shipdate, l_orderkey, l_linenumber, l_extendedprice rows {_REACH - 1} preceding))
  select symbol, l_orderkey, l_linenumber, round(list_sum(list_transform(l, lambda x, i: x * (11 / 13.0::double) ** (len(l) - i) * case when i = 1 and rn = len(l) then 1 else 2 / 13.0::double end)), 4) as ema_12,
  round(list_sum(list_transform(l, lambda x, i: x * (13 / 14.0::double) ** (len(l) - i))) / list_sum(list_transform(l, lambda x, i: (13 / 14.0::double) ** (len(l) - i))), 3) as mean_14 from t"""


def ewm_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means along every tick of the longest series: ranges of a series are tasks of their own."""
    e = with_ewm(ticks(spark, sf_dir), {"ema_12": ("price", dict(span=12, adjust=False)), "mean_14": ("price", dict(com=13))}, order=("at", "l_orderkey", "l_linenumber", "price"))
    return e.select("symbol", "l_orderkey", "l_linenumber", F.round("ema_12", 4).alias("ema_12"), F.round("mean_14", 3).alias("mean_14"))


QUERIES["ewm_ticks"] = (ewm_ticks, _TICKS)
