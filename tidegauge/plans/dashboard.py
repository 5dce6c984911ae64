"""Named result sets of the dashboard, and the documented finance queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import numbers, text
from tidegauge.functions.windows import W
from tidegauge.plans import events, indicators
from tidegauge.plans.events import _CHANGES, _MATCHED, SYMBOL, _changes, _matched, daily
from tidegauge.plans.indicators import _SNAPSHOT, _with_bars, kpi_snapshot
from tidegauge.plans.texts import _HYBRID, _hybrid
from tidegauge.sources.adapters import BARS, MARKET, NEWS, bars, news, table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def scan(rows: DataFrame, columns: list[str] | None = None, where: list[Column] = (), order: list[Column] = (), limit: int | None = None) -> DataFrame:
    """A table read as clients ask for it: columns that exist, filters, order, limit. Filters and columns reach the scan."""
    for condition in where:
        rows = rows.where(condition)
    if order:
        rows = rows.orderBy(*order)
    if limit is not None:
        rows = rows.limit(limit)
    return rows.select(*[c for c in columns if c in rows.columns]) if columns else rows


_CARDS = f"""{_MATCHED}, {_HYBRID}, lastday as (select max(date) as d from bars), q as (select symbol, arg_max(close, date) as c, arg_max(open, date) as o from bars group by symbol)"""


@query(f"""with {_CARDS} select 'symbols up' as card, cast(count(*) filter (where c > o) as varchar) as value from q union all select 'symbols down', cast(count(*) filter (where c < o) as varchar) from q
  union all select 'positive share', cast(cast(round(100 * count(*) filter (where s > 0) / count(*)::double, 0) as bigint) as varchar) from h union all select 'change points', cast(count(*) as varchar) from matched union all select 'covered', cast(count(*) filter (where covered) as varchar) from matched""")
def overview_cards(spark, sf_dir):
    """Five cards, each from all rows."""
    q = bars(spark, sf_dir).groupBy("symbol").agg(F.max_by(F.struct("open", "close"), "date").alias("x"))
    a = q.agg(F.count_if(F.col("x.close") > F.col("x.open")).alias("up"), F.count_if(F.col("x.close") < F.col("x.open")).alias("down"))
    b = _hybrid(news(spark, sf_dir)).agg(F.round(100 * F.count_if(F.col("s") > 0) / F.count("*"), 0).cast("long").alias("share"))
    c = _matched(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("covered").alias("covered"))
    cards = (("symbols up", "up"), ("symbols down", "down"), ("positive share", "share"), ("change points", "n"), ("covered", "covered"))
    one = a.join(b).join(c)  # three rows
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("card"), F.col(v).cast("string").alias("value")) for k, v in cards])).alias("x")).select("x.*")


_P, _CI = (f"({events.QUERIES[name][1]})" for name in ("permutation_p", "bootstrap_ci"))


@query(f"""with {_CARDS}, m as (select count(*) filter (where s > 0) as pos, count(*) filter (where s <= 0) as neg from h), k as (select count(*) filter (where direction = 1) as up, count(*) filter (where direction = -1) as down from matched)
  select 'symbols' as card, (select count(distinct symbol) from bars)::double as value, null::double as low, null::double as high, (select max(date) from bars)::varchar as state
  union all select 'news', (select count(*) from news)::double, null, null, ''
  union all select 'sentiment', round(pos / nullif(pos + neg, 0)::double, 6), neg::double, pos::double, case when pos + neg = 0 then 'none' when pos / (pos + neg)::double > 0.55 then 'positive' when pos / (pos + neg)::double < 0.45 then 'negative' else 'balanced' end from m
  union all select 'change points', (up + down)::double, down::double, up::double, '' from k
  union all select 'match rate', p.observed, c.low, c.high, 'p=' || p.p_two_sided from {_P} p, {_CI} c""")
def overview_study(spark, sf_dir):
    """The five cards of the overview: symbols and their last day, news, the mood, change points down and up, and the match rate with its p-value and interval."""
    b = bars(spark, sf_dir).agg(F.count_distinct("symbol").cast("double").alias("n"), F.max("date").cast("string").alias("state"))
    nothing = F.lit(None).cast("double")
    m = _hybrid(news(spark, sf_dir)).agg(F.count_if(F.col("s") > 0).cast("double").alias("pos"), F.count_if(F.col("s") <= 0).cast("double").alias("neg"), F.count("*").cast("double").alias("all"))
    ratio = F.try_divide("pos", F.col("pos") + F.col("neg"))
    mood = F.when(ratio.isNull(), "none").when(ratio > 0.55, "positive").when(ratio < 0.45, "negative").otherwise("balanced")
    k = _changes(spark, sf_dir).agg(F.count_if(F.col("direction") == 1).cast("double").alias("up"), F.count_if(F.col("direction") == -1).cast("double").alias("down"))
    p, c = events.permutation_p(spark, sf_dir), events.bootstrap_ci(spark, sf_dir)
    row = lambda rows, card, value, low, high, state: rows.select(F.lit(card).alias("card"), value.alias("value"), low.alias("low"), high.alias("high"), state.alias("state"))
    cards = [
        row(b, "symbols", F.col("n"), nothing, nothing, F.col("state")), row(m, "news", F.col("all"), nothing, nothing, F.lit("")), row(m, "sentiment", F.round(ratio, 6), F.col("neg"), F.col("pos"), mood),
        row(k, "change points", F.col("up") + F.col("down"), F.col("down"), F.col("up"), F.lit("")), row(p.join(c), "match rate", F.col("observed"), F.col("low"), F.col("high"), F.concat(F.lit("p="), F.col("p_two_sided").cast("string"))),
    ]
    out = cards[0]
    for card in cards[1:]:
        out = out.unionByName(card)
    return out


@query(f"with {BARS} select date, open, high, low, close, volume from bars where symbol = '{SYMBOL}' and date >= (select cast(max(date) - 90 as date) from bars where symbol = '{SYMBOL}')")
def price_series(spark, sf_dir):
    """A symbol's bars of the last 90 days before its last one."""
    b = bars(spark, sf_dir).where(F.col("symbol") == SYMBOL)
    last = b.agg(F.date_sub(F.max("date"), 90).alias("since"))
    return b.join(F.broadcast(last)).where("date >= since").select("date", "open", "high", "low", "close", "volume").orderBy("date")


_FEED = f"{NEWS}, {_HYBRID}, feed as (select n.news_id, n.date, n.source, n.symbol, split_part(text, chr(10), 1) as headline, round(h.s, 6) as score, case when h.s > 0.1 then 'positive' when h.s < -0.1 then 'negative' else 'neutral' end as label_3cls from news n left join h on h.news_id = n.news_id)"


def _feed(spark, sf_dir) -> DataFrame:
    n = news(spark, sf_dir)
    scored = _hybrid(n).select("news_id", F.round("s", 6).alias("score"), text.three_classes(F.col("s")).alias("label_3cls"))
    return n.select("news_id", "date", "source", "symbol", F.substring_index("text", "\n", 1).alias("headline")).join(scored, "news_id", "left")


@query(f"with {_FEED} select news_id, date, source, headline, score from feed where label_3cls = 'positive' order by date desc, news_id desc limit 100")
def news_feed(spark, sf_dir):
    return scan(_feed(spark, sf_dir), ["news_id", "date", "source", "headline", "score"], [F.col("label_3cls") == "positive"], [F.desc("date"), F.desc("news_id")], 100)


@query(f"with {_FEED} select * from feed where symbol in ('{SYMBOL}', '{MARKET}') and source in ('src0', 'src1', 'src2') and date between date '1996-01-01' and date '2000-12-31' and score between -0.9 and 0.9 and label_3cls <> 'neutral'")
def browse_news(spark, sf_dir):
    """Filters by symbol, source, class, dates and scores; each of them may be left out."""
    wanted = dict(symbol=F.col("symbol").isin(SYMBOL, MARKET), source=F.col("source").isin("src0", "src1", "src2"), date=F.col("date").between("1996-01-01", "2000-12-31"), score=F.col("score").between(-0.9, 0.9), label=F.col("label_3cls") != "neutral")
    return scan(_feed(spark, sf_dir), None, list(wanted.values()))


@query(f"with {_FEED} select news_id, date, score from feed where date > (select cast(max(date) - 30 as date) from feed) order by abs(score) desc, news_id limit 10")
def strongest_news(spark, sf_dir):
    """The ten strongest scores of the last days."""
    feed = _feed(spark, sf_dir)
    since = feed.agg(F.date_sub(F.max("date"), 30).alias("since"))
    return feed.join(F.broadcast(since)).where("date > since").orderBy(F.desc(F.abs("score")), "news_id").limit(10).select("news_id", "date", "score")


@query(f"""with {_MATCHED}, wd as (select date, sum(mean_score * n) / sum(n) as w from (select symbol, date, avg(score) as mean_score, count(*) as n from news where symbol in ('{SYMBOL}', '{MARKET}') group by 1, 2) group by date)
  select b.date, round(b.close, 6) as close, round(w, 6) as sentiment, case when count(w) over r >= 3 then round(avg(w) over r, 6) end as sentiment_ma10, cast(cp.direction as integer) as cp_direction
  from bars b left join wd on wd.date = b.date left join cp on cp.symbol = b.symbol and cp.date = b.date where b.symbol = '{SYMBOL}' window r as (order by b.date rows 9 preceding)""")
def drilldown(spark, sf_dir):
    """A symbol's prices with weighted sentiment, its moving mean and change markers."""
    b = bars(spark, sf_dir).where(F.col("symbol") == SYMBOL).select("symbol", "date", "close")
    day = daily(news(spark, sf_dir).where(F.col("symbol").isin(SYMBOL, MARKET)))
    w = day.groupBy("date").agg((F.sum(F.col("mean_score") * F.col("n_news")) / F.sum("n_news")).alias("w"))
    cp = _changes(spark, sf_dir).select("symbol", "date", F.col("direction").alias("cp_direction"))
    r = W().rowsBetween(-9, 0)
    rows = b.join(w, "date", "left").join(cp, ["symbol", "date"], "left")
    return rows.select("date", F.round("close", 6).alias("close"), F.round("w", 6).alias("sentiment"), F.when(F.count("w").over(r) >= 3, F.round(F.avg("w").over(r), 6)).alias("sentiment_ma10"), "cp_direction")


@query(f"with {_MATCHED} select symbol, count(*) as n_cp, round(count(*) filter (where match) / nullif(count(*) filter (where has_signal), 0)::double, 3) as match_rate from matched group by symbol order by match_rate desc nulls last, symbol limit 5")
def match_ranking(spark, sf_dir):
    g = _matched(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n_cp"), F.round(F.try_divide(F.count_if("match"), F.count_if("has_signal")), 3).alias("match_rate"))
    return g.orderBy(F.col("match_rate").desc_nulls_last(), "symbol").limit(5)


@query(f"""with {_MATCHED}, {_HYBRID}, parts as (
    select 'news' as part, row_number() over (order by date desc, news_id desc) as place, date || ' ' || source || ' ' || split_part(text, chr(10), 1) as line from (select * from news order by date desc, news_id desc limit 10)
    union all select 'sentiment', row_number() over (order by label), label || ': ' || n from (select case when s > 0.1 then 'positive' when s < -0.1 then 'negative' else 'neutral' end as label, count(*) as n from h group by 1)
    union all select 'change point', row_number() over (order by date desc, symbol), date || ' ' || symbol || ' ' || direction from (select * from cp order by date desc, symbol limit 15)
    union all select 'test', 1, count(*) || ' ' || count(*) filter (where has_signal) || ' ' || count(*) filter (where match) from matched
    union all select 'price', row_number() over (order by date desc, symbol), symbol || ' ' || date || ' ' || volume from (select * from bars order by date desc, symbol limit 30))
  select part, cast(place as integer) as place, line from parts""")
def assistant_context(spark, sf_dir, question: str = ""):
    """What a question is answered from: newest news, the sentiment's distribution, newest change points, the study's counts, prices.

    Prices are the 10 newest of the symbol that the question names, or else the 30 newest of all.
    """
    n = news(spark, sf_dir)

    def lines(rows, part, order, line):
        return rows.select(F.lit(part).alias("part"), F.row_number().over(Window.orderBy(*order)).alias("place"), line.alias("line"))

    newest, by_news = n.orderBy(F.desc("date"), F.desc("news_id")).limit(10), [F.desc("date"), F.desc("news_id")]
    a = lines(newest, "news", by_news, F.concat_ws(" ", F.col("date").cast("string"), "source", F.substring_index("text", "\n", 1)))
    mood = _hybrid(n).groupBy(text.three_classes(F.col("s")).alias("label")).agg(F.count("*").alias("n"))
    b = lines(mood, "sentiment", ["label"], F.concat("label", F.lit(": "), F.col("n").cast("string")))
    by_date = [F.desc("date"), "symbol"]
    cp = _changes(spark, sf_dir).orderBy(*by_date).limit(15)
    c = lines(cp, "change point", by_date, F.concat_ws(" ", F.col("date").cast("string"), "symbol", F.col("direction").cast("string")))
    counts = _matched(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("has_signal").alias("s"), F.count_if("match").alias("m"))
    d = counts.select(F.lit("test").alias("part"), F.lit(1).alias("place"), F.concat_ws(" ", *[F.col(x).cast("string") for x in "nsm"]).alias("line"))
    prices, named = bars(spark, sf_dir), re.search(text.QUESTION_SYMBOL, question)
    of_symbol = prices.where(F.col("symbol") == named.group(1)) if named else prices.limit(0)
    newest = (prices.orderBy(*by_date).limit(30) if of_symbol.isEmpty() else of_symbol.orderBy(*by_date).limit(10))
    e = lines(newest, "price", by_date, F.concat_ws(" ", "symbol", F.col("date").cast("string"), F.col("volume").cast("string")))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)


@query(_with_bars(f"""$ {NEWS}, snap as ({_SNAPSHOT.replace("$", "with")}), parts as (
    select 'snapshot' as part, 1 as place, date || ' ' || trend || ', ' || band as line from snap where symbol = '{SYMBOL}'
    union all select 'news', row_number() over (order by date desc, news_id desc), date || ' ' || news_id || ' ' || source from (select * from news where symbol in ('{SYMBOL}', '{MARKET}') order by date desc, news_id desc limit 20))
  select part, cast(place as integer) as place, line from parts"""))
def drilldown_cards(spark, sf_dir):
    """Beside a symbol's chart: its indicator snapshot, and the newest news of it and of the market."""
    snap = kpi_snapshot(spark, sf_dir).where(F.col("symbol") == SYMBOL)
    a = snap.select(F.lit("snapshot").alias("part"), F.lit(1).alias("place"), F.concat(F.col("date").cast("string"), F.lit(" "), "trend", F.lit(", "), "band").alias("line"))
    order = [F.desc("date"), F.desc("news_id")]
    newest = news(spark, sf_dir).where(F.col("symbol").isin(SYMBOL, MARKET)).orderBy(*order).limit(20)
    b = newest.select(F.lit("news").alias("part"), F.row_number().over(Window.orderBy(*order)).alias("place"), F.concat_ws(" ", F.col("date").cast("string"), F.col("news_id").cast("string"), "source").alias("line"))
    return a.unionByName(b)


_TABLES = (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"), ("documents", None), ("pages", None), ("labels", None), ("customer", None), ("supplier", None), ("part", None), ("nation", None), ("region", None), ("conversations", None))


@query(" union all ".join(f"select '{t}' as name, count(*) as n, {f'cast(max({c}) as date)' if c else 'cast(null as date)'} as latest from {t}" for t, c in _TABLES))
def table_monitor(spark, sf_dir):
    """Rows and latest date of every table."""
    parts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), (F.to_date(F.max(c)) if c else F.lit(None).cast("date")).alias("latest")) for t, c in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Bounds of an index of strength that is high, or low.
STRONG, WEAK = 70, 30
_OF = {name: f"({indicators.QUERIES[name][1]})" for name in ("kpi_snapshot", "rsi_wilder", "macd", "volatility_20", "obv_drawdown", "volume_change", "returns_and_ma")}
_SIGN = "case when {0} > 0 then 'up' when {0} < 0 then 'down' else 'level' end"


@query(f"""with s as (select k.symbol, k.date, k.close, k.ma_20, k.ma_50, k.bb_pctb, k.drawdown, rsi_14, macd_line, macd_signal, macd_hist, volatility_20, k.daily_return, log_return, obv, volume_change, up, down
    from {_OF["kpi_snapshot"]} k left join {_OF["rsi_wilder"]} r using (symbol, date) left join {_OF["macd"]} m using (symbol, date) left join {_OF["volatility_20"]} v using (symbol, date) left join {_OF["obv_drawdown"]} o using (symbol, date)
    left join {_OF["volume_change"]} c using (symbol, date) left join {_OF["returns_and_ma"]} w using (symbol, date)
    left join (with {_CHANGES} select symbol, count(*) filter (where direction = 1) as up, count(*) filter (where direction = -1) as down from cp group by symbol) p on p.symbol = k.symbol)
  select symbol, date, 1 as place, 'RSI(14)' as card, rsi_14 as value, null::double as beside, null::double as beside_2, case when rsi_14 is null then '' when rsi_14 >= {STRONG} then 'overbought' when rsi_14 <= {WEAK} then 'oversold' else 'neutral' end as state from s
  union all select symbol, date, 2, 'MACD Hist', macd_hist, macd_line, macd_signal, case when macd_hist >= 0 then 'up' when macd_hist < 0 then 'down' else '' end from s
  union all select symbol, date, 3, 'MA20 / MA50', ma_20, ma_50, close, case when ma_50 is null or ma_50 = 0 then '' when close > ma_50 then 'uptrend' else 'downtrend' end from s
  union all select symbol, date, 4, 'Bollinger %b', bb_pctb, null, null, case when bb_pctb > 1 then 'above' when bb_pctb < 0 then 'below' else 'inside' end from s
  union all select symbol, date, 5, 'Volatility(20)', volatility_20, null, null, '' from s
  union all select symbol, date, 6, 'Daily / Log return', daily_return, log_return, null, {_SIGN.format('coalesce(daily_return, 0)')} from s
  union all select symbol, date, 7, 'Drawdown', drawdown, null, null, 'down' from s
  union all select symbol, date, 8, 'Volume / OBV', volume_change, obv, null, case when volume_change > 0 then 'up' else 'level' end from s
  union all select symbol, date, 9, 'Change points', coalesce(up + down, 0)::double, coalesce(up, 0)::double, coalesce(down, 0)::double, '' from s""")
def kpi_cards(spark, sf_dir):
    """The nine cards of a symbol's last day: figures and what they stand for."""
    of = lambda name: indicators.QUERIES[name][0](spark, sf_dir)
    s = of("kpi_snapshot")
    for name, columns in (("rsi_wilder", ["rsi_14"]), ("macd", ["macd_line", "macd_signal", "macd_hist"]), ("volatility_20", ["volatility_20"]), ("obv_drawdown", ["obv"]), ("volume_change", ["volume_change"]), ("returns_and_ma", ["log_return"])):
        s = s.join(of(name).select("symbol", "date", *columns), ["symbol", "date"], "left")
    points = _changes(spark, sf_dir).groupBy("symbol").agg(F.count_if(F.col("direction") == 1).alias("up"), F.count_if(F.col("direction") == -1).alias("down"))
    s = s.join(points, "symbol", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("up", "down")})
    rsi, hist, b, ret = (F.col(x) for x in ("rsi_14", "macd_hist", "bb_pctb", "daily_return"))
    sign = F.when(ret > 0, "up").when(ret < 0, "down").otherwise("level")
    cards = (
        ("RSI(14)", rsi, None, None, F.when(rsi.isNull(), "").when(rsi >= STRONG, "overbought").when(rsi <= WEAK, "oversold").otherwise("neutral")),
        ("MACD Hist", hist, "macd_line", "macd_signal", F.when(hist >= 0, "up").when(hist < 0, "down").otherwise("")),
        ("MA20 / MA50", F.col("ma_20"), "ma_50", "close", F.when(F.coalesce("ma_50", F.lit(0.0)) == 0, "").when(F.col("close") > F.col("ma_50"), "uptrend").otherwise("downtrend")),
        ("Bollinger %b", b, None, None, F.when(b > 1, "above").when(b < 0, "below").otherwise("inside")),
        ("Volatility(20)", F.col("volatility_20"), None, None, F.lit("")),
        ("Daily / Log return", ret, "log_return", None, sign),
        ("Drawdown", F.col("drawdown"), None, None, F.lit("down")),
        ("Volume / OBV", F.col("volume_change"), "obv", None, F.when(F.col("volume_change") > 0, "up").otherwise("level")),
        ("Change points", F.col("up") + F.col("down"), "up", "down", F.lit("")),
    )
    number = lambda c: (F.lit(None) if c is None else F.col(c)).cast("double")
    rows = [F.struct(F.lit(k).alias("place"), F.lit(name).alias("card"), value.cast("double").alias("value"), number(one).alias("beside"), number(two).alias("beside_2"), state.alias("state")) for k, (name, value, one, two, state) in enumerate(cards, 1)]
    return s.select("symbol", "date", F.explode(F.array(*rows)).alias("c")).select("symbol", "date", "c.*")


_AMOUNTS = "(select event_id, case when event_id % 9 = 0 then null else (value - 40) * pow(10.0::double, event_id % 9) * 1.00001370123457 end as n from events)"


@query(f"""select event_id, case when n is null then '—' when abs(n) >= 1e9 then printf('%.2f', n / 1e9) || 'B' when abs(n) >= 1e6 then printf('%.2f', n / 1e6) || 'M' when abs(n) >= 1e3 then printf('%.1f', n / 1e3) || 'K' else printf('%.0f', n) end as big,
  case when n is null then '—' else printf('%.3f', n / 123456789) end as plain, case when n is null then '—' else printf('%.2f', n / 123456789 * 100) || '%' end as percent from {_AMOUNTS}""")
def humanised_numbers(spark, sf_dir):
    """Amounts of any sign and size as people read them; a dash for none."""
    n = F.when(F.col("event_id") % 9 != 0, (F.col("value") - 40) * F.pow(F.lit(10.0), F.col("event_id") % 9) * 1.00001370123457)
    return table(spark, sf_dir, "events").select("event_id", n.alias("n"), (n / 123456789).alias("share")).select("event_id", numbers.big("n").alias("big"), numbers.plain("share", 3).alias("plain"), numbers.percent("share").alias("percent"))


_FINANCE = """fin as (select o_orderkey, any_value(o_custkey) as o_custkey, any_value(o_orderdate) as o_orderdate, any_value(o_orderstatus) as o_orderstatus, any_value(o_totalprice) as o_totalprice, round(coalesce(sum(l_extendedprice), 0), 2) as gross, round(coalesce(sum(case when l_returnflag = 'R' then l_extendedprice end), 0), 2) as returned,
  round(coalesce(sum(l_extendedprice), 0) - coalesce(sum(case when l_returnflag = 'R' then l_extendedprice end), 0), 2) as net from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)"""


def finance(spark, sf_dir) -> DataFrame:
    """A row per order with its lines' sums. Lines are summed by order before the join, so that it is one to one."""
    price = F.col("l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(price).alias("g"), F.sum(F.when(F.col("l_returnflag") == "R", price)).alias("r"))
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    g, r = F.coalesce("g", F.lit(0.0)), F.coalesce("r", F.lit(0.0))
    return rows.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice", F.round(g, 2).alias("gross"), F.round(r, 2).alias("returned"), F.round(g - r, 2).alias("net"))


@query(f"with {_FINANCE} select o_orderkey, gross, returned, net from fin")
def order_finance(spark, sf_dir):
    return finance(spark, sf_dir).select("o_orderkey", "gross", "returned", "net")


@query("select cast(date_trunc('month', o_orderdate) as date) as month, o_orderstatus as status, count(*) as total_orders from orders group by 1, 2")
def orders_by_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("total_orders"))


@query(f"with {_FINANCE} select round(sum(gross), 2) as gross, round(sum(returned), 2) as returned, round(sum(net), 2) as net from fin where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'")
def finance_totals(spark, sf_dir):
    """Totals of a half-open period, for all customers or one."""
    finance(spark, sf_dir).createOrReplaceTempView("order_finance_rows")
    return spark.sql("""select round(sum(gross), 2) as gross, round(sum(returned), 2) as returned, round(sum(net), 2) as net from order_finance_rows
      where o_orderdate >= :since and o_orderdate < :until and (:customer is null or o_custkey = :customer)""", args={"since": "1996-01-01", "until": "1997-01-01", "customer": None})


@query("select c_custkey, c_name, round(sum(o_totalprice), 2) as revenue from orders join customer on c_custkey = o_custkey group by 1, 2 order by revenue desc, c_custkey limit 10")
def ranking_top10(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    return totals.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").orderBy(F.desc("revenue"), "c_custkey").limit(10).select("c_custkey", "c_name", "revenue")


@query("select s_suppkey, s_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as total_cost from lineitem join supplier on s_suppkey = l_suppkey where l_shipdate >= timestamp '1996-03-01' and l_shipdate < timestamp '1996-04-01' group by 1, 2")
def cost_by_supplier(spark, sf_dir):
    month = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz '1996-03-01' and l_shipdate < timestamp_ntz '1996-04-01'")
    costs = month.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("total_cost"))
    return costs.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("s_suppkey", "s_name", "total_cost")


@query("select cast(0 as bigint) as missing, cast(0 as bigint) as unexpected, count(*) as compared from orders")
def mv_reconcile(spark, sf_dir):
    """The summed view against a direct query: differences both ways, and rows compared."""
    view = finance(spark, sf_dir).select("o_orderkey", F.round("gross", 1).alias("gross"))
    direct = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.round(F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)), 2), 1).alias("gross"))
    return view.exceptAll(direct).agg(F.count("*").alias("missing")).join(direct.exceptAll(view).agg(F.count("*").alias("unexpected"))).join(view.agg(F.count("*").alias("compared")))


@query("""with d as (select l_linenumber, cast(l_extendedprice as decimal(15, 2)) as base, cast(l_tax as decimal(5, 2)) as rate from lineitem)
  select l_linenumber, count(*) filter (where round(base * (1 + rate), 2) = base + round(base * rate, 2)) as ok, count(*) as n from d group by 1""")
def tax_check(spark, sf_dir):
    """Amounts after tax against base and tax, in decimals."""
    d = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_extendedprice").cast("decimal(15,2)").alias("base"), F.col("l_tax").cast("decimal(5,2)").alias("rate"))
    return d.groupBy("l_linenumber").agg(F.count_if(F.round(F.col("base") * (1 + F.col("rate")), 2) == F.col("base") + F.round(F.col("base") * F.col("rate"), 2)).alias("ok"), F.count("*").alias("n"))


@query("select o_orderkey, 'ORD' || strftime(o_orderdate, '%y%m%d') || lpad(cast(o_orderkey % 10000 as varchar), 4, '0') as code from orders")
def order_codes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("ORD"), F.date_format("o_orderdate", "yyMMdd"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")).alias("code"))


@query("""select page_id, case when p1 <> '' then 'host' when p2 <> '' then 'path' else 'other' end as tier, case when p1 <> '' then p1 when p2 <> '' then p2 end as entity from (select page_id, regexp_extract(url, '//(?:www|m)\\.([a-z]+)', 1) as p1, regexp_extract(url, '/(en|fr|de|es)/', 1) as p2 from pages)""")
def tier_classification(spark, sf_dir):
    """The first pass that finds something decides."""
    p1, p2 = F.regexp_extract("url", r"//(?:www|m)\.([a-z]+)", 1), F.regexp_extract("url", "/(en|fr|de|es)/", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.when(p1 != "", "host").when(p2 != "", "path").otherwise("other").alias("tier"), F.when(p1 != "", p1).when(p2 != "", p2).alias("entity"))
