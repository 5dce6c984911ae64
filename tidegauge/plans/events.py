"""Daily sentiment, change points, and their association."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions.windows import W, log_change
from tidegauge.functions import tails
from tidegauge.operators import association, changepoint, ranks
from tidegauge.shared import written
from tidegauge.sources.adapters import BARS, MARKET, NEWS, bars, news

QUERIES: dict[str, tuple] = {}
REPEATS = 1000
EVERY = 60
#: Penalty factor of the registered queries over detected points. At the usual 0.5 the driver's returns, which revert at once, have none.
PENALTY = 0.2


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def daily(n):
    return n.groupBy("symbol", "date").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n_news"))


_DAILY = f"{NEWS}, daily as (select symbol, date, avg(score) as mean_score, count(*) as n_news from news group by 1, 2)"


@query(f"with {_DAILY} select symbol, date, round(mean_score, 6) as mean_score, n_news from daily")
def daily_sentiment(spark, sf_dir):
    return daily(news(spark, sf_dir)).select("symbol", "date", F.round("mean_score", 6).alias("mean_score"), "n_news")


#: The days of one symbol are those of the symbol and of the whole market.
SYMBOL = "1-URGENT"
_OF_SYMBOL = f"symbol in ('{SYMBOL}', '{MARKET}')"


@query(f"with {_DAILY} select date, round(sum(coalesce(mean_score, 0) * case when n_news is null or n_news = 0 then 1 else n_news end) / sum(case when n_news is null or n_news = 0 then 1 else n_news end), 6) as weighted from daily where {_OF_SYMBOL} group by date")
def weighted_daily_sentiment(spark, sf_dir):
    weight = F.when(F.coalesce("n_news", F.lit(0)) == 0, 1).otherwise(F.col("n_news"))
    return daily(news(spark, sf_dir)).where(_OF_SYMBOL).groupBy("date").agg(F.round(F.sum(F.coalesce("mean_score", F.lit(0.0)) * weight) / F.sum(weight), 6).alias("weighted"))


@query(f"with {_DAILY} select date, round(avg(mean_score), 6) as mean_of_means from daily where {_OF_SYMBOL} group by date")
def mean_of_means(spark, sf_dir):
    return daily(news(spark, sf_dir)).where(_OF_SYMBOL).groupBy("date").agg(F.round(F.avg("mean_score"), 6).alias("mean_of_means"))


def _moving(spark, sf_dir, n: int, least: int):
    day = daily(news(spark, sf_dir)).select("symbol", "date", "mean_score")
    w = W().rowsBetween(-(n - 1), 0)
    value = F.when(F.count("mean_score").over(w) >= least, F.avg("mean_score").over(w))
    return bars(spark, sf_dir).select("symbol", "date").join(day, ["symbol", "date"], "left").select("symbol", "date", F.round(value, 6).alias("ma"))


def _moving_sql(n: int, least: int) -> str:
    return f"with {BARS}, {_DAILY} select b.symbol, b.date, case when count(mean_score) over w >= {least} then round(avg(mean_score) over w, 6) end as ma from bars b left join daily d on b.symbol = d.symbol and b.date = d.date window w as (partition by b.symbol order by b.date rows {n - 1} preceding)"


@query(_moving_sql(10, 3))
def sentiment_ma10(spark, sf_dir):
    return _moving(spark, sf_dir, 10, 3)


@query(_moving_sql(20, 5))
def sentiment_ma20(spark, sf_dir):
    return _moving(spark, sf_dir, 20, 5)


def _changes(spark, sf_dir):
    """Every 60th bar as an event, with the change of mean log returns around it."""
    lr = bars(spark, sf_dir).select("symbol", "date", log_change(F.col("close")).alias("lr")).where("lr is not null")
    after, before = F.avg("lr").over(W().rowsBetween(0, 19)), F.avg("lr").over(W().rowsBetween(-20, -1))
    rows = lr.select("symbol", "date", (F.row_number().over(W()) - 1).alias("place"), (after - before).alias("gap"))
    return rows.where((F.col("place") > 0) & (F.col("place") % EVERY == 0)).select("symbol", "date", F.when(F.col("gap") > 0, 1).otherwise(-1).alias("direction"), F.round(F.abs("gap"), 6).alias("magnitude"))


_CHANGES = f"""{BARS}, lr as (select * from (select symbol, date, ln(close / nullif(lag(close) over (partition by symbol order by date), 0)) as lr from bars) where lr is not null),
  gaps as (select symbol, date, row_number() over w - 1 as place, avg(lr) over (partition by symbol order by date rows between current row and 19 following) - avg(lr) over (partition by symbol order by date rows between 20 preceding and 1 preceding) as gap from lr window w as (partition by symbol order by date)),
  cp as (select symbol, date, case when gap > 0 then 1 else -1 end as direction, round(abs(gap), 6) as magnitude from gaps where place > 0 and place % {EVERY} = 0)"""


@query(f"with {_CHANGES} select * from cp")
def cp_direction_magnitude(spark, sf_dir):
    return _changes(spark, sf_dir)


@query(f"with {_CHANGES}, n as (select symbol, count(*) as n, count(*) filter (where direction = 1) as up from cp group by symbol) select round(avg(n), 6) as mean_n, min(n) as min_n, max(n) as max_n, median(n) as median_n, cast(sum(up) as bigint) as up, cast(sum(n - up) as bigint) as down, (select round(avg(magnitude), 6) from cp) as mean_magnitude, (select max(magnitude) from cp) as max_magnitude from n")
def cp_stats(spark, sf_dir):
    per = _changes(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("direction") == 1).alias("up"), F.sum("magnitude").alias("m"), F.max("magnitude").alias("most"))
    return per.agg(F.round(F.avg("n"), 6).alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.percentile("n", F.lit(0.5)).alias("median_n"), F.sum("up").alias("up"), F.sum(F.col("n") - F.col("up")).alias("down"), F.round(F.sum("m") / F.sum("n"), 6).alias("mean_magnitude"), F.max("most").alias("max_magnitude"))


@query(f"with {_CHANGES} select cast(year(date) as integer) as year, count(*) filter (where direction = 1) as up, count(*) filter (where direction = -1) as down from cp group by 1")
def cp_by_year(spark, sf_dir):
    return _changes(spark, sf_dir).groupBy(F.year("date").alias("year")).agg(F.count_if(F.col("direction") == 1).alias("up"), F.count_if(F.col("direction") == -1).alias("down"))


@query(f"with {_CHANGES} select symbol, date, magnitude from cp order by magnitude desc, symbol, date limit 5")
def top_cp(spark, sf_dir):
    return _changes(spark, sf_dir).select("symbol", "date", "magnitude").orderBy(F.desc("magnitude"), "symbol", "date").limit(5)


@query(None)
def pelt_change_points(spark, sf_dir):
    """Change points of daily log returns, with direction and magnitude."""
    points = _detected(spark, sf_dir).withColumnRenamed("date", "change_point_date")
    return points.withColumn("direction", F.col("direction").cast("short"))


def _detected(spark, sf_dir):
    return changepoint.detected(bars(spark, sf_dir).select("symbol", "date", log_change(F.col("close")).alias("value")), penalty=PENALTY)


@query(None)
def detected_association(spark, sf_dir):
    """The association study over detected change points: matches, permutation test and interval."""
    return association.study(_detected(spark, sf_dir), news(spark, sf_dir), REPEATS)


_JOINED = f"{_CHANGES}, {NEWS}, ev as (select cp.symbol as event_symbol, cp.date as event_date, direction, news_id, n.symbol, n.date, n.score from cp join news n on n.symbol in (cp.symbol, '{MARKET}') and n.date between cast(cp.date - 3 as date) and cast(cp.date + 1 as date))"


@query(f"with {_JOINED} select event_symbol, event_date, symbol, date, news_id, score from ev")
def event_window_join(spark, sf_dir):
    found = association.event_window(_changes(spark, sf_dir).select("symbol", "date"), news(spark, sf_dir).select("news_id", "symbol", "date", "score"))
    return found.select("event_symbol", "event_date", "symbol", "date", "news_id", "score")


_MATCHED = f"""{_JOINED}, mm as (select event_symbol, event_date, count(*) as n_news, avg(score) as mean_score from ev group by 1, 2),
  matched as (select cp.symbol, cp.date, cp.direction, coalesce(n_news, 0) as n_news, mean_score, coalesce(n_news, 0) > 0 as covered, coalesce(round(mean_score, 9) <> 0, false) as has_signal,
    coalesce(round(mean_score, 9) <> 0 and sign(mean_score) = cp.direction, false) as match from cp left join mm on event_symbol = cp.symbol and event_date = cp.date)"""


def _matched(spark, sf_dir):
    return association.matches(_changes(spark, sf_dir).select("symbol", "date", "direction"), news(spark, sf_dir))


@query(f"with {_MATCHED} select symbol, date, direction, n_news, round(mean_score, 6) as mean_score, covered, has_signal, match from matched")
def match_per_cp(spark, sf_dir):
    return _matched(spark, sf_dir).withColumn("mean_score", F.round("mean_score", 6))


_SUMMARY = "count(*) as n_cp, count(*) filter (where covered) as n_covered, round(count(*) filter (where covered) / nullif(count(*), 0)::double, 3) as coverage, count(*) filter (where has_signal) as n_with_signal, count(*) filter (where match) as n_match, round(count(*) filter (where match) / nullif(count(*) filter (where has_signal), 0)::double, 3) as match_rate"


@query(f"with {_MATCHED} select symbol, {_SUMMARY} from matched group by symbol")
def correlation_summary(spark, sf_dir):
    return association.summary(_matched(spark, sf_dir), ["symbol"])


@query(f"with {_MATCHED} select {_SUMMARY} from matched")
def correlation_totals(spark, sf_dir):
    return association.summary(_matched(spark, sf_dir), [])


_NULL = f"""{_MATCHED}, art as (select news_id, min(date) as date from news group by news_id), seat as (select news_id, date, row_number() over (order by news_id) - 1 as place, (select count(*) from art) as n from art),
  deal as (select p.perm, a.place, a.date, a.n from seat a, (select unnest(range(1, {REPEATS} + 1)) as perm) p),
  dealt as (select m.perm, a.news_id, m.date from {ranks.shuffled_sql("deal", "place", "perm", "n")} m join seat a using (place)),
  mv as (select d.perm, n.symbol, d.date, n.score from dealt d join news n using (news_id)),
  pr as (select perm, cp.symbol, cp.date, cp.direction, round(avg(score), 9) as m from mv join cp on mv.symbol in (cp.symbol, '{MARKET}') and mv.date between cast(cp.date - 3 as date) and cast(cp.date + 1 as date) group by 1, 2, 3, 4),
  rates as (select p.perm, coalesce(r.rate, 0) as rate from (select unnest(range(1, {REPEATS} + 1)) as perm) p left join (select perm, avg(case when sign(m) = direction then 1.0::double else 0 end) as rate from pr where m <> 0 group by perm) r using (perm))"""


def _rates(spark, sf_dir):
    return association.permutation_rates(_changes(spark, sf_dir), news(spark, sf_dir), REPEATS)


@query(f"with {_NULL} select cast(perm as integer) as perm, round(rate, 6) as rate from rates")
def permutation_null(spark, sf_dir):
    """The rates of all permutations, stored as a table that later runs can read."""
    return written(_rates(spark, sf_dir).withColumn("rate", F.round("rate", 6)))


@query(f"""with {_NULL}, o as (select count(*) filter (where match) / nullif(count(*) filter (where has_signal), 0)::double as observed from matched), z as (select avg(rate) as null_mean, stddev_pop(rate) as null_std from rates)
  select round(observed, 6) as observed, round(null_mean, 6) as null_mean, round(null_std, 6) as null_std, round(avg(case when rate >= observed - 1e-12 then 1.0::double else 0 end), 6) as p_one_sided,
  round(avg(case when abs(rate - null_mean) >= abs(observed - null_mean) - 1e-12 then 1.0::double else 0 end), 6) as p_two_sided from rates, o, z group by observed, null_mean, null_std""")
def permutation_p(spark, sf_dir):
    observed = _matched(spark, sf_dir).agg(F.try_divide(F.count_if("match").cast("double"), F.count_if("has_signal")).alias("rate"))
    p = association.p_values(_rates(spark, sf_dir), observed)
    return p.select(*[F.round(c, 6).alias(c) for c in p.columns])


@query(f"""with {_MATCHED}, sg as (select row_number() over (order by symbol, date) as place, case when match then 1.0::double else 0 end as m from matched where has_signal), n as (select count(*) as n from sg),
  dr as (select boot, ('0x' || substr(md5(boot || ':' || place), 1, 8))::bigint % n.n + 1 as place from sg, n, (select unnest(range(1, {REPEATS} + 1)) as boot)), r as (select boot, avg(m) as rate from dr join sg using (place) group by boot)
  select round(coalesce(quantile_cont(rate, 0.025), 0), 6) as low, round(coalesce(quantile_cont(rate, 0.975), 0), 6) as high from r""")
def bootstrap_ci(spark, sf_dir):
    b = association.bootstrap(_matched(spark, sf_dir), REPEATS, ["symbol", "date"])
    return b.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_PAIRS = f"""{BARS}, {_DAILY}, ret as (select symbol, date, close / nullif(lag(close) over (partition by symbol order by date), 0) - 1 as ret, lead(close) over (partition by symbol order by date) / nullif(close, 0) - 1 as next_ret from bars),
  pairs as (select r.symbol, d.mean_score as s, r.ret, r.next_ret from ret r join daily d using (symbol, date) where ret is not null and next_ret is not null)"""


def _pairs(spark, sf_dir):
    c = F.col("close")
    ret = bars(spark, sf_dir).select("symbol", "date", (F.try_divide(c, F.lag(c).over(W())) - 1).alias("ret"), (F.try_divide(F.lead(c).over(W()), c) - 1).alias("next_ret"))
    return ret.join(daily(news(spark, sf_dir)), ["symbol", "date"]).where("ret is not null and next_ret is not null").select("symbol", F.col("mean_score").alias("s"), "ret", "next_ret")


@query(f"""with {_PAIRS}, rk as (select symbol, s, ret, next_ret, rank() over (partition by symbol order by s) + (count(*) over (partition by symbol, s) - 1) / 2.0::double as rs, rank() over (partition by symbol order by ret) + (count(*) over (partition by symbol, ret) - 1) / 2.0::double as rr,
    rank() over (partition by symbol order by next_ret) + (count(*) over (partition by symbol, next_ret) - 1) / 2.0::double as rn from pairs)
  select symbol, count(*) as n, round(corr(s, ret), 6) as pearson_0, round(corr(s, next_ret), 6) as pearson_1, round(corr(rs, rr), 6) as spearman_0, round(corr(rs, rn), 6) as spearman_1 from rk group by symbol""")
def spearman_lag(spark, sf_dir):
    """Correlations of sentiment and return, of values and of mean ranks, on the day and the day after."""

    def mean_rank(c):
        return F.rank().over(Window.partitionBy("symbol").orderBy(c)) + (F.count("*").over(Window.partitionBy("symbol", c)) - 1) / 2

    rk = _pairs(spark, sf_dir).select("*", mean_rank("s").alias("rs"), mean_rank("ret").alias("rr"), mean_rank("next_ret").alias("rn"))
    return rk.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.corr("s", "ret"), 6).alias("pearson_0"), F.round(F.corr("s", "next_ret"), 6).alias("pearson_1"), F.round(F.corr("rs", "rr"), 6).alias("spearman_0"), F.round(F.corr("rs", "rn"), 6).alias("spearman_1"))


_WELCH = f"""{_PAIRS}, g as (select symbol, count(*) filter (where s > 0) as n1, count(*) filter (where s <= 0) as n2, avg(ret) filter (where s > 0) as m1, avg(ret) filter (where s <= 0) as m2, var_samp(ret) filter (where s > 0) as v1, var_samp(ret) filter (where s <= 0) as v2 from pairs group by symbol)"""


@query(f"with {_WELCH} select symbol, n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) as t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) as df from g")
def welch_t(spark, sf_dir):
    """Welch's t of returns on days of good and of other news."""
    good = F.col("s") > 0
    pick = lambda f, side: f(F.when(side, F.col("ret")))
    g = _pairs(spark, sf_dir).groupBy("symbol").agg(F.count_if(good).alias("n1"), F.count_if(~good).alias("n2"), pick(F.avg, good).alias("m1"), pick(F.avg, ~good).alias("m2"), pick(F.var_samp, good).alias("v1"), pick(F.var_samp, ~good).alias("v2"))
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    return g.select("symbol", "n1", "n2", F.round(F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(a + b)), 6).alias("t"), F.round(F.try_divide(F.pow(a + b, 2), F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n2") - 1)), 4).alias("df"))


@query(f"""with {_PAIRS}, rk as (select symbol, s, rank() over (partition by symbol order by ret) + (count(*) over (partition by symbol, ret) - 1) / 2.0::double as r from pairs)
  select symbol, round(sum(r) filter (where s > 0) - count(*) filter (where s > 0) * (count(*) filter (where s > 0) + 1) / 2.0::double, 4) as u from rk group by symbol""")
def mann_whitney(spark, sf_dir):
    r = F.rank().over(Window.partitionBy("symbol").orderBy("ret")) + (F.count("*").over(Window.partitionBy("symbol", "ret")) - 1) / 2
    rk = _pairs(spark, sf_dir).select("symbol", "s", r.alias("r"))
    n = F.count_if(F.col("s") > 0)
    return rk.groupBy("symbol").agg(F.round(F.sum(F.when(F.col("s") > 0, F.col("r"))) - n * (n + 1) / 2, 4).alias("u"))


@query("""with p as (select p_partkey, (p_partkey * 7919 % 1000 + 1) / 20000.0::double as p from part), r as (select *, row_number() over (order by p, p_partkey) as k, count(*) over () as m from p)
  select p_partkey, p, round(least(1, min(p * m / k) over (order by p, p_partkey rows between current row and unbounded following)), 9) as adjusted from r""")
def bh_adjusted(spark, sf_dir):
    """Benjamini-Hochberg adjusted p-values of a set of tests (one row per test)."""
    from tidegauge.sources.adapters import table

    p = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 7919 % 1000 + 1) / F.lit(20000.0)).alias("p"))
    return ranks.adjusted(p, "p", "p_partkey").select("p_partkey", "p", F.round("adjusted", 9).alias("adjusted"))


def _simpson(density: str, upto: str, steps: int = 2000) -> str:
    """The integral of a density (of x) from 0 to ``upto`` in SQL."""
    at = lambda i: density.replace("{x}", f"({upto} * {i} / {steps})")
    return f"({upto} / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i: (case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end) * {at('i')})))"


_T_DENSITY = "exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi())) * pow(1 + {x} * {x} / df, -(df + 1) / 2)"
_TESTS = f"""{_PAIRS}, g as (select symbol, count(*) filter (where s > 0)::double as n1, count(*) filter (where s <= 0)::double as n2, avg(ret) filter (where s > 0) as m1, avg(ret) filter (where s <= 0) as m2, var_samp(ret) filter (where s > 0) as v1, var_samp(ret) filter (where s <= 0) as v2, count(*)::double as n, corr(s, ret) as r0, corr(s, next_ret) as r1 from pairs group by symbol),
  welch as (select symbol, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) as t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) as df from g),
  ts as (select symbol, 'welch' as test, t, df from welch union all select symbol, 'pearson_0', r0 * sqrt((n - 2) / nullif(1 - r0 * r0, 0)), n - 2 from g union all select symbol, 'pearson_1', r1 * sqrt((n - 2) / nullif(1 - r1 * r1, 0)), n - 2 from g),
  rk as (select symbol, s, rank() over (partition by symbol order by ret) + (count(*) over (partition by symbol, ret) - 1) / 2.0::double as r from pairs), ties as (select symbol, sum(t * t * t - t) as ties from (select symbol, ret, count(*)::double as t from pairs group by 1, 2) group by 1),
  u as (select symbol, sum(r) filter (where s > 0) - count(*) filter (where s > 0) * (count(*) filter (where s > 0) + 1) / 2.0::double as u from rk group by symbol),
  zs as (select symbol, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / nullif(sqrt(n1 * n2 / 12 * (n + 1 - ties / nullif(n * (n - 1), 0))), 0) as z from u join g using (symbol) join ties using (symbol)),
  ps as (select symbol, test, t as statistic, 1 - 2 * {_simpson(_T_DENSITY, "abs(t)")} as p from ts where df > 0 and isfinite(df) and isfinite(t) union all select symbol, 'mann_whitney', z, 1 - 2 * {_simpson("exp(-{x} * {x} / 2) / sqrt(2 * pi())", "z")} from zs)"""


@query(f"""with {_TESTS}, r as (select *, row_number() over (order by p, symbol, test) as k, count(*) over () as m from ps where isfinite(p))
  select symbol, test, round(statistic, 6) as statistic, round(p, 8) as p, round(least(1, min(p * m / k) over (order by p, symbol, test rows between current row and unbounded following)), 8) as adjusted from r""")
def adjusted_tests(spark, sf_dir):
    """Four tests of sentiment against returns for each symbol: statistics, two-sided p-values, and these adjusted for their number."""
    pairs = written(_pairs(spark, sf_dir))
    good, n = F.col("s") > 0, F.col("n")
    pick = lambda f, side: f(F.when(side, F.col("ret")))
    g = pairs.groupBy("symbol").agg(
        F.count_if(good).cast("double").alias("n1"), F.count_if(~good).cast("double").alias("n2"), pick(F.avg, good).alias("m1"), pick(F.avg, ~good).alias("m2"), pick(F.var_samp, good).alias("v1"), pick(F.var_samp, ~good).alias("v2"),
        F.count("*").cast("double").alias("n"), F.corr("s", "ret").alias("r0"), F.corr("s", "next_ret").alias("r1"))
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    of_r = lambda r: r * F.sqrt(F.try_divide(n - 2, 1 - r * r))
    tests = [("welch", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(a + b)), F.try_divide(F.pow(a + b, 2), F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n2") - 1)))]
    tests += [(f"pearson_{k}", of_r(F.col(f"r{k}")), n - 2) for k in (0, 1)]
    ts = g.select("symbol", F.explode(F.array(*[F.struct(F.lit(name).alias("test"), t.alias("statistic"), df.alias("df")) for name, t, df in tests])).alias("x")).select("symbol", "x.*")
    ts = ts.select("symbol", "test", "statistic", tails.student(F.col("statistic"), F.col("df")).alias("p"))
    ties = pairs.groupBy("symbol", "ret").agg(F.count("*").cast("double").alias("t")).groupBy("symbol").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    zs = ranks_of(pairs).join(g, "symbol").join(ties, "symbol")
    spread = F.col("n1") * F.col("n2") / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5, F.lit(0.0)), F.sqrt(spread))
    zs = zs.select("symbol", F.lit("mann_whitney").alias("test"), z.alias("statistic")).withColumn("p", tails.normal(F.col("statistic")))
    named = ts.unionByName(zs).where(~F.isnan("p")).withColumn("name", F.concat_ws(":", "symbol", "test"))
    return ranks.adjusted(named, "p", "name").select("symbol", "test", F.round("statistic", 6).alias("statistic"), F.round("p", 8).alias("p"), F.round("adjusted", 8).alias("adjusted"))


def ranks_of(pairs):
    """(symbol, u): Mann and Whitney's statistic of the returns on days of good news."""
    r = F.rank().over(Window.partitionBy("symbol").orderBy("ret")) + (F.count("*").over(Window.partitionBy("symbol", "ret")) - 1) / 2
    n = F.count_if(F.col("s") > 0)
    return pairs.select("symbol", "s", r.alias("r")).groupBy("symbol").agg((F.sum(F.when(F.col("s") > 0, F.col("r"))) - n * (n + 1) / 2).alias("u"))
