"""Events against news in a window of days around them: matches, permutation test, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ranks import placed, shuffled
from tidegauge.shared import written
from tidegauge.sources.adapters import MARKET

# Days before and after an event that count.
BEFORE, AFTER = 3, 1


def event_window(events: DataFrame, news: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """Rows of ``news`` (symbol, date, ...) of the event's symbol, or of the whole market, on the days around it.

    ``events`` (symbol, date, ...) are spread over their days and both symbols, so
    that the range becomes an equi-join that shuffles or broadcasts as any other.
    """
    days = F.explode(F.sequence(F.date_sub("event_date", before), F.date_add("event_date", after)))
    spread = events.withColumnRenamed("symbol", "event_symbol").withColumnRenamed("date", "event_date").withColumn("date", days)
    spread = spread.withColumn("symbol", F.explode(F.array_distinct(F.array("event_symbol", F.lit(MARKET)))))
    return spread.join(news, ["symbol", "date"])


def matches(events: DataFrame, news: DataFrame) -> DataFrame:
    """(symbol, date, direction, n_news, mean_score, covered, has_signal, match) of each event (symbol, date, direction)."""
    found = event_window(events.select("symbol", "date"), news.select("symbol", "date", "score")).groupBy(F.col("event_symbol").alias("symbol"), F.col("event_date").alias("date")).agg(F.count("*").alias("n_news"), F.avg("score").alias("mean_score"))
    rows = events.join(found, ["symbol", "date"], "left").withColumn("n_news", F.coalesce("n_news", F.lit(0)))
    signal = F.coalesce(F.round("mean_score", 9) != 0, F.lit(False))
    return rows.select("symbol", "date", "direction", "n_news", "mean_score", (F.col("n_news") > 0).alias("covered"), signal.alias("has_signal"), (signal & (F.signum("mean_score") == F.col("direction"))).alias("match"))


def summary(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, coverage and match rate; the rate is null without signals."""
    counted = matched.groupBy(*keys).agg(F.count("*").alias("n_cp"), F.count_if("covered").alias("n_covered"), F.count_if("has_signal").alias("n_with_signal"), F.count_if("match").alias("n_match"))
    return counted.withColumn("coverage", F.round(F.try_divide(F.col("n_covered"), F.col("n_cp")), 3)).withColumn("match_rate", F.round(F.try_divide(F.col("n_match"), F.col("n_with_signal")), 3))


def permutation_rates(events: DataFrame, news: DataFrame, repeats: int) -> DataFrame:
    """(perm, rate): match rates after the dates of news are dealt anew among them, ``repeats`` times.

    ``news`` has news_id, symbol, date and score; all rows of an article move
    together. Articles have places in the order of their ids; the date of the
    article at place j goes to the one at the place to which repeat ``perm`` moves
    j. Only dates near an event are dealt: the others reach none. A repeat without
    signals has rate 0.
    """
    articles = placed(news.groupBy("news_id").agg(F.min("date").alias("date")), "news_id")
    places = written(articles.select("news_id", "date", "place"))
    days = events.select(F.explode(F.sequence(F.date_sub("date", BEFORE), F.date_add("date", AFTER))).alias("date")).distinct()
    near = places.join(days, "date", "left_semi").select("place", "date", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("perm"))
    rows = written(news.select("news_id", "symbol", "score").join(places.select("news_id", "place"), "news_id").drop("news_id"))
    moved = near.withColumn("place", shuffled(F.col("place"), F.col("perm"), F.lit(places.count()))).join(rows, "place")
    found = event_window(events.select("symbol", "date", "direction"), moved).groupBy("perm", "event_symbol", "event_date", "direction").agg(F.round(F.avg("score"), 9).alias("m"))
    rates = found.where("m <> 0").groupBy("perm").agg(F.avg((F.signum("m") == F.col("direction")).cast("double")).alias("rate"))
    deals = news.sparkSession.range(1, repeats + 1).select(F.col("id").cast("int").alias("perm"))
    return deals.join(rates, "perm", "left").select("perm", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def p_values(rates: DataFrame, observed: DataFrame) -> DataFrame:
    """One- and two-sided p-values of one ``observed`` (rate) row against the null rates."""
    null = rates.agg(F.avg("rate").alias("null_mean"), F.stddev_pop("rate").alias("null_std"))
    rows = rates.join(F.broadcast(null)).join(F.broadcast(observed.select(F.col("rate").alias("observed"))))
    gap = F.abs(F.col("rate") - F.col("null_mean")) >= F.abs(F.col("observed") - F.col("null_mean")) - 1e-12
    return rows.groupBy("observed", "null_mean", "null_std").agg(F.avg((F.col("rate") >= F.col("observed") - 1e-12).cast("double")).alias("p_one_sided"), F.avg(gap.cast("double")).alias("p_two_sided"))


def bootstrap(matched: DataFrame, repeats: int, key: list[str]) -> DataFrame:
    """(low, high): percentile interval of the match rate over resampled events with a signal; 0 and 0 without any.

    Each of the n draws of a repeat takes the event whose place is a digest of
    (repeat, draw) modulo n: an equi-join on places.
    """
    signals = placed(matched.where("has_signal").select(*key, F.col("match").cast("double").alias("m")), *key)
    signals = signals.select((F.col("place") + 1).cast("int").alias("place"), "m")
    n = signals.agg(F.count("*").alias("n"))
    draws = signals.select(F.col("place").alias("draw")).join(F.broadcast(n)).withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    h = F.conv(F.substring(F.md5(F.concat(F.col("boot").cast("string"), F.lit(":"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    rates = draws.select("boot", (h % F.col("n") + 1).cast("int").alias("place")).join(signals, "place").groupBy("boot").agg(F.avg("m").alias("rate"))
    bounds = rates.agg(F.percentile("rate", F.array(F.lit(0.025), F.lit(0.975))).alias("b"))
    return bounds.select(F.coalesce(F.col("b")[0], F.lit(0.0)).alias("low"), F.coalesce(F.col("b")[1], F.lit(0.0)).alias("high"))


def study(events: DataFrame, news: DataFrame, repeats: int) -> DataFrame:
    """The whole study of events (symbol, date, direction) and news in one row: counts, rates, p-values and interval."""
    matched = written(matches(events.select("symbol", "date", "direction"), news))
    observed = matched.agg(F.try_divide(F.count_if("match").cast("double"), F.count_if("has_signal")).alias("rate"))
    p = p_values(permutation_rates(events, news, repeats), observed)
    return summary(matched, []).join(F.broadcast(p)).join(F.broadcast(bootstrap(matched, repeats, ["symbol", "date"])))
