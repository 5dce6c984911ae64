"""Streaming queries, each against its batch equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.shared import shared_dir
from tidegauge.streaming import incremental, ordered, runlog

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


#: Hours, and sessions, that end before the watermark of the stream's last events.
_CUT = "(select max(ts) - interval 1 hour from events)"


@query(f"""select event_type as symbol, date_trunc('hour', ts) as hour, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*) as volume
  from events group by 1, 2 having date_trunc('hour', any_value(ts)) + interval 1 hour <= {_CUT}""")
def stream_hourly_bars(spark, sf_dir):
    out = incremental.drained(incremental.hourly_bars(incremental.source(spark, sf_dir)))
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("select event_id, event_type, value from events")
def stream_dedup(spark, sf_dir):
    """The stream delivered twice, each event once."""
    once = incremental.source(spark, sf_dir)
    return incremental.drained(incremental.first_seen(once.union(once))).select("event_id", "event_type", "value")


@query("""with d as (select event_type as symbol, cast(ts as date) as date, arg_max(value, (ts, event_id)) as close, count(*) as n from events group by 1, 2)
  select symbol, date, close, n, case when count(close) over w = 5 then round(avg(close) over w, 6) end as ma_5 from d window w as (partition by symbol order by date rows 4 preceding)""")
def stream_incremental_indicators(spark, sf_dir):
    return incremental.incremental_indicators(spark, sf_dir)


@query(f"""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
  select user_id, min(ts) as start, max(ts) + interval 2 hour as "end", count(*) as events from s group by user_id, k having max(ts) + interval 2 hour <= {_CUT}""")
def stream_sessions(spark, sf_dir):
    out = incremental.drained(incremental.sessions(incremental.source(spark, sf_dir)))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


#: Share of a new value in the streamed mean; rows after which older ones don't show in a double any more.
ALPHA, REACH = 2 / 13, 240


@query(f"""with e as (select event_type as symbol, event_id, ts, value, list(value) over w as l, row_number() over (partition by event_type order by ts, event_id) as rn from events window w as (partition by event_type order by ts, event_id rows {REACH - 1} preceding))
  select symbol, event_id, ts, round(list_sum(list_transform(l, lambda x, i: x * (1 - {ALPHA}::double) ** (len(l) - i) * case when i = 1 and rn = len(l) then 1 else {ALPHA}::double end)), 6) as mean
  from e where date_trunc('hour', ts) + interval 1 hour <= {_CUT}""")
def stream_ewm(spark, sf_dir):
    """The mean of each type's values in the order of event time, by keyed state."""
    rows = incremental.stateful(spark, ordered.PROVIDER, lambda: incremental.drained(ordered.ordered_means(incremental.source(spark, sf_dir), ALPHA)))
    return rows.select("symbol", "event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), F.round("mean", 6).alias("mean"))


@query("select 'finished' as state, count(*) as input_rows from events union all select 'finished', 0")
def stream_run_log(spark, sf_dir):
    """What two runs of a stream did, as the engine reports it: the second one finds nothing new."""
    path, at = shared_dir(spark), shared_dir(spark)
    run = lambda: incremental.drained(incremental.source(spark, sf_dir), each=lambda rows, _: rows.write.format("noop").mode("overwrite").save(), checkpoint=at)
    runlog.logged(spark, run, path)
    return runlog.logged(spark, run, path).select("state", "input_rows")
