"""Event-time queries: as batches here; tests run the same functions as streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.sources.tables import load
from quillon.streaming import events as E


def events(spark, sf):
    return load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("str_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf):
    return _ntz(E.tumbling(events(spark, sf)), "start")


@query("str_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS start FROM events) GROUP BY 1")
def sliding(spark, sf):
    return _ntz(E.sliding(events(spark, sf)), "start")


@query("str_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS n FROM k GROUP BY user_id, sid""")
def sessions(spark, sf):
    return _ntz(E.sessions(events(spark, sf)), "start", "end")


@query("str_running_user_totals", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running FROM events")
def running_user_totals(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf, "events").select("event_id", F.round(F.sum("value").over(w), 2).alias("running"))
