"""Time-driven operators over the event table."""

from pyspark.sql import functions as F

from folioscope.plans import twins
from folioscope.streaming import jobs


def _events(spark, d):
    return twins.table(spark, d, "events")


def _rate_limit(spark, d, **limits):
    requests = _events(spark, d).select(F.col("user_id").alias("visitor"), F.col("event_id").alias("request_id"), F.col("ts").alias("at"))
    out = jobs.rate_limit(requests, **limits)
    return out.select("visitor", "request_id", F.col("allowed").cast("int").alias("allowed"))


def rate_limit_sliding(spark, d):
    return _rate_limit(spark, d)


def rate_limit_sparse(spark, d):
    """Two a day: the events are so sparse that ten a minute are never reached."""
    return _rate_limit(spark, d, limit=2, seconds=86400)


def _stale_runs(spark, d, minutes):
    e = _events(spark, d)
    starts = e.where("event_type = 'view'").select(F.col("user_id").alias("run_id"), F.col("ts").alias("started_at"), "event_id")
    finishes = e.where("event_type IN ('click', 'purchase')").select(F.col("user_id").alias("finished_run"), F.col("ts").alias("finished_at"))
    return jobs.abandoned_runs(starts, finishes, minutes).select("event_id", F.col("run_id").alias("user_id"))


def stale_runs(spark, d):
    return _stale_runs(spark, d, 15)


def stale_runs_sparse(spark, d):
    return _stale_runs(spark, d, 600)


def _quota_backoff(spark, d, minutes):
    e = _events(spark, d)
    requests = e.where("event_type = 'view'").select(F.col("user_id").alias("company_id"), "event_id", F.col("ts").alias("at"))
    failures = e.where("event_type = 'error'").select(F.col("user_id").alias("company_id"), F.col("ts").alias("failed_at"))
    return jobs.backing_off(requests, failures, minutes).select("event_id", F.col("backing_off").cast("int").alias("backing_off"))


def quota_backoff(spark, d):
    return _quota_backoff(spark, d, 30)


def quota_backoff_sparse(spark, d):
    return _quota_backoff(spark, d, 720)


def latest_event_upsert(spark, d):
    e = _events(spark, d).select("user_id", "event_type", F.col("ts").alias("filing_date"), F.col("event_id").alias("fact_id"), "value")
    old, new = e.where("filing_date < '2024-01-20'"), e.where("filing_date >= '2024-01-15'")
    return jobs.latest_upsert(old, new, ["user_id", "event_type"]).select("user_id", "event_type", "fact_id", "value")


QUERIES = {f.__name__: f for f in [rate_limit_sliding, rate_limit_sparse, stale_runs, stale_runs_sparse, quota_backoff, quota_backoff_sparse,
                                   latest_event_upsert]}


def _rate_limit_sql(limit, micros):
    return f"""
        WITH RECURSIVE numbered AS (
            SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        walk AS (
            SELECT user_id, event_id, n, [t] AS times, 1 AS allowed FROM numbered WHERE n = 1
            UNION ALL
            SELECT x.user_id, x.event_id, x.n,
                   CASE WHEN len(list_filter(w.times, lambda p: x.t - p < {micros})) < {limit}
                        THEN list_append(list_filter(w.times, lambda p: x.t - p < {micros}), x.t)
                        ELSE list_filter(w.times, lambda p: x.t - p < {micros}) END,
                   (len(list_filter(w.times, lambda p: x.t - p < {micros})) < {limit})::int
            FROM walk AS w JOIN numbered AS x ON x.user_id = w.user_id AND x.n = w.n + 1)
        SELECT user_id AS visitor, event_id AS request_id, allowed FROM walk"""


def _stale_sql(minutes):
    return f"""
        SELECT event_id, user_id FROM events AS s WHERE event_type = 'view' AND NOT EXISTS (
            SELECT 1 FROM events AS f WHERE f.user_id = s.user_id AND f.event_type IN ('click', 'purchase')
            AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL {minutes} MINUTE)"""


def _backoff_sql(minutes):
    return f"""
        SELECT event_id, EXISTS (SELECT 1 FROM events AS f WHERE f.user_id = r.user_id AND f.event_type = 'error'
               AND f.ts < r.ts AND f.ts > r.ts - INTERVAL {minutes} MINUTE)::int AS backing_off
        FROM events AS r WHERE event_type = 'view'"""


ORACLES = {
    "rate_limit_sliding": _rate_limit_sql(10, 60_000_000), "rate_limit_sparse": _rate_limit_sql(2, 86_400_000_000),
    "stale_runs": _stale_sql(15), "stale_runs_sparse": _stale_sql(600),
    "quota_backoff": _backoff_sql(30), "quota_backoff_sparse": _backoff_sql(720),
    "latest_event_upsert": """
        SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS fact_id, max_by(value, (ts, event_id)) AS value
        FROM events GROUP BY ALL""",
}
