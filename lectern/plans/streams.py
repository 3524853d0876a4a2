"""Queries of event streams, in batch and, where named so, run as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.registry import Tables, query
from lectern.session import shared_folder
from lectern.streaming import reading as R

_E = "WITH e AS (SELECT DISTINCT ON (event_id) * FROM events)"


def _events(t: Tables) -> DataFrame:
    return R.with_time(t.events)


@query("t1_sessions_30m", "WITH o AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events, round(sum(value), 6) AS total FROM s GROUP BY user_id, k")
def _(t: Tables) -> DataFrame:
    return R.sessions(_events(t))


@query("t4_sampled_positions", "SELECT user_id, time_bucket(INTERVAL 400 MILLISECOND, ts, TIMESTAMP '1970-01-01') AS started, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return R.sampled(_events(t))


@query("t_tumbling_1h", "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return R.windows(_events(t))


@query("t_sliding_1h_15m", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS started, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events, generate_series(0, 3) AS g(k) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return R.windows(_events(t), "1 hour", "15 minutes")


@query("t3_capped_totals", "SELECT user_id, count(*) AS events, round(sum(least(value, 50.0)), 6) AS total FROM events WHERE value > 0 GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    """Each event once, positive amounts of at most 50."""
    return R.capped(R.once_each(_events(t)), 50.0).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total"))


@query("t6_latest_state", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    return R.latest_state(_events(t))


@query("t5_settled", "SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR epoch_ms(nxt) - epoch_ms(ts) > 600000")
def _(t: Tables) -> DataFrame:
    return R.settled(_events(t), 600_000).select("event_id", "user_id")


@query("t4_changes", "SELECT event_id FROM (SELECT *, lag(event_type) OVER w AS p, lag(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE value IS DISTINCT FROM b")
def _(t: Tables) -> DataFrame:
    return R.changes(_events(t)).select("event_id")


@query("t10_stream_static", "SELECT c_mktsegment AS segment, event_type, count(*) AS events FROM events JOIN customer ON c_custkey = user_id GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return _events(t).join(t.customer, F.col("c_custkey") == F.col("user_id")).groupBy(F.col("c_mktsegment").alias("segment"), "event_type").agg(F.count(F.lit(1)).alias("events"))


@query("t10_stream_joined", "SELECT event_id, c_mktsegment AS segment FROM (SELECT DISTINCT event_id, user_id FROM events) e JOIN customer ON c_custkey = user_id")
def _(t: Tables) -> DataFrame:
    """The events as a stream, each once, joined with a table, into a table."""
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    stream = R.once_each(R.event_stream(t.spark, f"{t.folder}/events.parquet*"))
    joined = stream.join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("c_custkey") == F.col("user_id")).select("event_id", "segment")
    return R.run_to_table(joined, f"{folder}/table", f"{folder}/progress")


@query("t_stream_tumbling", "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def _(t: Tables) -> DataFrame:
    """The tumbling windows run as a stream into a table: those that the watermark has closed."""
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    stream = R.event_stream(t.spark, f"{t.folder}/events.parquet*")
    return R.run_to_table(R.windows(R.once_each(stream)), f"{folder}/table", f"{folder}/progress")
