"""Streaming operators in their batch form, over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table as t
from ..streaming import guard
from .registry import query


@query("rate_guard_batch", "SELECT user_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def rate_guard_batch(s: SparkSession, d: str) -> DataFrame:
    """Minutes in which a user sent more than one event."""
    return guard.busy_minutes(t(s, d, "events"), "user_id", "ts", 1)


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), k AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM k GROUP BY user_id, k""")
def event_sessions(s: SparkSession, d: str) -> DataFrame:
    """Bursts of events of a user less than two hours apart."""
    return guard.sessions(t(s, d, "events").filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull()), "user_id", "ts", "2 hours")
