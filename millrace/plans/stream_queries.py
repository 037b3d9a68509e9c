"""The batch form of the stream operators, and a run of one as a stream."""

from __future__ import annotations

from millrace.plans.registry import query
from millrace.plans.roles import table
from millrace.streaming import events as S


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Hourly counts and sums by event type."""
    return S.tumbling(table(spark, sf_dir, "events"))


@query(
    "event_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark, sf_dir):
    """A user's events without a pause of half an hour."""
    return S.sessions(table(spark, sf_dir, "events"))
