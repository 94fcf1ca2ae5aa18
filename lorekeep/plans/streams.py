"""Streaming queries, each equal to its batch twin over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.plans.dialect import Plans
from lorekeep.session import table
from lorekeep.streaming import events as S

plan = Plans()
QUERIES, ORACLE = plan.QUERIES, plan.ORACLE

#: What the watermark has closed at the end of the input: windows that ended ten minutes before its last event.
_CLOSED = "(SELECT epoch_ms(max(ts)) - 600000 FROM events)"

plan.direct("stream_daily_counts", lambda s, p: S.drained(S.daily_counts(S.event_stream(s, p)), "update", ["event_type", "day"]), "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2")
plan.direct(
    "stream_minute_windows", lambda s, p: S.drained(S.minute_windows(S.event_stream(s, p)), "append"),
    f"SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2 HAVING epoch_ms(date_trunc('minute', min(ts)) + INTERVAL 1 MINUTE) <= {_CLOSED}",
)
plan.direct(
    "stream_sessions", lambda s, p: S.drained(S.sessions(S.event_stream(s, p)), "append"),
    f"""WITH f AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM f)
    SELECT user_id, min(ts) AS began, count(*) AS n FROM g GROUP BY user_id, session_no HAVING epoch_ms(max(ts) + INTERVAL 30 MINUTE) <= {_CLOSED}""",
)
plan.direct("stream_once_each", lambda s, p: S.drained(S.once_each(S.repeated(S.event_stream(s, p), "event_id % 3 = 0"))).select("event_id", "user_id"), "SELECT event_id, user_id FROM events")
plan.direct(
    "stream_admission", lambda s, p: S.drained(S.admitted(S.event_stream(s, p), 5)),
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 5 AS admitted FROM events",
)


def stream_matched(spark, sf_dir):
    types = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id"))
    return S.drained(S.matched(S.event_stream(spark, sf_dir), types, "event_type")).select("event_id", "event_type", "first_id")


plan.direct("stream_matched", stream_matched, "SELECT e.event_id, e.event_type, t.first_id FROM events e JOIN (SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type) t ON t.event_type = e.event_type")
