"""Queries over live streams of a service: what is throttled, queued, cached and expired, drained from state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.policies import bounded_queue, cached, expired_sessions, throttled
from ..streaming.run import drain, read_stream
from .base import Group

query = Group()

HOUR = 3_600_000


def _live(spark: SparkSession, sf: str, **actions: str) -> DataFrame:
    """The events as a stream with their time in ms and what their types stand for."""
    names = F.create_map(*(F.lit(x) for kind, action in actions.items() for x in (kind, action)))[F.col("event_type")] if actions else F.lit("")
    at = F.col("ts").cast("timestamp")
    return read_stream(spark, f"{sf}/events.parquet").select("*", at.alias("at"), F.unix_millis(at).alias("at_ms"), names.alias("action"))


_ORDERED = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY {key} ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events)"


@query(
    "str_throttle",
    f"""WITH RECURSIVE {_ORDERED.format(key='user_id')},
    s AS (SELECT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS BIGINT) AS sent, CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT user_id, r, CASE WHEN passes THEN event_type ELSE text END, CASE WHEN passes THEN ms ELSE sent END, CASE WHEN passes THEN event_id END
      FROM (SELECT e.user_id, e.r, e.event_type, e.ms, e.event_id, s.text, s.sent, s.sent IS NULL OR e.event_type <> s.text OR e.ms - s.sent >= {6 * HOUR} AS passes FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1))
    SELECT user_id AS stream_id, event_id FROM s WHERE event_id IS NOT NULL""",
)
def str_throttle(spark: SparkSession, sf: str) -> DataFrame:
    """Progress messages that are sent: changed ones, and those six hours behind the last one that was sent."""
    return drain(throttled(_live(spark, sf).select(F.col("user_id").alias("stream_id"), "at_ms", "event_id", F.col("event_type").alias("message")), 6 * HOUR))


@query(
    "str_backpressure",
    f"""WITH RECURSIVE {_ORDERED.format(key='user_id')},
    s AS (SELECT user_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS dropped, false AS partial, CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT user_id, r, q - dropped, dropped, taken AND q <= 10, event_id FROM (
        SELECT user_id, r, q, event_id, taken, CASE WHEN put THEN greatest(q - 200, 0) WHEN quiet THEN greatest(q - 5, 0) ELSE 0 END AS dropped FROM (
          SELECT e.user_id, e.r, e.event_id, e.event_type IN ('view', 'click', 'signup') AS put, e.event_type = 'error' AS quiet, e.event_type = 'purchase' AS taken,
            CASE WHEN e.event_type = 'purchase' THEN s.q - least(s.q, 25) WHEN e.event_type = 'error' THEN s.q ELSE s.q + coalesce(CAST(floor(e.value) AS BIGINT), 0) END AS q
          FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)))
    SELECT user_id AS stream_id, event_id, q AS queued, dropped, partial FROM s WHERE r > 0""",
)
def str_backpressure(spark: SparkSession, sf: str) -> DataFrame:
    """Queues of 200 chunks that drop the oldest, show no partial result while over ten wait, and keep five behind a silence."""
    e = _live(spark, sf, view="put", click="put", signup="put", purchase="take", error="silence")
    return drain(bounded_queue(e.select(F.col("user_id").alias("stream_id"), "at_ms", "event_id", "action", F.floor("value").alias("n"))))


@query(
    "str_cache",
    f"""WITH RECURSIVE {_ORDERED.format(key='user_id, event_id % 2')},
    s AS (SELECT user_id, k, CAST(0 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS until, CAST(-1 AS BIGINT) AS revoked, CAST(NULL AS VARCHAR) AS answer, CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT user_id, event_id % 2 AS k FROM events)
      UNION ALL SELECT user_id, k, r, CASE answer WHEN 'revoked' THEN -1 WHEN 'dropped' THEN -1 WHEN 'miss' THEN ms + {24 * HOUR} ELSE until END, CASE answer WHEN 'revoked' THEN ms + {48 * HOUR} ELSE revoked END, answer, event_id FROM (
        SELECT e.user_id, s.k, e.r, e.ms, e.event_id, s.until, s.revoked, CASE WHEN e.event_type = 'error' THEN 'revoked' WHEN e.ms < s.revoked THEN 'refused' WHEN e.event_type = 'purchase' THEN 'dropped' WHEN e.ms < s.until THEN 'hit' ELSE 'miss' END AS answer
        FROM s JOIN e ON e.user_id = s.user_id AND e.event_id % 2 = s.k AND e.r = s.r + 1))
    SELECT concat(user_id, '/', k) AS stream_id, event_id, answer FROM s WHERE r > 0""",
)
def str_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Look-ups of cached entries that live a day from their load, with writes that drop them and revocations that refuse them for two."""
    e = _live(spark, sf, view="read", click="read", signup="read", purchase="write", error="revoke").withWatermark("at", "0 seconds")
    return drain(cached(e.select(F.concat_ws("/", "user_id", F.col("event_id") % 2).alias("stream_id"), "at", "at_ms", "event_id", "action"), 24 * HOUR, 48 * HOUR))


_DUE = f"CASE WHEN {{u}} % 3 = 0 THEN {{s}}.last + {24 * HOUR} WHEN {{s}}.active THEN greatest({{s}}.created + {120 * HOUR}, {{s}}.last + {12 * HOUR}) ELSE {{s}}.last + {12 * HOUR} END"
_REASON = "CASE WHEN {u} % 3 = 0 THEN 'timeout' WHEN {s}.active THEN 'forced' ELSE 'idle' END"


@query(
    "str_heartbeat_expiry",
    f"""WITH RECURSIVE {_ORDERED.format(key='user_id')},
    s AS (SELECT user_id, r, ms AS created, ms AS last, event_type = 'view' AS active, CAST(NULL AS BIGINT) AS was, CAST(NULL AS BIGINT) AS ended, CAST(NULL AS VARCHAR) AS reason FROM e WHERE r = 1
      UNION ALL SELECT user_id, r, CASE WHEN over THEN ms ELSE created END, ms, CASE WHEN event_type = 'view' THEN true WHEN event_type IN ('purchase', 'error') THEN false WHEN over THEN false ELSE active END, CASE WHEN over THEN created END, CASE WHEN over THEN due END, CASE WHEN over THEN why END FROM (
        SELECT e.user_id, e.r, e.ms, e.event_type, s.created, s.active, {_DUE.format(u='e.user_id', s='s')} AS due, {_REASON.format(u='e.user_id', s='s')} AS why, e.ms >= {_DUE.format(u='e.user_id', s='s')} AS over FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1))
    SELECT user_id AS session_id, was AS created_ms, ended AS expired_ms, reason FROM s WHERE ended IS NOT NULL
    UNION ALL SELECT user_id, created, {_DUE.format(u='user_id', s='l')}, {_REASON.format(u='user_id', s='l')} FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r DESC) = 1) l WHERE {_DUE.format(u='user_id', s='l')} < (SELECT max(ms) FROM e)""",
)
def str_heartbeat_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that expired, by event-time timers: anonymous ones a day behind their last sign of life, others when idle for twelve hours, with work under way when also five days old."""
    e = _live(spark, sf, view="start", purchase="end", error="end", click="beat", signup="beat").withWatermark("at", "0 seconds")
    e = e.select(F.col("user_id").alias("session_id"), "at", "at_ms", "event_id", (F.col("user_id") % 3 == 0).alias("anonymous"), "action")
    return drain(expired_sessions(e, 24 * HOUR, 12 * HOUR, 120 * HOUR), state_store="rocksdb")
