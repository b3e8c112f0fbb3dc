"""Stateful policies over several triggers: what was sent, queued, cached and expired is remembered, and silent keys are told."""

import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from veloquent.streaming import policies as P
from veloquent.streaming.run import STORES, _PROVIDER, drain, read_stream

#: Event times start here, as nothing at or before the first watermark, zero, is taken.
START = 1_000_000_000
ROWS = "stream_id bigint, at_ms bigint, event_id bigint, message string, n bigint"


def stream(spark, batches, schema=ROWS):
    """A stream that takes one batch of rows a trigger."""
    folder = tempfile.mkdtemp(prefix="veloquent-")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in.parquet")
        time.sleep(0.02)
    return read_stream(spark, f"{folder}/in.parquet", files_per_trigger=1).withColumn("at_ms", F.col("at_ms") + START).withColumn("at", F.timestamp_millis("at_ms"))


def test_a_steady_flow_passes_once_an_interval(spark):
    rows = [(1, 500 * k, k, "same", 0) for k in range(20)] + [(2, 500 * k, 100 + k, "same" if k != 5 else None, 0) for k in range(8)]
    got = sorted(r.event_id for r in drain(P.throttled(stream(spark, [rows[:7], rows[7:]]), 1000)).collect())
    assert got == [*range(0, 20, 2), 100, 102, 104, 105, 106]


def test_queue_against_a_list(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), k, k, rng.choice(["put", "put", "take", "silence", "other"]), rng.choice([0, 3, 60, 150, None])) for k in range(200)]
    held, want = {}, []
    for key, _, event, action, n in rows:
        q = held.setdefault(key, [])
        dropped, partial = 0, False
        if action == "put":
            q += [event] * (n or 0)
            dropped = max(0, len(q) - 200)
        elif action == "take":
            del q[:25]
            partial = len(q) <= 10
        elif action == "silence":
            dropped = max(0, len(q) - 5)
        del q[:dropped]
        want.append((key, event, len(q), dropped, partial))
    actions = stream(spark, [rows[:90], rows[90:]]).withColumnRenamed("message", "action")
    assert sorted(map(tuple, drain(P.bounded_queue(actions)).collect())) == sorted(want)
    assert any(w[3] for w in want) and any(w[4] for w in want)


def test_cache_answers_and_what_is_over_leaves_the_state(spark):
    schema = "stream_id string, at_ms bigint, event_id bigint, action string, n bigint"
    first = [("a", 0, 1, "read", 0), ("a", 50, 2, "read", 0), ("b", 10, 3, "read", 0), ("b", 20, 4, "revoke", 0), ("b", 30, 5, "read", 0)]
    later = [("a", 120, 6, "read", 0), ("c", 1_000, 7, "read", 0), ("c", 1_050, 8, "write", 0), ("c", 1_060, 9, "read", 0)]
    last = [("c", 1_070, 10, "read", 0)]
    lookups = stream(spark, [first, later, last], schema).withWatermark("at", "0 seconds")
    base = tempfile.mkdtemp(prefix="veloquent-")
    query = P.cached(lookups, 100, 500).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.event_id: r.answer for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {1: "miss", 2: "hit", 3: "miss", 4: "revoked", 5: "refused", 6: "miss", 7: "miss", 8: "dropped", 9: "miss", 10: "hit"}
    held = spark.read.format("statestore").load(f"{base}/state").select("key.stream_id").collect()
    assert [r.stream_id for r in held] == ["c"]


def test_silent_sessions_expire_by_timer(spark):
    hour = 3_600_000
    schema = "session_id bigint, at_ms bigint, event_id bigint, action string, anonymous boolean"
    first = [(1, 0, 1, "beat", True), (2, 0, 2, "beat", False), (3, 0, 3, "start", False), (4, 0, 4, "start", False), (5, 0, 5, "beat", True)]
    later = [(4, hour, 6, "end", False), (5, 20 * hour, 7, "beat", True)]
    last = [(9, 60 * hour, 8, "beat", True)]
    events = stream(spark, [first, later, last], schema).withWatermark("at", "0 seconds")
    got = drain(P.expired_sessions(events, 24 * hour, 12 * hour, 50 * hour), state_store="rocksdb").collect()
    assert sorted((r[0], r[1] - START, r[2] - START, r[3]) for r in got) == [(1, 0, 24 * hour, "timeout"), (2, 0, 12 * hour, "idle"), (3, 0, 50 * hour, "forced"), (4, 0, 13 * hour, "idle"), (5, 0, 44 * hour, "timeout")]
    assert spark.conf.get(_PROVIDER) != STORES["rocksdb"]


def test_an_expired_session_opens_anew_within_one_trigger(spark):
    schema = "session_id bigint, at_ms bigint, event_id bigint, action string, anonymous boolean"
    events = stream(spark, [[(1, 0, 1, "beat", True), (1, 5, 2, "beat", True), (1, 100, 3, "beat", True)], [(2, 10_000, 4, "beat", True)]], schema).withWatermark("at", "0 seconds")
    got = drain(P.expired_sessions(events, 10, 10, 10), state_store="rocksdb").collect()
    assert sorted((r[0], r[1] - START, r[2] - START, r[3]) for r in got) == [(1, 0, 15, "timeout"), (1, 100, 110, "timeout")]


@pytest.mark.parametrize("anonymous, active, want", [(True, True, (15, "timeout")), (False, False, (17, "idle")), (False, True, (30, "forced"))])
def test_due(anonymous, active, want):
    assert P.due(anonymous, 0, 10, active, 5, 7, 30) == want
