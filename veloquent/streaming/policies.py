"""Policies of a live service as stateful streams: throttled messages, bounded queues, expiring caches and sessions."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Earlier than any time.
NEVER = -(1 << 60)


@lru_cache
def _row(names: tuple[str, ...]) -> type:
    return namedtuple("Row", names)


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator:
    """A key's rows of one trigger by time, without ``at``; those of one time by ``event_id``.

    Most keys have a handful of rows, so columns become lists at once and no frame is joined or sorted for them.
    """
    parts = list(batches)
    names = tuple(c for c in parts[0].columns if c != "at")
    columns = [[v for p in parts for v in p[c].tolist()] for c in names]
    order = np.lexsort((columns[names.index("event_id")], columns[names.index("at_ms")]))
    rows = list(zip(*columns))
    return (_row(names)(*rows[k]) for k in order.tolist())


def throttled(messages: DataFrame, least: int) -> DataFrame:
    """Of a stream of ``(stream_id, at_ms, event_id, message)`` what is sent: messages unlike the last one sent, and those ``least`` ms behind it.

    State is the last message that was sent and its time; what was held back leaves no trace, so a steady flow passes once every ``least``. A null message is a message of its own.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, sent, any_ = state.get if state.exists else (None, NEVER, False)
        out = []
        for row in _in_order(batches):
            if not any_ or row.message != text or row.at_ms - sent >= least:
                text, sent, any_ = row.message, int(row.at_ms), True
                out.append((key[0], row.event_id))
        state.update((text, sent, any_))
        yield pd.DataFrame(out, columns=["stream_id", "event_id"])

    return messages.groupBy("stream_id").applyInPandasWithState(step, "stream_id bigint, event_id bigint", "text string, sent bigint, any boolean", "append", GroupStateTimeout.NoTimeout)


def pressed(head: int, tail: int, action: str, n: int, capacity: int, burst: int, busy: int, keep: int) -> tuple[int, int, int, bool]:
    """``(head, tail, dropped, partial)`` of a queue of the chunks ``head`` to ``tail`` behind one action."""
    dropped, partial = 0, False
    if action == "put":
        tail += n
        dropped = max(0, tail - head - capacity)
    elif action == "take":
        head += min(burst, tail - head)
        partial = tail - head <= busy
    elif action == "silence":
        dropped = max(0, tail - head - keep)
    return head + dropped, tail, dropped, partial


def bounded_queue(actions: DataFrame, capacity: int = 200, burst: int = 25, busy: int = 10, keep: int = 5) -> DataFrame:
    """The queue of each stream of ``(stream_id, at_ms, event_id, action, n)`` behind every action: ``(stream_id, event_id, queued, dropped, partial)``.

    ``put`` brings ``n`` chunks and drops the oldest beyond ``capacity``; ``take`` hands ``burst`` chunks at most to the recogniser, which shows a
    partial result unless over ``busy`` chunks still wait; ``silence`` ends an utterance and keeps the last ``keep`` chunks. Chunks leave at the head alone, so state is
    the two ends of the queue. Other actions change nothing; a null ``n`` is none.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head, tail = state.get if state.exists else (0, 0)
        out = []
        for row in _in_order(batches):
            head, tail, dropped, partial = pressed(head, tail, row.action, 0 if pd.isna(row.n) else int(row.n), capacity, burst, busy, keep)
            out.append((key[0], row.event_id, tail - head, dropped, partial))
        state.update((int(head), int(tail)))
        yield pd.DataFrame(out, columns=["stream_id", "event_id", "queued", "dropped", "partial"])

    return actions.groupBy("stream_id").applyInPandasWithState(step, "stream_id bigint, event_id bigint, queued bigint, dropped bigint, partial boolean", "head bigint, tail bigint", "append", GroupStateTimeout.NoTimeout)


def cached(lookups: DataFrame, ttl: int, lifetime: int) -> DataFrame:
    """Answers ``(stream_id, event_id, answer)`` to a stream of ``(stream_id, at, at_ms, event_id, action)`` with a watermark on ``at``.

    A ``read`` hits while less than ``ttl`` ms have passed since its entry was loaded, which a hit does not prolong; else it is a miss and loads it. A ``write`` drops the
    entry. A ``revoke`` drops it and refuses reads for ``lifetime`` ms, as long as the token would live. Entries and
    revocations that the watermark has passed leave the state by timer.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            until, revoked = state.get if state.exists else (NEVER, NEVER)
            for row in _in_order(batches):
                at = int(row.at_ms)
                if row.action == "revoke":
                    until, revoked, answer = NEVER, at + lifetime, "revoked"
                elif at < revoked:
                    answer = "refused"
                elif row.action == "write":
                    until, answer = NEVER, "dropped"
                elif at < until:
                    answer = "hit"
                else:
                    until, answer = at + ttl, "miss"
                out.append((key[0], row.event_id, answer))
            if max(until, revoked) > max(NEVER, state.getCurrentWatermarkMs()):
                state.update((until, revoked))
                state.setTimeoutTimestamp(max(until, revoked))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["stream_id", "event_id", "answer"])

    return lookups.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, event_id bigint, answer string", "until bigint, revoked bigint", "append", GroupStateTimeout.EventTimeTimeout)


def due(anonymous: bool, created: int, last: int, active: bool, timeout: int, idle: int, age: int) -> tuple[int, str]:
    """When a session expires if nothing more comes, and why."""
    if anonymous:
        return last + timeout, "timeout"
    if active and created + age > last + idle:
        return created + age, "forced"
    return last + idle, "forced" if active else "idle"


class Sessions(StatefulProcessor):
    """One session a key: opened by its first event, kept by every further one, expired by an event-time timer."""

    def __init__(self, timeout: int, idle: int, age: int):
        self.limits = (timeout, idle, age)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "anonymous boolean, created bigint, last bigint, active boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.held.get() if self.held.exists() else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        out = []
        for row in _in_order(rows):
            at = int(row.at_ms)
            if now is not None:
                end, reason = due(*now, *self.limits)
                if at >= end:  # both lie in one trigger, so that no timer came between
                    out.append((key[0], now[1], end, reason))
                    now = None
            if now is None:
                now = (bool(row.anonymous), at, at, False)
            active = True if row.action == "start" else False if row.action == "end" else now[3]
            now = (now[0], now[1], at, active)
        self.held.update(now)
        self.handle.registerTimer(due(*now, *self.limits)[0])
        yield pd.DataFrame(out, columns=["session_id", "created_ms", "expired_ms", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.held.exists():
            now = self.held.get()
            end, reason = due(*now, *self.limits)
            if end <= expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], now[1], end, reason))
                self.held.clear()
        yield pd.DataFrame(out, columns=["session_id", "created_ms", "expired_ms", "reason"])

    def close(self) -> None:
        pass


def expired_sessions(events: DataFrame, timeout: int, idle: int, age: int) -> DataFrame:
    """Sessions ``(session_id, created_ms, expired_ms, reason)`` that expired in a stream of ``(session_id, at, at_ms, event_id, anonymous, action)`` with a watermark on ``at``.

    Every event is a sign of life. Anonymous sessions expire ``timeout`` ms behind the last one. Others do when ``idle``, unless an item is under work
    (``start`` to ``end``); then they are forced out once idle and of ``age``. Expiry needs no further event of the session: a timer
    fires when the watermark passes. An event behind it opens a new session. Needs the RocksDB state store.
    """
    return events.groupBy("session_id").transformWithStateInPandas(Sessions(timeout, idle, age), "session_id bigint, created_ms bigint, expired_ms bigint, reason string", "Append", "EventTime")
