"""A session's queue item as a state machine over a live stream of actions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: From which statuses an action is allowed, and the one that it leads to. A session has one waiting or running item at most.
RULES = {
    "enqueue": (("none", "completed", "error", "cancelled"), "waiting"),
    "start": (("waiting",), "processing"),
    "complete": (("processing",), "completed"),
    "fail": (("processing",), "error"),
    "cancel": (("waiting", "processing"), "cancelled"),
}


def advance(status: str, action: str) -> str | None:
    """The status that an action leads to; None if it is refused."""
    allowed, to = RULES.get(action, ((), ""))
    return to if status in allowed else None


def queue_changes(actions: DataFrame) -> DataFrame:
    """Status changes ``(stream_id, event_id, status)`` of a stream of ``(stream_id, frame, action)``, taken in frame order.

    State is one word a session. An item that was running when the stream last stopped is still so when it starts anew, as
    the state is kept.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "none"
        out = []
        for row in pd.concat(list(batches)).sort_values("frame").itertuples():
            if (to := advance(now, row.action)) is not None:
                now = to
                out.append((key[0], row.frame, to))
        state.update((now,))
        yield pd.DataFrame(out, columns=["stream_id", "event_id", "status"])

    return actions.groupBy("stream_id").applyInPandasWithState(step, "stream_id bigint, event_id bigint, status string", "status string", "append", GroupStateTimeout.NoTimeout)
