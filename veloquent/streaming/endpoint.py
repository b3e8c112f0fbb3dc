"""Live endpointing: a state machine per stream that opens on speech and closes on silence or length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stream_id bigint, first_frame bigint, last_frame bigint, reason string"
STATE = "opened bigint, last bigint, silent bigint, frames bigint"


def advance(state: tuple, frame: int, speech: bool, quiet: int, longest: int) -> tuple[tuple, tuple | None]:
    """The next state and a finished utterance, if this frame ends one. Idle is an ``opened`` of -1."""
    opened, last, silent, frames = state
    if opened < 0:
        return ((frame, frame, 0, 1) if speech else state), None
    frames, silent, last = frames + 1, (0 if speech else silent + 1), (frame if speech else last)
    if silent > quiet or frames > longest:
        return (-1, -1, 0, 0), (opened, last, "silence" if silent > quiet else "length")
    return (opened, last, silent, frames), None


def endpoints(frames: DataFrame, quiet: int = 11, longest: int = 240) -> DataFrame:
    """Utterances of a stream of ``(stream_id, frame, speech)``; frames of one trigger are taken in order.

    An utterance closes on the frame after ``quiet`` silent ones, or past ``longest`` frames. State is
    four numbers per stream.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (-1, -1, 0, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("frame").itertuples():
            now, done = advance(now, int(row.frame), bool(row.speech), quiet, longest)
            if done:
                out.append((key[0], *done))
        state.update(tuple(int(x) for x in now))
        yield pd.DataFrame(out, columns=["stream_id", "first_frame", "last_frame", "reason"])

    return frames.groupBy("stream_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def changed_partials(events: DataFrame, least: int = 1_000) -> DataFrame:
    """Of ``(stream_id, at_ms, event_id, text, is_final)`` the finals, and partials that changed and come ``least`` behind the last one.

    Rows of one time are taken by ``event_id``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, sent = state.get if state.exists else ("", -(1 << 60))
        out = []
        for row in pd.concat(list(batches)).sort_values(["at_ms", "event_id"]).itertuples():
            if row.is_final:
                out.append((key[0], row.at_ms, row.text, True))
                text, sent = "", -(1 << 60)
            elif row.text != text and row.at_ms - sent >= least:
                out.append((key[0], row.at_ms, row.text, False))
                text, sent = row.text, int(row.at_ms)
        state.update((text, int(sent)))
        yield pd.DataFrame(out, columns=["stream_id", "at_ms", "text", "is_final"])

    return events.groupBy("stream_id").applyInPandasWithState(step, "stream_id bigint, at_ms bigint, text string, is_final boolean", "text string, sent bigint", "append", GroupStateTimeout.NoTimeout)
