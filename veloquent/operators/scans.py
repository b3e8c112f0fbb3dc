"""Ordered scans whose steps read what earlier steps wrote: one grouped pass per file, small steps in Python.

Windows cannot express these, as each decision changes the rows that the next one reads. Files spread over the
cluster; scans that change labels alone also spread a long file (``carried``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carried import SIZE, scan_labels

SEGMENTS = "file_id bigint, pos bigint, speaker bigint, start_ms bigint, end_ms bigint, n_words bigint, ends_sentence boolean"


def _scan(rows: DataFrame, step, schema: str) -> DataFrame:
    """Run ``step`` over each file's rows in (start_ms, pos) order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(pdf.sort_values(["start_ms", "pos"], kind="stable").reset_index(drop=True))

    return rows.groupBy("file_id").applyInPandas(one, schema)


def _island(state, row, before, earlier, behind):
    if before and behind and state[0] == behind.speaker != row.speaker and (row.end_ms - row.start_ms <= 1500 or row.n_words <= 4):
        return state[0]
    return row.speaker


def _lead(state, row, before, earlier, behind):
    alone = behind and row.n_words == 1 and row.end_ms - row.start_ms <= 800 and not row.ends_sentence and behind.n_words >= 2
    if alone and (not before or row.start_ms - before.end_ms >= 1200) and behind.start_ms - row.end_ms <= 2500:
        return behind.speaker
    return row.speaker


def _trail(state, row, before, earlier, behind):
    tail = row.n_words <= 2 and row.end_ms - row.start_ms <= 900 and row.ends_sentence
    if tail and earlier and not before.ends_sentence and row.start_ms - before.end_ms <= 250 and state[1] and before.start_ms - earlier.end_ms <= 1000:
        return state[0]
    return row.speaker


SMOOTHING = {"island": _island, "lead": _lead, "trail": _trail}


def smooth_speakers(rows: DataFrame, rules: tuple[str, ...] = ("island", "lead", "trail"), size: int = SIZE) -> DataFrame:
    """Up to three left-to-right rules on speaker labels, each over the labels that the one before left.

    An island of at most 1.5 s or four words between two rows of one speaker joins them. A lone word
    behind a pause of 1.2 s and before a longer row within 2.5 s joins that row. Up to two words that
    end the current row's sentence within 0.25 s stay with it. Files over ``size`` rows are scanned in pieces.
    """
    return scan_labels(rows, [SMOOTHING[r] for r in ("island", "lead", "trail") if r in rules], size)


WORDS = "file_id bigint, pos bigint, speaker bigint, start_ms bigint, end_ms bigint, inside boolean"


def _follows(state, row, before, earlier, behind):
    return state[0] if before and row.start_ms - before.end_ms < row.max_gap and not row.inside else row.speaker


def _leaves(state, row, before, earlier, behind):
    last = before and behind and row.speaker == state[0] and behind.speaker != row.speaker
    return behind.speaker if last and not row.inside and row.speaker == row.was else row.speaker


BOUNDARY = {"lead": _follows, "trail": _leaves}


def move_boundary_words(rows: DataFrame, max_gap: int = 300, rules: tuple[str, ...] = ("lead", "trail"), size: int = SIZE) -> DataFrame:
    """Words at a speaker change move to the side that they belong to.

    ``inside`` says that a word lies in its own speaker's diarization. Leading words of the later
    block follow the earlier one while the gap stays under ``max_gap`` and they are not inside. Then
    the last word of the earlier block, if not inside and not its only one, goes to the later.
    Files over ``size`` rows are scanned in pieces.
    """
    told = rows.withColumns({"was": F.col("speaker"), "max_gap": F.lit(max_gap)})
    return scan_labels(told, [BOUNDARY[r] for r in ("lead", "trail") if r in rules], size).select(*rows.columns)


def plan_chunks(silences: DataFrame, target: int = 30_000, slack: int = 2_000, least: int = 20_000, overlap: int = 3_000) -> DataFrame:
    """Chunks near ``target`` cut at the silence whose middle is nearest, each cut from the last one.

    ``silences`` has file_id, pos, start_ms, end_ms; the file ends with its last silence. A cut
    leaves at least ``least`` behind it; without a silence within ``slack`` it falls on the target.
    """

    def step(p: pd.DataFrame) -> pd.DataFrame:
        middles = ((p.start_ms + p.end_ms) // 2).tolist()
        end, at, out = int(p.end_ms.max()), 0, []
        while end - at > target:
            goal = at + target
            near = [m for m in middles if abs(m - goal) <= slack and m - at >= least and m < end]
            cut = min(near, key=lambda m: (abs(m - goal), m), default=goal)
            out.append((at, cut))
            at = cut
        out.append((at, end))
        return pd.DataFrame([(p.file_id[0], k, max(a - overlap, 0) if k else a, b) for k, (a, b) in enumerate(out)], columns=["file_id", "chunk_no", "start_ms", "end_ms"])

    return _scan(silences, step, "file_id bigint, chunk_no bigint, start_ms bigint, end_ms bigint")


def pack_lines(lines: DataFrame, limit: int = 12_000, back: int = 5) -> DataFrame:
    """Lines ``(file_id, pos, n_chars)`` packed to ``limit`` characters; a chunk starts ``back`` lines before the last one's end."""

    def step(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        size = (p.n_chars + 1).tolist()
        out, at = [], 0
        while at < len(size):
            end, used = at, 0
            while end < len(size) and (end == at or used + size[end] <= limit):
                used += size[end]
                end += 1
            out.append((p.file_id.iloc[0], len(out), at, end))
            at = len(size) if end == len(size) else max(end - back, at + 1)
        return pd.DataFrame(out, columns=["file_id", "chunk_no", "first_line", "after_line"])

    return lines.groupBy("file_id").applyInPandas(step, "file_id bigint, chunk_no bigint, first_line bigint, after_line bigint")


def suspect_spans(turns: DataFrame) -> DataFrame:
    """Spans of suspect words in a turn's text, found left to right; spans with blanks alone between merge.

    ``turns`` has file_id, pos, text and ``suspects``, an array of words in order.
    """

    def spans(text: str, suspects) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        at = 0
        for w in suspects:
            k = text.find(w, at)
            if k < 0:
                continue
            at = k + len(w)
            if out and not text[out[-1][1] : k].strip():
                out[-1] = (out[-1][0], at)
            else:
                out.append((k, at))
        return out

    def run(batches):
        for p in batches:
            rows = [(f, s, a, b) for f, s, t, w in zip(p.file_id, p.pos, p.text, p.suspects) for a, b in spans(t or "", w)]
            yield pd.DataFrame(rows, columns=["file_id", "pos", "first_char", "after_char"]).astype("int64")

    return turns.select("file_id", "pos", "text", "suspects").mapInPandas(run, "file_id bigint, pos bigint, first_char bigint, after_char bigint")
