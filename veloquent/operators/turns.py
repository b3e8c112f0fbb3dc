"""Natural turns: speakers' floors by windows, back-channels by an interval join, no pass in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import interval_join
from .islands import number_starts

TURN = ["file_id", "speaker", "turn"]


def natural_turns(rows: DataFrame, words: DataFrame | None = None, max_pause: int = 2000, longest: int = 2000, few_words: int = 3, width: int = 16_000) -> DataFrame:
    """Back-channels inside another speaker's turn take that turn's speaker; files under three segments stay.

    ``rows`` holds file_id, pos, speaker, start_ms, end_ms; further columns stay. Each speaker's segments less than ``max_pause`` apart form a turn. Of the turns by start, then speaker, one inside an earlier
    primary turn of another speaker is secondary and absorbs none; it is relabelled if shorter than ``longest`` and if at most ``few_words`` of ``words`` (file_id, start_ms, end_ms) have their
    middle in it. Turns of one speaker never overlap, so what lies in a secondary turn also lies in the primary one around it, whose speaker is another. Hence the first turn that contains a turn
    is always primary, and a join finds it, with at most one pair for each turn and speaker, where a scan would remember which turns were absorbed.
    """
    own = Window.partitionBy("file_id", "speaker").orderBy("start_ms", "pos")
    before = F.max("end_ms").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("__o", F.col("start_ms") - before >= max_pause)
    dealt = number_starts(opened, ["file_id", "speaker"], ["start_ms", "pos"], F.col("__o"), "turn").drop("__o")
    turns = dealt.groupBy(*TURN).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    floors = turns.select("file_id", F.col("speaker").alias("r_speaker"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    inside = (F.col("r_speaker") != F.col("speaker")) & (F.col("r_start") <= F.col("start_ms")) & (F.col("end_ms") <= F.col("r_end"))
    earlier = (F.col("r_start") < F.col("start_ms")) | (F.col("r_speaker") < F.col("speaker"))
    short = turns.where(F.col("end_ms") - F.col("start_ms") < longest)
    hosts = interval_join(short, floors, "file_id", width).where(inside & earlier).groupBy(*TURN, "start_ms", "end_ms").agg(F.min_by("r_speaker", F.struct("r_start", "r_speaker")).alias("host"))
    full = rows.groupBy("file_id").count().where("count > 2").select("file_id")
    hosts = hosts.join(full, "file_id", "left_semi")
    if words is not None:  # twice the middle of a word is whole
        middles = words.select("file_id", (F.col("start_ms") + F.col("end_ms")).alias("r_start"), (F.col("start_ms") + F.col("end_ms") + 1).alias("r_end"))
        spans = hosts.withColumns({"start_ms": 2 * F.col("start_ms"), "end_ms": 2 * F.col("end_ms") + 1})
        wordy = interval_join(spans, middles, "file_id", 2 * width).groupBy(*TURN).count().where(F.col("count") > few_words)
        hosts = hosts.join(wordy.select(*TURN), TURN, "left_anti")
    named = dealt.join(hosts.select(*TURN, "host"), TURN, "left")
    return named.withColumn("speaker", F.coalesce("host", "speaker")).select(*rows.columns)
