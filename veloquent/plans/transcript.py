"""Transcript queries over ``conversations``: conversation is the file, turn the position, role the speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.islands import number_islands
from .base import Group
from .transcript_json import _T
from .transcript_json import turns as speaker_turns

query = Group()


@query(
    "transcript_blocks",
    f"""
WITH {_T},
f AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS s
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM f),
g AS (SELECT conv_id, CAST(block AS BIGINT) AS block, role, min(turn) AS first_turn, count(*) AS n_turns,
             string_agg(text, ' ' ORDER BY turn) AS text FROM b GROUP BY conv_id, block, role),
r AS (SELECT conv_id, role, CAST(sum(length(text)) AS BIGINT) AS role_chars FROM t GROUP BY conv_id, role)
SELECT g.*, r.role_chars FROM g JOIN r USING (conv_id, role)
""",
)
def transcript_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge consecutive turns of one role into blocks and join each role's total length."""
    turns = speaker_turns(spark, sf_dir)
    blocks = (
        number_islands(turns, ["conv_id"], ["turn"], F.col("role"), "block")
        .groupBy("conv_id", "block", "role")
        .agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n_turns"), F.expr("listagg(text, ' ') within group (order by turn)").alias("text"))
    )
    totals = turns.groupBy("conv_id", "role").agg(F.sum(F.length("text")).alias("role_chars"))
    return blocks.join(totals, ["conv_id", "role"]).orderBy("conv_id", "block")
