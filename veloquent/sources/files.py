"""Readers and writers of the transcript side's files: hot words, token lists, vocabularies, interchange JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<text string, start double, `end` double, suspect string, gap_before_ms int, gap_after_ms int>"
SEGMENT = f"struct<type string, text string, speaker string, speaker_id int, start_time double, segment_id bigint, partials array<struct<text string, timestamp double>>, raw_words array<{WORD}>>"
#: Interchange format, version 1.
TRANSCRIPT = (
    "version int, model string, model_type string, created_at string, duration_sec double, timing map<string, double>, "
    f"speaker_names map<string, string>, speaker_colors map<string, string>, segments array<{SEGMENT}>, "
    f"overlap_segments array<struct<speaker string, speaker_id int, start_time double, end_time double, text string, raw_words array<{WORD}>>>"
)
DEFAULT_SCORE = 1.5


def parse_hotwords(lines: DataFrame, column: str = "value", default: float = DEFAULT_SCORE) -> DataFrame:
    """``phrase`` and ``score`` of lines ``phrase [:score]``, other columns kept.

    Blank and comment lines go; the last colon divides; a suffix that is no number stays in the phrase.
    """
    kept = lines.withColumn(column, F.trim(column)).where((F.col(column) != "") & ~F.startswith(column, F.lit("#")))
    suffix = F.nullif(F.trim(F.regexp_extract(column, ":([^:]*)$", 1)), F.lit(""))
    scored = kept.withColumn("score", suffix.try_cast("double"))
    phrase = F.when(F.col("score").isNull(), F.col(column)).otherwise(F.trim(F.regexp_replace(column, ":[^:]*$", "")))
    return scored.withColumn("phrase", F.upper(phrase)).withColumn("score", F.coalesce("score", F.lit(default))).drop(column)


def read_hotwords(spark: SparkSession, path: str) -> DataFrame:
    """Hot words of a text file or folder."""
    return parse_hotwords(spark.read.text(path))


def parse_tokens(lines: DataFrame, column: str = "value") -> DataFrame:
    """``id`` and ``token`` of lines ``token id``."""
    part = lambda k: F.split_part(column, F.lit(" "), F.lit(k))
    return lines.select(part(2).cast("bigint").alias("id"), part(1).alias("token"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A token list."""
    return parse_tokens(spark.read.text(path))


def read_vocabulary(spark: SparkSession, path: str, padded: bool = True) -> DataFrame:
    """``token`` and ``id`` of one token a line; a padded vocabulary leaves 0 to padding and 1 to unknown tokens.

    Lines are numbered inside the file by their place, so the file is read as one row: vocabularies are small.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\r?\n")).alias("id", "token"))
    return lines.select("token", (F.col("id") + (2 if padded else 0)).cast("bigint").alias("id"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Interchange JSON files, one transcript a file, with the declared schema."""
    return spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path)


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    """Transcripts as JSON lines, text unescaped."""
    transcripts.write.mode("overwrite").json(path)
