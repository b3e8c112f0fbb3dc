"""Session builder and table reader shared by queries, benchmarks and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, name: str = "veloquent", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew handling on; ``conf`` overrides."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
