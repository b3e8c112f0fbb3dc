"""Gaps-and-islands helpers: number runs of ordered rows without leaving the window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_starts(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the islands of each key from 1; a row opens one where ``starts`` is true or null."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__start", F.when(starts, 1).when(~starts, 0).otherwise(1)).withColumn(name, F.sum("__start").over(run)).drop("__start")


def number_islands(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "island") -> DataFrame:
    """Number runs of equal ``value`` (null equals null) in each key's order."""
    seen = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__value", value).withColumn("__same", F.col("__value").eqNullSafe(F.lag("__value").over(seen)) & (F.row_number().over(seen) > 1))
    return number_starts(marked, keys, order, ~F.col("__same"), name).drop("__value", "__same")
