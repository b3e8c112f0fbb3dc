"""Rows with and without given ids: a bitmap of the ids settles most rows where they lie, so few long rows cross the network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Bits of a bucket of the bitmap.
BITS = 1 << 15
#: Bits of the bitmap for each id, and buckets at most, of 4096 bytes each: with more ids more rows take part in the join.
SHARE, BUCKETS = 16, 1024


def _split(rows: DataFrame, ids: DataFrame, col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows whose ``col`` may be among ``ids``, those in which it surely is not, and the distinct ids as ``__id``."""
    known = materialize(ids.select(F.col(ids.columns[0]).alias("__id")).distinct())
    buckets = min(max(-(-known.count() * SHARE // BITS), 1), BUCKETS)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets * BITS))
    bits = known.select(place("__id").alias("h")).groupBy(F.expr(f"h div {BITS}").alias("__bucket")).agg(F.bitmap_construct_agg(F.expr(f"h % {BITS}")).alias("__bits"))
    marked = rows.withColumn("__h", place(F.col(col).cast(known.schema["__id"].dataType))).join(F.broadcast(bits), F.expr(f"__h div {BITS} = __bucket"), "left")
    byte = f"cast(conv(hex(substring(__bits, cast(__h % {BITS} div 8 as int) + 1, 1)), 16, 10) as int)"
    marked = marked.withColumn("__hit", F.expr(f"coalesce(getbit({byte}, cast(__h % 8 as int)), 0) = 1"))
    return marked.where("__hit").select(*rows.columns), marked.where("not __hit").select(*rows.columns), known


def with_ids(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """The rows whose ``col`` is among ``ids``, a table of one column; nulls equal each other."""
    some, _, known = _split(rows, ids, col)
    return some.join(known, F.col(col).eqNullSafe(F.col("__id")), "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """The rows whose ``col`` is not among ``ids``, a table of one column; nulls equal each other."""
    some, others, known = _split(rows, ids, col)
    return others.unionByName(some.join(known, F.col(col).eqNullSafe(F.col("__id")), "left_anti"))
