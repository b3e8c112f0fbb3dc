"""One-to-one assignment of a chunk's speakers to clusters, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Who has no cluster, because all are taken.
NONE = -2
#: Millionths: what a speaker without activity scores everywhere, and what a speaker without a cluster scores. Cosines are raised by one, so that both lie below them.
SILENT, UNASSIGNED = -3_000_000, -10_000_000


def assign(scores: DataFrame, keys: list[str], sides: int) -> DataFrame:
    """``(*keys, side, cluster)`` of the largest summed score, no cluster twice in a group; ties go to the smaller clusters of the earlier sides.

    ``scores`` is ``(*keys, side, cluster, score)`` with whole scores of zero or more, ``SILENT`` for a speaker without activity, in groups of at most ``sides`` speakers. If clusters are fewer than
    speakers, as many as can be are assigned, silent ones last; the others get ``NONE``. Only a speaker's ``sides`` best clusters are compared, however many there are: the others of its group can hold all but one of
    them, so a worse one is never needed. The work of a group is bounded by the speakers' number alone. Rows without a cluster or score are left out.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("cost"), F.col("cluster").cast("bigint").alias("cluster"))))
    speakers = scores.where("cluster is not null and score is not null").groupBy(*keys, "side").agg(F.slice(ranked, 1, sides).alias("near"))
    none = F.struct(F.lit(-UNASSIGNED).cast("bigint").alias("cost"), F.lit(NONE).cast("bigint").alias("cluster"))
    speakers = speakers.withColumn("near", F.concat("near", F.array(none)))
    groups = speakers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("side", "near"))).alias("s"))
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("cost"), F.array().cast("array<bigint>").alias("picks")))

    def more(found, speaker):
        free = lambda at: F.filter(speaker["near"], lambda c: (c["cluster"] == NONE) | ~F.array_contains(at["picks"], c["cluster"]))
        return F.flatten(F.transform(found, lambda at: F.transform(free(at), lambda c: F.struct((at["cost"] + c["cost"]).alias("cost"), F.concat(at["picks"], F.array(c["cluster"])).alias("picks")))))

    best = groups.select(*keys, F.col("s.side").alias("side"), F.array_min(F.aggregate("s", start, more)).alias("best"))
    return best.select(*keys, F.explode(F.arrays_zip("side", F.col("best.picks").alias("cluster"))).alias("e")).select(*keys, "e.side", "e.cluster")
