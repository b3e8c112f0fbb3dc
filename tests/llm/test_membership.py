"""Rows with and without ids against plain joins; most texts stay where they are."""

from pyspark.sql import functions as F

from veloquent.llm.membership import _split, with_ids, without_ids


def test_rows_by_ids(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 997 > 0, F.col("id")).alias("id"), F.lit("text").alias("text"))
    for ids in (rows.where("id % 7 = 0").select("id"), rows.where("id is null").select("id"), rows.select("id"), rows.where("id < 0").select("id")):
        same = rows.id.eqNullSafe(F.col("other"))
        other = ids.distinct().select(F.col("id").alias("other"))
        for got, kind in ((with_ids(rows, ids, "id"), "left_semi"), (without_ids(rows, ids, "id"), "left_anti")):
            assert sorted(got.collect(), key=str) == sorted(rows.join(other, same, kind).collect(), key=str)
    some, others, known = _split(rows, rows.where("id % 7 = 0").select("id"), "id")
    assert some.count() + others.count() == 20_000 and some.count() < 1.4 * known.count()
