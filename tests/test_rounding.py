"""Thresholds and unit vectors equal their SQL to the last bit."""

import datetime

import duckdb
import pytest

from veloquent.plans import registry


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("rounding"))
    quantile = duckdb.execute("SELECT quantile_cont(x, 0.95) FROM (SELECT unnest([5.0, 9.0, 10.0, 56.04, 64.53]::DOUBLE[]) AS x)").fetchone()[0]
    plain = (4 - 3.8) * 56.04 + (3.8 - 3) * 64.53
    assert 0.1 * quantile != 0.1 * plain
    rows = [(0, min(0.1 * quantile, 0.1 * plain)), (1, max(0.1 * quantile, 0.1 * plain)), (2, 10.0), (3, 56.04), (4, 64.53), (5, None)]
    spark.createDataFrame([(i, datetime.datetime(2024, 1, 1), 1, "view", v, "{}") for i, v in rows], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    vectors = [[1.0, -1e-7, 1e-7, 0.0, -0.0], [0.5, 0.5, -0.5, -0.5, 1e-9], [0.0, 0.0, -0.0, 0.0, 0.0], [3.0, None, -4.0, 0.0, 0.0], [float("inf"), 1.0, float("nan"), 0.0, 0.0]]
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name, table", [("agg_pctl_threshold", "events"), ("fn_l2", "embeddings")])
def test_same_bits(spark, data, name, table):
    got = registry.queries()[name](spark, data)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet/*.parquet'")
    want = db.execute(registry.oracle_sql()[name]).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
