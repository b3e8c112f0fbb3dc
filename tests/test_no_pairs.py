"""Joins of segments whose work grows with the rows, not with the pairs that overlap."""

import datetime
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from veloquent.operators.intervals import interval_join
from veloquent.plans import registry

NAMES = ["join_interval_vote", "join_prefix_fix", "join_word_speaker", "join_mid_block", "join_participants", "join_closest_clean"]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Crowded, equal, touching and lone segments across bucket borders, with ties of every kind, and null keys."""
    folder, r = str(tmp_path_factory.mktemp("crowded")), random.Random(3)
    start, kinds = datetime.datetime(2024, 1, 1), ("view", "click", "purchase", "error", "signup")
    ticks = [lambda: r.randrange(40), lambda: 15_980 + r.randrange(40), lambda: r.randrange(0, 120_000, 50), lambda: r.randrange(120_000)]
    rows = []
    for i in range(3000):
        kind = kinds[0] if i % 97 == 0 else r.choice(kinds)
        value = r.choice([0.0, 0.03, 0.1, 0.5, 2.0, r.random(), r.random() * 5, r.random() * 300]) - (i % 41 == 0)
        user = None if i % 211 == 0 else 32 * r.randrange(9) + (0 if i % 3 else r.randrange(32))
        rows.append((i, start + datetime.timedelta(seconds=4 * r.choice(ticks)()), user, kind, value, "{}"))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_crowded_files_give_the_rows_of_sql(spark, data, name):
    got = registry.queries()[name](spark, data)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet/*.parquet'")
    db.execute(f"CREATE TABLE o AS {registry.oracle_sql()[name]}")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM o").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["join_interval_vote", "join_participants"])
def test_segments_without_a_number_or_with_the_same_one(spark, tmp_path, name):
    start, rows = datetime.datetime(2024, 1, 1), []
    for i, (number, tick, user, kind, value) in enumerate([(1, 0, 0, "error", 3.0), (2, 100, 32, "error", 9.0), (3, 50, 0, "view", 2.0), (3, 400, 0, "view", 4.0), (None, 30, 0, "click", 1.0), (None, 31, 0, "click", 1.0), (4, 5000, 0, "view", 1.0)]):
        rows.append((number, start + datetime.timedelta(seconds=4 * tick), user, kind, value, "{}"))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    db.execute(f"CREATE TABLE o AS {registry.oracle_sql()[name]}")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(db.execute(f"SELECT {', '.join(got.columns)} FROM o").fetchall(), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_no_segments_meet_in_pairs(spark, data, name):
    """No join compares times: a join's condition names equal keys alone."""
    nodes = registry.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [n for n in nodes if re.match(r"[\s:+-]*Join", n)]
    assert not [n for n in joins if " < " in n or " > " in n or "<=" in n or ">=" in n]


def test_speech_is_dealt_to_few_buckets(spark, monkeypatch):
    """join_clip_speech's rows are pairs; what it shuffles is segments, fewer than two copies of each."""
    from veloquent.plans import timeline

    asked, sf = [], "/root/testdata/sf0.01"
    monkeypatch.setattr(timeline, "interval_join", lambda *a, **k: asked.append(a[3]) or interval_join(*a, **k))
    assert registry.queries()["join_clip_speech"](spark, sf).columns == ["file_id", "pos", "region", "speaker", "start_ms", "end_ms"]
    copies = F.floor((F.col("end_ms") - 1) / asked[0]) - F.floor(F.col("start_ms") / asked[0]) + 1
    assert timeline.diar(spark, sf, dense=True).select(F.avg(copies)).first()[0] < 2
