"""Joins of segments meet in 32 dense files: every 32nd user shares one."""

import datetime

import pytest

from veloquent.plans import registry

NAMES = [
    "join_interval_vote",
    "join_word_speaker",
    "join_prefix_fix",
    "join_clip_speech",
    "join_mid_block",
    "join_overlap_partner",
    "join_participants",
    "join_closest_clean",
    "join_dedup_supplement",
    "win_trail_particle",
]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("dense"))
    start = datetime.datetime(2024, 1, 1)
    kinds = ("view", "purchase", "error", "click")
    rows = [(i, start + datetime.timedelta(seconds=800 * (i // 2)), 32 * (i % 3) + 5, kinds[i % 4], 0.5 + i // 2 % 7, "{}") for i in range(24)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_every_32nd_user_shares_a_file(spark, data, name):
    assert {r.file_id for r in registry.queries()[name](spark, data).collect()} == {5}
