"""Plans that keep a task's memory and a row's cost small."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from veloquent.operators import alignment
from veloquent.plans import registry
from veloquent.plans.text import words

DATA = "/root/testdata/sf0.001"


def plan(df) -> list[str]:
    """Nodes of the analysed and optimised plan, the last one that runs first."""
    return [line.strip(" :+-") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]


def first(nodes: list[str], *names: str) -> int:
    return next((i for i, n in enumerate(nodes) if n.startswith(names)), len(nodes))


def test_words_become_python_objects_a_few_blocks_at_a_time(spark):
    assert not any("MapInPandas" in n for n in plan(registry.queries()["aln_rover"](spark, DATA)))


def test_far_words_are_never_compared(monkeypatch):
    asked, alike = [], alignment.alike
    monkeypatch.setattr(alignment, "alike", lambda *a: asked.append(a) or alike(*a))
    tail = [(a + b, 0.5) for a in "abcde" for b in "fghij"]
    head = [(a + b, 0.5) for a in "klmno" for b in "pqrst"]
    assert alignment.best_overlap(tail, head + tail)[0] == 25
    assert len(asked) < 60


def test_chunks_of_many_texts_share_a_pass(spark):
    for name in ("aln_merge_chunks", "set_chunk_union"):
        assert not any("FlatMapGroupsInPandas" in n for n in plan(registry.queries()[name](spark, DATA)))


def test_words_are_neither_sorted_nor_grouped(spark):
    for name in ("set_unique_match", "fn_words_match", "fn_words_match_native"):
        nodes = plan(registry.queries()[name](spark, DATA))
        assert first(nodes, "Generate") < first(nodes, "Window", "Aggregate", "Sort"), name


def test_turns_that_share_a_number(spark, tmp_path):
    rows = [(1, 2, "u", "a b c"), (1, 2, "v", "x"), (1, 2, "w", None), (1, 1, "u", " p  q"), (1, 3, "u", "z"), (2, 1, "u", "")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = words(spark, str(tmp_path), following=True).orderBy("pos").select("pos", "speaker", "text", "following").collect()
    assert [tuple(r) for r in got] == [(1, "u", "p", "q"), (2, "u", "q", "a"), (3, "u", "a", "x"), (4, "v", "x", "b"), (5, "u", "b", "c"), (6, "u", "c", "z"), (7, "u", "z", None)]


def test_texts_are_neither_sorted_nor_held(spark):
    """Texts meet the counts of words in a hash join; windows lie below it, on the counts' side."""
    for following in (True, False):
        nodes = plan(words(spark, DATA, following=following))
        at = first(nodes, "Join")
        assert at < first(nodes, "Window", "Sort") and "strategy=shuffle_hash" in nodes[at]


def test_words_of_null_keys_and_texts(spark, tmp_path):
    rows = [(None, 1, "u", "a b"), (None, None, "u", "c"), (3, None, None, "d"), (3, 1, "v", None), (3, 2, "v", "  "), (3, 2, "w", "e")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = words(spark, str(tmp_path), following=True).select("file_id", "pos", "speaker", "text", "following").collect()
    want = [(None, 1, "u", "c", "a"), (None, 2, "u", "a", "b"), (None, 3, "u", "b", None), (3, 1, None, "d", "e"), (3, 2, "w", "e", None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_following_word(spark):
    w = words(spark, DATA, following=True)
    w = w.withColumn("lead", F.lead("text").over(Window.partitionBy("file_id").orderBy("pos")))
    assert w.where(~F.col("following").eqNullSafe(F.col("lead"))).count() == 0


def test_rows_of_a_key_need_no_sorted_frame(monkeypatch):
    import pandas as pd

    from veloquent.streaming.policies import _in_order

    parts = [pd.DataFrame({"at": pd.to_datetime([2, 1]), "at_ms": [2, 1], "event_id": [1, 5]}), pd.DataFrame({"at": pd.to_datetime([1]), "at_ms": [1], "event_id": [2]})]
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    assert [(r.at_ms, r.event_id) for r in _in_order(iter(parts))] == [(1, 2), (1, 5), (2, 1)]


def test_equal_ends_of_chunks_need_no_comparison(monkeypatch):
    """Where all words of tail and head are the same no pairs are formed, and the result is that of the pairs."""
    side = [(a + b, 0.5) for a in "abc" for b in "xyz"]
    monkeypatch.setattr(alignment, "_pairs_alike", lambda a, b: 1 / 0)
    assert alignment.best_overlap(side, side) == (9, 0, 9)
    assert alignment._reach("abcdefghijkl", range(12), 3600, 300, True, 3000) == list(zip("cdefghijkl", range(2, 12)))
    assert alignment._reach("abcdefghijkl", range(12), 0, 300, False, 2900) == list(zip("abcdefghij", range(10)))
