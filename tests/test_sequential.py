"""Sequential operators on hand-made files and against plain loops."""

import random

import pytest

from veloquent.operators import alignment as A
from veloquent.operators import clustering as C
from veloquent.operators import scans as S
from veloquent.operators.intervals import as_of, interval_join
from veloquent.operators.turns import natural_turns
from veloquent.streaming.endpoint import advance, endpoints
from veloquent.streaming.run import drain


def labels(df):
    return [r["speaker"] for r in df.orderBy("start_ms", "pos").collect()]


def seg(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], S.SEGMENTS)


def test_island_is_absorbed_and_chains_read_updated_labels(spark):
    rows = [(0, 0, 5000, 9, True), (1, 5000, 5500, 2, False), (0, 5600, 9000, 9, True), (1, 9000, 9300, 1, False), (0, 9400, 12000, 9, True)]
    assert labels(S.smooth_speakers(seg(spark, rows))) == [0] * 5


def test_lead_singleton_and_trailing_particle(spark):
    lead = [(0, 0, 3000, 9, True), (0, 4500, 4900, 1, False), (1, 6000, 9000, 9, True)]
    assert labels(S.smooth_speakers(seg(spark, lead))) == [0, 1, 1]
    tail = [(0, 0, 3000, 9, False), (0, 3000, 6000, 9, False), (1, 6100, 6500, 1, True)]
    assert labels(S.smooth_speakers(seg(spark, tail))) == [0, 0, 0]


def test_natural_turn(spark):
    rows = [(0, 0, 4000, 20, True), (1, 2000, 2500, 1, True), (0, 4500, 9000, 20, True), (1, 12000, 16000, 20, True)]
    assert labels(natural_turns(seg(spark, rows))) == [0, 0, 0, 1]
    assert labels(natural_turns(seg(spark, rows[:2]))) == [0, 1]
    assert natural_turns(seg(spark, rows).limit(0)).count() == 0


def plain_turns(rows, words, few):
    """Labels of one file's (pos, speaker, start, end): turns in order, each marking what it absorbs."""
    if len(rows) < 3:
        return {p: s for p, s, _, _ in rows}
    turns = []
    for who in {r[1] for r in rows}:
        own, last = [], None
        for p, _, a, b in sorted((r for r in rows if r[1] == who), key=lambda r: (r[2], r[0])):
            if last is None or a - last >= 2000:
                own.append([a, b, who, []])
            own[-1][1], last = max(own[-1][1], b), max(own[-1][1], b)
            own[-1][3].append(p)
        turns += own
    turns.sort(key=lambda t: (t[0], t[2]))
    host = [None] * len(turns)
    for i, t in enumerate(turns):
        if host[i] is None:
            for j in range(i + 1, len(turns)):
                if host[j] is None and turns[j][1] <= t[1] and turns[j][2] != t[2]:
                    host[j] = i
    named = {p: s for p, s, _, _ in rows}
    for t, h in zip(turns, host):
        if h is not None and t[1] - t[0] < 2000 and sum(t[0] <= (a + b) / 2 <= t[1] for a, b in words) <= few:
            named |= {p: turns[h][2] for p in t[3]}
    return named


def test_natural_turns_equal_a_pass_in_order(spark):
    rng = random.Random(5)
    rows, words, want, moved = [], [], {}, 0
    for f in range(40):
        count = rng.choice([1, 2, 5, 30, 80])
        own = [(p, rng.randrange(4), s := rng.randrange(0, 500 * count, 100), s + rng.choice([100, 300, 900, 1500, 6000])) for p in range(count)]
        said = [(s := rng.randrange(0, 500 * count, 50), s + rng.randrange(0, 400, 25)) for _ in range(2 * count)]
        rows += [(f, *r) for r in own]
        words += [(f, *w) for w in said]
        named = plain_turns(own, said, 3)
        moved += sum(named[p] != s for p, s, _, _ in own)
        want |= {(f, p): s for p, s in named.items()}
    table = spark.createDataFrame(rows, "file_id bigint, pos bigint, speaker bigint, start_ms bigint, end_ms bigint")
    got = natural_turns(table, spark.createDataFrame(words, "file_id bigint, start_ms bigint, end_ms bigint"), width=1000)
    assert {(r.file_id, r.pos): r.speaker for r in got.collect()} == want and moved > 20


def test_chunk_plan(spark):
    quiet = [(1, i, a, b) for i, (a, b) in enumerate([(28_500, 29_500), (31_000, 31_400), (40_000, 40_100), (90_000, 90_000)])]
    got = S.plan_chunks(spark.createDataFrame(quiet, "file_id bigint, pos bigint, start_ms bigint, end_ms bigint")).orderBy("chunk_no").collect()
    assert [(r["start_ms"], r["end_ms"]) for r in got] == [(0, 29_000), (26_000, 59_000), (56_000, 89_000), (86_000, 90_000)]


def test_line_packing(spark):
    lines = spark.createDataFrame([(1, i, 99) for i in range(30)], "file_id bigint, pos bigint, n_chars bigint")
    got = S.pack_lines(lines, 1000, 5).orderBy("chunk_no").collect()
    assert [(r["first_line"], r["after_line"]) for r in got] == [(0, 10), (5, 15), (10, 20), (15, 25), (20, 30)]


def test_overlap_and_merge(spark):
    w = lambda s, p=0.5: [(x, p) for x in s.split()]
    assert A.best_overlap(w("a b c d"), w("c d e")) == (2, 0, 2)
    assert A.best_overlap(w("a b c x", 0.9), w("b c d")) == (2, 0, 3)  # the tail's rest is more probable: the head goes
    assert A.best_overlap(w("a b c x"), w("b c d")) == (2, 4, 0)
    rows = [(1, 0, "a b c d e".split(), [0.5] * 5), (1, 1, "d e f g".split(), [0.5] * 4), (1, 2, "g h".split(), [0.5] * 2)]
    got = A.merge_chunks(spark.createDataFrame(rows, "file_id bigint, chunk_no bigint, words array<string>, probs array<double>")).first()
    assert got["text"] == "a b c d e f g h"


def test_rover(spark):
    w = lambda s, c: [(x, 300 * i, c) for i, x in enumerate(s.split())]
    rows = [(1, 1, w("the cat sat", 0.5), w("the bat sat down", 0.9)), (1, 2, w("x y", 0.5), [])]
    kind = "file_id bigint, pos bigint, a array<struct<text string, start_ms bigint, conf double>>, b array<struct<text string, start_ms bigint, conf double>>"
    got = {r["pos"]: (r["text"], r["n_disagree"]) for r in A.rover(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ("the bat sat down", 2), 2: ("x y", 0)}


def test_words_match(spark):
    pairs = [("abc", "abc", True), ("abcd", "bcd", True), ("ab", "b", False), ("hello", "hallo", True), ("hello", "world", False), ("", "a", False), (None, "a", False)]
    got = A.words_match(spark.createDataFrame([p[:2] for p in pairs], "a string, b string"), "a", "b").collect()
    assert {(r["a"], r["b"]): r["hit"] for r in got} == {p[:2]: p[2] for p in pairs}


def test_trie_pays_for_whole_phrases_only():
    trie = A.Trie({("a", "b"): 1.5, ("b", "c"): 2.0})
    assert trie.score(["a", "b"]) == 3.0 and trie.score(["a"]) == 0.0 and trie.score(["a", "x"]) == 0.0
    assert trie.score(["b", "c", "a", "b"]) == 7.0


def test_sentences(spark):
    row = (1, "so the cat sat on the mat and slept".split(), ["The cat sat.", "On a mat and slept."])
    got = A.align_sentences(spark.createDataFrame([row], "file_id bigint, words array<string>, sentences array<string>")).orderBy("sentence").collect()
    assert (got[0]["first_word"], got[0]["after_word"], got[0]["matched"]) == (1, 4, True) and got[1]["first_word"] == 4


@pytest.mark.parametrize("method", ["spectral", "merge"])
def test_clusters_of_clear_groups(spark, method):
    rng = random.Random(1)
    rows = [(1, i, [(1.0 if j == i % 3 else 0.0) + rng.gauss(0, 0.02) for j in range(8)]) for i in range(45)] + [(1, 99, None)]
    got = {r["pos"]: r["cluster"] for r in C.cluster(spark.createDataFrame(rows, "file_id bigint, pos bigint, vec array<double>"), method).collect()}
    assert got == {i: i % 3 for i in range(45)}


def test_interval_join_and_as_of(spark):
    rng = random.Random(2)
    a = [(rng.randrange(3), i, s := rng.randrange(500), s + rng.randrange(1, 90)) for i in range(80)]
    b = [(rng.randrange(3), i, s := rng.randrange(500), s + rng.randrange(1, 90)) for i in range(80)]
    left = spark.createDataFrame(a, "file_id bigint, pos bigint, start_ms bigint, end_ms bigint")
    right = spark.createDataFrame(b, "file_id bigint, r_pos bigint, r_start bigint, r_end bigint")
    got = sorted((r["pos"], r["r_pos"]) for r in interval_join(left, right, "file_id", 50).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    times = right.selectExpr("file_id", "r_pos as pos", "r_end as t", "r_pos as found")
    near = {r["pos"]: r["found"] for r in as_of(left, times, "file_id", "start_ms", "t", ["found"]).collect()}
    for f, i, s, _ in a:
        before = [(y[3], -y[1]) for y in b if y[0] == f and y[3] <= s]
        assert near[i] == (-max(before)[1] if before else None)


def test_endpoints(spark, tmp_path):
    speech = [0, 1, 1, 0, 0, 0, 1, 0, 1, 1, 1, 1, 1, 1, 0]
    state, want = (-1, -1, 0, 0), []
    for i, s in enumerate(speech):
        state, done = advance(state, i, bool(s), 2, 6)
        want += [done] if done else []
    assert want == [(1, 2, "silence"), (6, 12, "length")]
    rows = [(k, i, bool(s)) for k in (1, 2) for i, s in enumerate(speech)]
    spark.createDataFrame(rows, "stream_id bigint, frame bigint, speech boolean").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("stream_id bigint, frame bigint, speech boolean").parquet(f"{tmp_path}/in")
    got = sorted(tuple(r) for r in drain(endpoints(stream, 2, 6)).collect())
    assert got == [(k, *w) for k in (1, 2) for w in want]
