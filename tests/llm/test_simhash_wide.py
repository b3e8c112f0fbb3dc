"""Wide SimHash: fingerprints, links and groups against brute force."""

import random

import numpy as np
import pytest

from test_simhash import DOCS, closure

from veloquent.llm import simhash_wide
from veloquent.llm.components import connected_components
from veloquent.llm.scratch import materialize
from veloquent.llm.simhash_wide import MARKS, _possible, distance_limit, parities, plan, reach, shingle_hashes, similar, similar_components, similar_dedup, wide_fingerprint, wide_fingerprints, wide_links


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def edited(rng, text, share):
    out = list(text)
    for i in rng.sample(range(len(out)), max(1, int(share * len(out)))):
        out[i] = "new" + str(rng.random())
    return out


def jaccard(a, b, k=5):
    x, y = ({tuple(t[i : i + k]) for i in range(max(1, len(t) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def ring(rng, base, n):
    """Texts that each differ from the base in some places of their own."""
    return [edited(rng, base, share) for share in (0.004, 0.008, 0.012, 0.016, 0.024) for _ in range(n)]


@pytest.mark.parametrize("bucket_limit,part", [(64, 512), (4, 8)])
def test_links_are_the_similar_pairs(spark, bucket_limit, part):
    """The small limits send the group of 100 through the large buckets' way."""
    rng = random.Random(5)
    texts = [t for _ in range(30) for t in ring(rng, words(rng, rng.randint(60, 300)), 1)] + ring(rng, words(rng, 150), 20) + [words(rng, 80) for _ in range(100)]
    docs = spark.createDataFrame([(i, " ".join(t), i, "x") for i, t in enumerate(texts)], DOCS)
    table = wide_fingerprints(docs)
    near = [(i, j) for i, a in enumerate(texts) for j in range(i) if abs(len(a) - len(texts[j])) < 80 and jaccard(a, texts[j]) >= 0.8]
    edges = [(r.a, r.b) for r in wide_links(table, docs, 0.8, bucket_limit=bucket_limit, part=part).collect()]
    assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in edges)
    got, want = closure(edges, range(len(texts))), closure(near, range(len(texts)))
    assert len(near) > 500 and sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near)
    assert all(want[a] == want[b] for a, b in edges)
    found = {r.node: r.component for r in connected_components(wide_links(table, docs, 0.8, bucket_limit=bucket_limit, part=part)).collect()}
    assert all(found.get(n, n) == got[n] for n in range(len(texts)))


def test_similarity_counts_in_whole_numbers(spark):
    sets = spark.createDataFrame([(1, list(range(9))), (2, list(range(8)) + [20]), (3, list(range(10))), (4, list(range(8)))], "id bigint, s array<bigint>")
    pairs = spark.createDataFrame([(2, 1), (3, 4), (4, 1), (3, 2)], "a bigint, b bigint")
    assert sorted((r.a, r.b) for r in similar(pairs, sets, 0.8).collect()) == [(2, 1), (3, 4), (4, 1)]


def test_parities_refuse_no_similar_pair(spark):
    """Pairs around the similarity: none at 0.8 or more is refused, and of those below 0.7 none gets by."""
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**63), 2**63, 600)
    rows = [(i, np.r_[base[: 200 - i], base[200 : 200 + i // 2], rng.integers(-(2**63), 2**63, i % 7)].tolist()) for i in range(60)] + [(60, [])]
    marks = parities(spark.createDataFrame(rows, "id bigint, s array<bigint>"))
    other = marks.withColumnsRenamed({"id": "b", "k": "l", **{x: x.replace("x", "y") for x in MARKS}})
    left = {(r.id, r.b) for r in marks.join(other, marks.id > other.b).where(_possible(0.8)).select("id", "b").collect()}
    share = {(a, b): len(set(x) & set(y)) / max(len(set(x) | set(y)), 1) for a, x in rows for b, y in rows if a > b}
    assert {p for p, j in share.items() if j >= 0.8} <= left and not any(share[p] < 0.7 for p in left)
    assert 100 < len(left) < len(share)


def test_few_pairs_come_out_of_a_large_group(spark):
    """Texts that lie within reach of one another but below the similarity: their pairs are refused where they meet."""
    rng = random.Random(4)
    base = words(rng, 150)
    texts = [edited(rng, base, 0.027) for _ in range(150)]
    docs = spark.createDataFrame([(i, " ".join(t), i, "x") for i, t in enumerate(texts)], DOCS)
    near = sum(jaccard(a, b) >= 0.8 for i, a in enumerate(texts) for b in texts[:i])
    assert near < 200 and all(0.7 < jaccard(base, t) < 0.85 for t in texts)
    asked = []
    similar_, simhash_wide.similar = simhash_wide.similar, lambda pairs, *rest: asked.append(pairs.count()) or similar(pairs, *rest)
    try:
        links = wide_links(wide_fingerprints(docs), docs, 0.8, bucket_limit=4, part=16).collect()
    finally:
        simhash_wide.similar = similar_
    assert all(jaccard(texts[r.a], texts[r.b]) >= 0.8 for r in links)
    assert asked[-1] < 2000  # of 11,175


def test_few_pairs_come_out_of_small_buckets(spark, monkeypatch):
    """The same texts in buckets of the usual limit: the parities refuse pairs in the join of the buckets' rows, before any set is read."""
    rng = random.Random(4)
    base = words(rng, 150)
    texts = [edited(rng, base, 0.027) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(t), i, "x") for i, t in enumerate(texts)], DOCS)
    near = {(i, j) for i, a in enumerate(texts) for j in range(i) if jaccard(a, texts[j]) >= 0.8}
    seen = []
    monkeypatch.setattr(simhash_wide, "materialize", lambda df: seen.append(df) or materialize(df))
    links = {(r.a, r.b) for r in wide_links(wide_fingerprints(docs), docs, 0.8).collect()}
    met = [{(r.a, r.b) for r in df.collect()} for df in seen if df.columns == ["a", "b"]][0]
    assert links <= near and links <= met and len(met) < 300  # of 1,770


def test_segments_keep_the_recall_at_the_limit():
    rng = np.random.default_rng(3)
    for n in (1000, 100_000):
        bits, count = plan(n, 38)
        segments = [rng.permutation(256)[:bits] for _ in range(count)]
        hits = 0
        for _ in range(400):
            differ = np.zeros(256, bool)
            differ[rng.permutation(256)[:38]] = True
            hits += any(not differ[s].any() for s in segments)
        assert hits >= 0.91 * 400


def test_distance_tells_the_similarity():
    rng = random.Random(2)
    for share in (0.005, 0.01, 0.1, 0.3):
        a = words(rng, 600)
        b = edited(rng, a, share)
        j = jaccard(a, b)
        d = sum(int(x ^ y).bit_count() for x, y in zip(*(map(int, wide_fingerprint(shingle_hashes(" ".join(t)))) for t in (a, b))))
        expect = 256 * np.arccos(2 * j / (1 + j)) / np.pi
        assert abs(d - expect) <= 4 * np.sqrt(expect * (1 - expect / 256)) + 1, (share, j, d, expect)
    assert distance_limit(0.8) == 38 and reach(0.8) == 52


def test_groups_of_near_copies(spark):
    rng = random.Random(11)
    texts = [words(rng, rng.randint(200, 500)) for _ in range(60)]
    near = [edited(rng, t, 0.01) for t in texts[:20]]
    half = [t[: len(t) // 2] + words(rng, len(t) // 2) for t in texts[20:40]]
    assert all(jaccard(a, b) > 0.85 for a, b in zip(texts, near)) and all(jaccard(a, b) < 0.5 for a, b in zip(texts[20:], half))
    rows = [(i, " ".join(t), 7, "x") for i, t in enumerate(texts + near + half)]
    rows += [(200, None, 7, "x"), (201, "", 7, "x"), (202, " \t\n", 7, "x"), (203, "a b", 7, "x"), (204, "A  b", 7, "x"), (None, " ".join(texts[0]), 7, "x"), rows[3]]
    rows += [(205, " ".join(words(rng, 40_000)), 7, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.id: r.component for r in similar_components(docs).collect() if r.id is not None}
    assert all(got[60 + i] == i for i in range(20))
    assert all(got[i] == i for i in [*range(60), *range(80, 100), 200, 203, 205])
    assert got[201] == got[202] == 200 and got[204] == 203
    kept = similar_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [*range(60), *range(80, 100), 200, 203, 205, None]))


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert similar_components(empty).count() == 0 and similar_dedup(empty).count() == 0
