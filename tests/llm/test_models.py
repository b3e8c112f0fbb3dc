"""Embedding dedup, packing and language-model scores against brute force."""

import math
import random
import tempfile
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veloquent.llm import embed_dedup as E
from veloquent.llm import ngram_lm as L
from veloquent.llm import packing as P

VECTORS = "vec_id bigint, embedding array<float>, label int, rep string, v string"


def brute(rows, threshold=0.95):
    good = {}
    for i, (_, v, *_rest) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(float)
            good[i] = a / np.linalg.norm(a)
    near = [(i, j) for i in good for j in good if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold]
    root = {i: i for i in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in near:
        root[find(i)] = find(j)
    links = Counter(x for p in near for x in p)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], links[i], min(groups[find(i)])) for i in range(len(rows))]


def vectors(block_of=60):
    rng = np.random.default_rng(1)
    rows = [(1000 + i, [float(x) for x in rng.standard_normal(16)], 0, "", "") for i in range(120)]
    base = rng.standard_normal(16)
    rows += [(2000 + i, [float(x) for x in base + 0.03 * rng.standard_normal(16)], 1, "", "") for i in range(block_of)]
    rows += [(3000 + i, rows[5][1], 2, "", "") for i in range(50)]
    rows += [(4000, None, 0, "", ""), (4001, [], 0, "", ""), (4002, [0.0] * 16, 0, "", ""), (4003, [float("nan")] + [1.0] * 15, 0, "", ""), (4004, [float("inf")] * 16, 0, "", ""), (4005, [None] * 16, 0, "", ""), (4006, [1.0, 2.0], 0, "", ""), (4007, [2.0, 4.0], 0, "", ""), (4008, [-0.0, 1.0], 0, "", ""), (4009, [0.0, 1.0], 0, "", "")]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = vectors()
    got = sorted(tuple(r) for r in E.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == sorted(brute(rows))


def test_doubles_empty_and_repeated_ids(spark):
    kind = "vec_id bigint, embedding array<double>"
    assert E.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    got = E.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1e-300]), (3, [0.0, 1e300])], kind)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (1, 1, 1), (2, 1, 2), (3, 1, 2)]


def test_plan_keeps_recall():
    for n in (10, 10**5, 10**9):
        bits, tables = E.plan(n, 0.95)
        assert 1 - (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables >= E.RECALL


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_vocabulary_file(text):
    path = public_tokenizers.path(P.VOCABULARY)
    assert P.encode(text, path, public_tokenizers.path(P.RANKS)) == P._reference(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [None, "", "a" * 5000, " " * 3000, "x<|endoftext|>y", "é́" * 50, "\n\n \t" * 40])
def test_ids_of_odd_texts(text):
    path = public_tokenizers.path(P.VOCABULARY)
    assert P.encode(text, path, public_tokenizers.path(P.RANKS)) == Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_ids_across_the_length_at_which_the_library_changes():
    path = public_tokenizers.path(P.VOCABULARY)
    for n in (P.LONG, P.LONG + 1):
        text = ("some words, 42 and more é\n" * (n // 20))[:n]
        assert P.encode(text, path, public_tokenizers.path(P.RANKS)) == P._fast(public_tokenizers.path(P.RANKS)).encode_ordinary(text)


def test_search_goes_on_to_the_end():
    rng = random.Random(5)
    for n in (300, 4000):
        sizes = [rng.randint(150, 500) for _ in range(n)]
        search = P.Search(sizes, P.best_fit(sizes))
        bins = search.run()
        assert len(bins) < len(P.best_fit(sizes))
        assert len(bins) == -(-sum(sizes) // 1024) or not any(search.step(b) for b in list(search.bins) if search.gap[b] > 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_packing_holds_everything(sizes):
    bins = P.pack_sizes(sizes, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= len(P.best_fit(sizes, 64))


def test_search_beats_best_fit():
    sizes = [6, 6, 5, 5, 5, 3]  # of 15: best fit needs three, two hold them
    start = [[0, 1, 5], [2, 3, 4]]
    assert len(P.Search(sizes, [[0, 1], [2, 3, 5], [4]], 15).run()) == len(start)


def test_packed_documents(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(int(rng.expovariate(1 / 300)))), 0, "x") for i in range(300)]
    rows += [(900, None, 1, "x"), (901, "", 1, "x"), (None, "null id", 1, "x"), (5, rows[5][1], 1, "x"), (902, " ".join(word() for _ in range(20000)), 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int, offset string")
    got = P.pack_documents(docs, with_ids=True).collect()
    path = public_tokenizers.path(P.VOCABULARY)
    want = Counter()
    for i, t, *_ in rows:
        ids = [*P._reference(path).encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for k, at in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[at : first if not k else at + 1024]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        spans.sort()
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 1024
    total = sum(r["length"] for r in got)
    assert len(bins) <= 1.01 * total / 1024 + 2
    assert P.pack_documents(spark.createDataFrame([], docs.schema)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300), st.data())
def test_elias_fano(values, data):
    values = np.array(sorted(values), np.uint64)
    ef = L.EliasFano.build(values, 1 << 40 | 1)
    a = data.draw(st.integers(0, len(values)))
    b = data.draw(st.integers(a, len(values)))
    assert (ef.slice(a, b) == values[a:b]).all()


def test_codes():
    n = np.array([0, 1, 2, 3, 1000, 10**12])
    assert np.allclose(L.from_codes(L.to_codes(n)), n, rtol=0.006) and L.to_codes(n)[0] == 0 < L.to_codes(n)[1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9), st.integers(0, 5)), max_size=200), st.integers(1, 50))
def test_trie(grams, block):
    counts = Counter((w << 57 | 5, b << 20, s) for w, b, s in grams)
    rows = sorted(counts)
    word, first, second = (np.array([r[k] for r in rows], t) for k, t in enumerate((np.uint64, np.uint32, np.uint32)))
    known = L.Frequent(*(np.empty(0, np.uint64) for _ in range(3)), np.empty(0, np.int64), np.empty(0))
    with tempfile.TemporaryDirectory() as folder:
        n = np.array([counts[r] for r in rows], np.uint32)
        trie, words, count = L._build(folder, word, (first, second), n, known)
        asked = sorted(set(rows) | {(w, b, 77) for w, b, _ in rows} | {(w, 1 << 31, s) for w, _, s in rows} | {(w + 1, b, s) for w, b, s in rows})
        columns = [np.array([r[k] for r in asked], t) for k, t in enumerate((np.uint64, np.uint32, np.uint32))]
        got = L.from_codes(L.Trie(folder).find(columns[0], columns[1:], block))
    want = [[sum(c for g, c in counts.items() if g[: k + 1] == r[: k + 1]) for r in asked] for k in range(3)]
    assert np.allclose(got, np.array(want).reshape(3, -1), rtol=0.006)
    assert dict(zip(words.tolist(), count.tolist())) == {w: sum(c for g, c in counts.items() if g[0] == w) for w in {r[0] for r in rows}}


def score(rows, held=None):
    tokens = [[*(t or "").encode().lower().split(), "end"] for _, t, *_ in rows]
    held = held or [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, *_ in rows]
    c, starts = Counter(), 0
    for w, h in zip(tokens, held):
        if not h:
            starts += 1
            for g in zip(["start", "start", *w], ["start", *w], w):
                c.update([g[2:], g[1:], g])
    n, v = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    q = lambda x: 2 ** (round(math.log2(x) * L.STEPS) / L.STEPS) if x else 0
    base = lambda x: (c[x,] + 0.5) / (n + 0.5 * (v + 1))

    def p(s, b, w):
        one = starts if b == "start" else c[b,]
        two = starts if b == "start" else q(c[s, b])
        m1, m2 = L.SCALE[0] * max(one, 1) ** L.POWER, L.SCALE[1] * max(two, 1) ** L.POWER
        short = (min(q(c[b, w]), one) + m1 * base(w)) / (one + m1)
        return (min(q(c[s, b, w]), two) + m2 * short) / (two + m2)

    for (i, *_), w, h in zip(rows, tokens, held):
        model = sum(math.log10(p(*g)) for g in zip(["start", "start", *w], ["start", *w], w))
        yield i, h, len(w), sum(c[x,] > 0 for x in w), n, sum(math.log10(base(x)) for x in w), model


def same_scores(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], abs_tol=1e-6) and math.isclose(g[6], w[6], abs_tol=1e-6)


def texts(n=150):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("the of A a b c Dog cat \u00c9".split()) if rng.random() < 0.6 else f"w{rng.randrange(200)}" for _ in range(rng.randrange(60))), "x", 0) for i in range(n)]
    return rows + [(500, None, "x", 0), (501, " \n", "x", 0), (None, "the of a", "x", 0), (7, rows[7][1], "x", 0), (502, "the of a " * 20000, "x", 0)]


DOCS = "doc_id bigint, text string, train string, tokens int"


@pytest.mark.parametrize("shard, head, chunk", [(10**6, 1 << 16, 3_000_000), (300, 20, 3_000_000), (300, 0, 100)])
def test_language_model(spark, monkeypatch, shard, head, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    rows = texts()
    same_scores(L.score_texts(spark.createDataFrame(rows, DOCS), head_size=head, shard_size=shard).collect(), score(rows))


def test_hot_pair_is_spread(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 500)
    rows = [(i, " ".join(f"w{i}x{k} of the" for k in range(40)) if i % 3 else f"the w{i % 7} of", "x", 0) for i in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    same_scores(L.score_texts(docs, head_size=3, shard_size=2000).collect(), score(rows))
    plain = L._rows(docs, "doc_id", "text", None)
    totals, frequent = L._surveyed(plain, 3, 2000)
    assert len(frequent.hot)
    dealt = L._dealt(plain, spark.sparkContext.broadcast(frequent), 8).groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert max(r["n"] for r in dealt) < 0.4 * sum(r["n"] for r in dealt)


def test_kept_model_scores_other_texts(spark):
    rows = texts()
    model = L.fit_model(spark.createDataFrame(rows, DOCS), held_out=F.lit(False), shard_size=300)
    other = [(9000, "the of a cat unheard", "x", 0), (9001, None, "x", 0), (9002, rows[3][1], "x", 0)]
    want = [w for w in score(rows + other, [False] * len(rows) + [True] * len(other)) if w[1]]
    same_scores(model.score(spark.createDataFrame(other, DOCS)).collect(), want)


def test_language_model_without_training_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert L.score_texts(docs).count() == 0
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = L.score_texts(spark.createDataFrame([(only, "a b")], docs.schema)).first()
    assert r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbZé   \t\n\x0b\x0c\r\x1c\x00"), max_size=12)), min_size=1, max_size=8))
def test_tokens_are_those_of_the_texts(rows):
    """Codes by the whole batch give each text's words, A-Z lower-cased and divided by ASCII white space alone, then the end mark."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.string()), pa.array([True] * len(rows))], names=["doc_id", "text", "train"])
    (held,) = L._chunks(iter([batch]))
    want = [[xxhash.xxh64_intdigest(w) for w in (t or "").encode().lower().split()] + [int(L.END_MARK)] for t in rows]
    assert held.size.tolist() == list(map(len, want)) and held.words[held.code].tolist() == sum(want, [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 3) | st.integers(0, (1 << 40) - 1)] * 3), min_size=1, max_size=50))
def test_order_is_that_of_indirect_sorts(rows):
    columns = np.array(rows).T
    assert (L._order(*((c, 40) for c in columns)) == np.lexsort(columns)).all()


def test_scores_hold_no_column_of_a_whole_chunk():
    """A chunk's texts are scored some at a time: what is held beyond its answers does not grow with it."""
    n, size = 1 << 21, 1 << 9
    places = np.arange(n) % 1000
    one = pa.table({"docs": [list(range(n // size))], "train": [[True] * (n // size)], "sizes": [[size] * (n // size)], "places": [places.astype(np.uint16).tobytes() + bytes(n)]})
    answer = zlib.compress(np.full(1000, 7, np.uint64).tobytes() + np.full(2000, 65, np.uint16).tobytes())
    tracemalloc.start()
    out = L._merge(one, pa.table({"shard": [0], "answer": [answer]}), 1e6, 1e4, 1e3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == n // size and len(set(out["model"].to_pylist())) == 1
    assert peak < 40_000_000  # a column of the whole chunk takes 16,777,216
