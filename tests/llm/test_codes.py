"""Byte-level BPE against its own library, vector codes and fill-in-the-middle against plain versions."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veloquent.llm import byte_bpe as B
from veloquent.llm import fill_middle as M
from veloquent.llm import queries as Q
from veloquent.llm import vector_codes as V

PATH = public_tokenizers.path(B.RANKS)
LIBRARY = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.load_ranks(PATH), special_tokens={})
ODD = st.text(st.sampled_from("aabcdest '\n\t 　\u001c0١Ⅷ漢字éñß😀👩‍́.,!?<|>\x00"), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=200), ODD), max_size=6))
def test_ids_are_those_of_the_library(texts):
    vocab = B.vocabulary(PATH)
    got = B.encode_texts(texts, vocab)
    assert [g.tolist() for g in got] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [B.decode_ids(g, vocab) for g in got] == [t.encode() for t in texts]


@pytest.mark.parametrize("text", ["x" * 5000, "ab" * 3000, "the" * 700, "=" * 1023 + " " + "=" * 1025, "a" * 1024, "漢字" * 600, " \n" * 3000])
def test_long_matches(text):
    assert B.encode_texts([text], B.vocabulary(PATH))[0].tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text("abcdefghinorst", min_size=2, max_size=400))
def test_heap_and_matrix_agree(text):
    vocab, piece = B.vocabulary(PATH), text.encode()
    ids = np.full((1, B.width(len(piece))), B.PAD)
    ids[0, : len(piece)] = vocab.byte[np.frombuffer(piece, np.uint8)]
    assert B.merge_rows(ids, vocab.pairs)[0].tolist() == B.merge_long(piece, vocab).tolist()


def test_pair_table_holds_every_split():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5}
    table = B.PairTable(ranks)
    left, right = np.meshgrid(np.arange(6), np.arange(6), indexing="ij")
    found = table.find(left, right)
    assert {(int(a), int(b)): int(found[a, b]) for a, b in np.argwhere(found != B.NONE)} == {(0, 1): 3, (1, 2): 4, (0, 4): 5, (3, 2): 5}


def test_shares_hold_all_in_order():
    sizes = [5, 0, 9, 1, 1, 30, 2, 0]
    got = [list(range(len(sizes)))[s] for s in B._shares(sizes, 10)]
    assert sum(got, []) == list(range(len(sizes))) and all(len(g) == 1 or sum(sizes[k] for k in g) <= 10 for g in got)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n string, output string, form string, decoded string")


def test_coded_documents(spark):
    long = " ".join(f"w{i}é" for i in range(60_000))
    texts = {1: "Hello  world\n", 2: None, 3: "", 4: long, 5: "<|endoftext|> x", 6: "\x00�"}
    rows = [(k, t, "", "", "", "", "") for k, t in texts.items()] + [(1, texts[1], "", "", "", "", ""), (None, "a", "", "", "", "", "")]
    got = B.decode(B.encode(documents(spark, rows))).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 1 for r in got) == 2
    for r in got:
        text = texts.get(r.doc_id, "a") or ""
        assert r.ids == LIBRARY.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert B.decode(B.encode(documents(spark, []))).collect() == []
    nulls = B.decode(spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>")).collect()
    assert [None if r.decoded is None else bytes(r.decoded) for r in nulls] == [None, b"", b'!"']
    with pytest.raises(Exception, match="no line of the rank file"):
        B.decode(spark.createDataFrame([([99_999],)], "ids array<int>")).collect()


def test_query_digests(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in Q.op11_byte_bpe(spark, data).collect():
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 300, 5000, 2**20, 2**24 - 1]), st.integers(1, 8))
def test_nearest_is_exact(seed, reach, width):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-reach, reach + 1, (30, width)), rng.integers(-reach, reach + 1, (9, width))
    c[4], c[7] = c[2], x[3]
    x[5] = (c[0] + c[1]) // 2
    index, error, looked = V.nearest(x, c)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (error == d.min(1)).all() and len(x) <= looked <= d.size


def test_screening_spares_most_entries():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-300, 300, (2000, 4)), rng.integers(-300, 300, (64, 4))
    assert V.nearest(x, c)[2] < 2100


def plain_codes(rows):
    kept = sorted((i, [int(np.floor(256.0 * x)) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v))
    d = len(kept[0][1]) // 16
    part = lambda v, p: v[p * d : p * d + d]
    books = [[part(v, p) for _, v, _ in kept[:64]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e))
    for _ in range(2):
        held = defaultdict(list)
        for _, v, _ in kept:
            for p in range(16):
                held[p, near(v, p)].append(part(v, p))
        for (p, e), some in held.items():
            books[p][e] = [sum(c) // len(some) for c in zip(*some)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], defaultdict(int)
    for i, v, label in kept:
        codes = [near(v, p) for p in range(16)]
        error = sum(far(part(v, p), books[p][codes[p]]) for p in range(16))
        out.append((i, "".join(f"{c:02x}" for c in codes), error, label))
        total[label] += error
    return sorted((i, c, e, total[label], digest) for i, c, e, label in out)


def vector_rows(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(32).astype(np.float32) * (i % 3)], [None, 1, 2][i % 3]) for i in range(10, 10 + n)]
    rows += [(500 + i, rows[min(2, n - 1)][1], 1) for i in range(min(n, 4))]
    return rows + [(1, None, 1), (2, [], 1), (3, [None] * 32, 2), (4, [float("nan")] * 32, 1), (5, [float("inf")] + [0.0] * 31, None), (6, [0.0] * 31 + [None], 1)]


VECTORS = "vec_id bigint, embedding array<{}>, label int"


@pytest.mark.parametrize("n, few, kind", [(150, 20_000, "float"), (150, 1, "double"), (20, 20_000, "float"), (1, 20_000, "float")])
def test_codes_against_a_plain_version(spark, monkeypatch, n, few, kind):
    monkeypatch.setattr(V, "FEW_LABELS", few)
    rows = vector_rows(n)
    table = spark.createDataFrame(rows, VECTORS.format(kind)).withColumns({c: F.lit("x") for c in ("v", "code", "error", "cell")}).repartition(3)
    assert sorted(map(tuple, V.compress(table).collect())) == plain_codes(rows)


def test_odd_vector_tables(spark):
    make = lambda rows: V.compress(spark.createDataFrame(rows, VECTORS.format("float")))
    empty = make([])
    assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert make([(1, None, 2), (None, [1.0] * 16, 2)]).collect() == []
    mixed = make([(1, [1.0] * 16, 2), (2, [1.0] * 32, 2), (3, [70_000.0] * 16, 2), (None, [2.0] * 16, 2)]).collect()
    assert sorted((r.vec_id or 0, r.error) for r in mixed) == [(0, 16 * 128**2), (1, 16 * 128**2)]
    twice = make([(1, [1.0] * 16, None)] * 3).collect()
    assert [(r.code, r.error, r.label_error) for r in twice] == [("00" * 16, 0, 0)] * 3
    with pytest.raises(ValueError, match="equal parts"):
        make([(1, [1.0] * 17, 2)])


def plain_middle(text, doc_id):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


MIDDLES = st.one_of(st.text(max_size=300), st.text("abZ <PSM>\né😀KK", max_size=300))


@settings(max_examples=300, deadline=None)
@given(MIDDLES, st.integers(0, 10**12))
def test_rearranged_text(text, doc_id):
    got = M.rearrange(text, doc_id)
    assert got == plain_middle(text, doc_id) and M.rebuild(got[4], got[1]) == text


@settings(max_examples=200, deadline=None)
@given(MIDDLES, st.integers(1, 20), st.data())
def test_rope(text, leaf, data):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    whole = M.rope(text, leaf)
    assert str(whole) == text and (whole.units, whole.chars) == (len(units), len(text))
    at = data.draw(st.integers(0, len(units)))
    low, high = whole.split(at)
    assert (str(low), str(high)) == ("".join(units[:at]), "".join(units[at:])) and (low.units, high.units) == (at, len(units) - at)
    again = data.draw(st.integers(0, low.chars))
    assert tuple(map(str, low.split(again, "chars"))) == (str(low)[:again], str(low)[again:])


def test_rope_is_balanced_and_shares_what_a_split_leaves():
    whole = M.rope("ab " * 40_000)
    depth = lambda r: 0 if r.text is not None else 1 + max(depth(r.left), depth(r.right))
    assert depth(whole) <= 7 and max(map(len, whole.leaves())) <= M.LEAF + 2
    assert M.rope("x" * 10_000).units == 1
    low, _ = whole.split(whole.units - 1)
    assert low.left is whole.left


def test_filled_documents(spark):
    texts = {k: t for k, t in enumerate(["", None, "x", "a<P>b", "über 12 km", "q" * 9000, "word, " * 50_000, "a\r\n\x00b"] + [f"some text {i}" for i in range(60)])}
    rows = [(k, t, "", "", "", "", "") for k, t in texts.items()] + [(4, texts[4], "", "", "", "", ""), (None, "null id", "", "", "", "", "")]
    got = M.restore(M.fill_in_middle(documents(spark, rows))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        text = texts[r.doc_id] or "" if r.doc_id is not None else "null id"
        assert tuple(r)[1:6] == plain_middle(text, "" if r.doc_id is None else r.doc_id) and r.restored == text
    assert M.restore(M.fill_in_middle(documents(spark, []))).collect() == []
    assert M.restore(spark.createDataFrame([(None, "psm")], "output string, form string")).first().restored is None


