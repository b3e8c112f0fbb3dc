"""SimHash: fingerprints, links and components against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import types as T

from veloquent.llm import components
from veloquent.llm.components import connected_components
from veloquent.llm.simhash import fingerprint, hamming_links, hex_bits, simhash_components, simhash_dedup

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.LongType()), T.StructField("bits", T.StringType())])


def plain(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "Two words", "a b c", "a b c a b c a b c", "Ünï cödé İ ÀB " * 9, "x" * 5000, "\x0b\x0cform\x1cfeed nb\xa0sp x"])
def test_fingerprint(text):
    assert fingerprint(text) == plain(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("limit", [256, 2])
def test_links_connect_as_brute_force(spark, radius, limit):
    rng = random.Random(radius)
    bits = {rng.getrandbits(64) for _ in range(40)}
    for x in list(bits):
        for _ in range(4):
            bits.add(x ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 4))) & (1 << 64) - 1)
    bits |= {0, 1, 3, 7, 1 << 63, (1 << 63) | 1, (1 << 64) - 1}
    rows = list(enumerate(sorted(bits)))
    table = spark.createDataFrame([(i, b - (1 << 64) if b >> 63 else b) for i, b in rows], "id bigint, bits bigint")
    edges = [tuple(r) for r in hamming_links(table, radius, limit).select("a", "b").collect()]
    near = [(i, j) for i, a in rows for j, b in rows if i < j and (a ^ b).bit_count() <= radius]
    by = dict(rows)
    assert all((by[i] ^ by[j]).bit_count() <= radius for i, j in edges)
    assert closure(edges, by) == closure(near, by)
    if limit == 256:
        assert {tuple(sorted(e)) for e in edges} == set(near)


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components_of_chains_stars_and_loops(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(7, 7), (900, 901), (901, 900)]
    pairs += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*pairs, (None, 5), (6, None)], "a bigint, b bigint")).collect()}
    want = closure(pairs, {x for p in pairs for x in p})
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_hubs_connect_as_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    FLOOR = components.FLOOR
    pairs = [(1000, i) for i in range(1001, 1003 + 2 * FLOOR)] + [(i, 5000) for i in range(3000, 3003 + FLOOR)]
    pairs += [(1500 + i, 6000) for i in range(3 * FLOOR)] + [(6000, 3001), (7, 1000), (9000, 9001)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == closure(pairs, {x for p in pairs for x in p})


def test_rows_nulls_copies_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(400))
    near = text.replace("w399", "other")
    rows = [(5, text, 1, "x"), (3, near, 1, "x"), (9, text.upper(), 1, "x"), (9, text, 2, "y"), (None, text, 0, "z"), (7, None, 0, "z"), (8, "", 0, None), (11, "quite another text of its own kind", 0, None)]
    got = simhash_components(spark.createDataFrame(rows, DOCS)).withColumn("hex", hex_bits()).collect()
    assert len(got) == len(rows)
    found = {}
    for r in got:
        found.setdefault(r["id"], set()).add((r["hex"], r["component"]))
    assert all(x == f"{plain(text):016x}" for x, _ in found[5] | found[9])
    linked = (plain(text) ^ plain(near)).bit_count() <= 2
    assert {c for _, c in found[5]} == {3 if linked else 5}
    assert found[7] == {("0" * 16, 7)} and found[8] == {("0" * 16, 7)}
    kept = simhash_dedup(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "id", "bits"]
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == ([3, 7, 11, None] if linked else [3, 5, 7, 11, None])


def test_empty_table_and_repeated_rows(spark):
    assert simhash_components(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash_dedup(spark.createDataFrame([], DOCS)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d", 0, "")] * 3, DOCS)
    assert simhash_dedup(twice).count() == 1
