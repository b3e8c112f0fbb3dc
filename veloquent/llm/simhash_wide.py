"""SimHash near-dedup by similarity: wide fingerprints, many segments, verified distances, exact Jaccard similarities."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import HUBS, connected_components
from .membership import with_ids
from .scratch import discard, materialize
from .simhash import SEED, keep_smallest

#: Bits of a wide fingerprint, in words of 64.
WIDTH = 256
WORDS = [f"w{i}" for i in range(WIDTH // 64)]
#: Chance that a pair at the distance expected of the similarity shares a segment; closer pairs do better.
RECALL = 0.95
#: Candidates may lie this many standard deviations beyond the expected distance.
DEVIATIONS = 2.33
#: Segment values with more fingerprints than this are linked through one of them first.
BUCKET_LIMIT = 64
#: Rows of a large bucket that meet in one task come from parts of about this size.
PART = 512
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 14
#: Bits that tell of each residue of the hashes whether an odd number of a text's shingles has it, in words of 64.
PARITY = 1024
MARKS = [f"x{i}" for i in range(PARITY // 64)]
#: Odd multipliers that turn one hash into the words of a fingerprint (fixed values).
STREAMS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], "<u8")


def distance_limit(similarity: float) -> int:
    """Differing bits expected of two texts of equal size whose shingle sets have this Jaccard similarity."""
    return int(WIDTH * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def reach(similarity: float) -> int:
    """Differing bits up to which a pair is a candidate: of pairs at the similarity one in a hundred lies beyond."""
    expected = distance_limit(similarity)
    return math.ceil(expected + DEVIATIONS * math.sqrt(expected * (1 - expected / WIDTH)))


def plan(n: int, distance: int) -> tuple[int, int]:
    """Bits of a segment and number of segments: bits grow with the logarithm of the fingerprints, segments keep ``RECALL`` at ``distance``.

    Of ``n`` fingerprints one in sixteen shares a segment's value by chance, so few rows meet that have nothing in common.
    """
    bits = min(max(math.ceil(math.log2(max(n, 2))) + 4, 12), 48)
    share = math.prod((WIDTH - distance - i) / (WIDTH - i) for i in range(bits))
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log1p(-share)))


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """XXH64 of a text's distinct shingles; of a shorter text's whole sequence, and none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "<u8")
    some = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in some), "<u8", len(some))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of distinct shingles' hashes as four unsigned words; zeros without shingles."""
    ones = np.zeros(WIDTH, np.int64)
    for at in range(0, len(hashes), BLOCK):
        mixed = hashes[at : at + BLOCK, None] * STREAMS
        mixed = (mixed ^ (mixed >> np.uint64(32))) * STREAMS[::-1]
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8).reshape(-1, WIDTH // 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def parity(hashes: np.ndarray) -> np.ndarray:
    """Parity bits of distinct shingles' hashes as sixteen unsigned words."""
    held = hashes.view("<i8") & (PARITY - 1)
    return np.packbits((np.bincount(held, minlength=PARITY) & 1).astype(np.uint8), bitorder="little").view("<u8")


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``(id, n, w0..w3, x0..x15)`` for every row, ``n`` the number of distinct shingles, ``x`` their parity bits; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes = np.zeros((batch.num_rows, len(WORDS) + len(MARKS)), "<u8"), np.zeros(batch.num_rows, np.int32)
            for at, text in enumerate(batch.column(1)):
                hashes = shingle_hashes(text.as_py(), shingle)
                prints[at], sizes[at] = np.r_[wide_fingerprint(hashes), parity(hashes)], len(hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *map(pa.array, prints.view("<i8").T.copy())], names=["id", "n", *WORDS, *MARKS])

    kept = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"id bigint, n int, {', '.join(f'{w} bigint' for w in [*WORDS, *MARKS])}")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``(id, s)``: the shingles' hashes of the rows of ``docs`` whose id is in ``ids`` (``id``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(shingle_hashes(text.as_py(), shingle)).view("<i8") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    kept = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return with_ids(kept, ids, "id").mapInArrow(run, "id bigint, s array<bigint>")


def _share(similarity: float) -> Fraction:
    return Fraction(similarity).limit_denominator(10_000)


def parities(sets: DataFrame) -> DataFrame:
    """``(id, k, x0..x15)`` for sets ``(id, s)``: their sizes and parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, words = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(MARKS)), "<u8")
            for at, held in enumerate(batch.column(1)):
                hashes = held.values.to_numpy()
                sizes[at], words[at] = len(hashes), parity(hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *map(pa.array, words.view("<i8").T.copy())], names=["id", "k", *MARKS])

    return sets.select("id", "s").mapInArrow(run, f"id bigint, k bigint, {', '.join(f'{x} bigint' for x in MARKS)}")


def _possible(similarity: float, k: str = "k", l: str = "l") -> Column:  # noqa: E741
    """Whether sets of ``k`` and ``l`` shingles with parities ``x*`` and ``y*`` can reach the similarity: what differs in parity is held by one set alone, so no pair that reaches it is refused."""
    share, apart = _share(similarity), sum((F.bit_count(F.col(x).bitwiseXOR(F.col(x.replace("x", "y")))) for x in MARKS), F.lit(0))
    every = F.col(k).cast("bigint") + F.col(l)
    return (every - apart) * (share.numerator + share.denominator) >= 2 * every * share.numerator


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach the Jaccard similarity, counted in whole numbers."""
    share = _share(similarity)
    left, right = (sets.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    both, all_ = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    met = pairs.join(left, "a").join(right, "b")
    return met.where(both * (share.numerator + share.denominator) >= all_ * share.numerator).select("a", "b").distinct()


def _segments(table: DataFrame, bits: int, count: int) -> DataFrame:
    """``(id, key)``: every fingerprint's ``count`` segments of ``bits`` bits, numbered so that no two segments share keys."""
    at = np.random.default_rng([SEED, bits, count]).permuted(np.tile(np.arange(WIDTH), (count, 1)), axis=1)[:, :bits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            words = np.stack([batch.column(i + 1).to_numpy() for i in range(len(WORDS))], 1)
            ones = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
            keys = np.stack([ones[:, p] @ weights for p in at], 1) * count + np.arange(count)
            held = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, count, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), held], names=["id", "keys"])

    return table.select("id", *WORDS).mapInArrow(run, "id bigint, keys array<bigint>").select("id", F.explode("keys").alias("key"))


def _within(limit: int) -> Column:
    """Whether ``w0..w3`` and ``v0..v3`` differ in at most ``limit`` bits."""
    return sum((F.bit_count(F.col(w).bitwiseXOR(F.col(w.replace("w", "v")))) for w in WORDS), F.lit(0)) <= limit


def _other(table: DataFrame, name: str) -> DataFrame:
    """``table`` with its id called ``name``, its size ``m``, its words ``v0..v3`` and its parities ``y0..y15``."""
    return table.withColumnsRenamed({"id": name, "n": "m", **{w: w.replace("w", "v") for w in WORDS}, **{x: x.replace("x", "y") for x in MARKS}})


def _alike(similarity: float) -> Column:
    """Whether sets of ``n`` and ``m`` shingles can reach the similarity."""
    return F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-6


def wide_links(table: DataFrame, docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bucket_limit: int = BUCKET_LIMIT, part: int = PART) -> DataFrame:
    """Edges ``(a, b)`` that connect the rows of ``table`` (distinct fingerprints: ``id, n, w0..w3, x0..x15``) whose texts reach the similarity.

    Whoever shares a segment is compared by whole distance and by the sets' parities where they meet, and what both leave open by the shingles of the texts: every edge
    is a pair of that Jaccard similarity. A pair at the expected distance shares one of the segments with a chance of ``RECALL``.
    Of the candidates, each row's one of smallest id is verified first; candidates that this connects already need no
    verification. In a segment value shared by more than ``bucket_limit`` fingerprints all are compared with the one of
    smallest id; those similar to it are connected by that, so only the others still meet the whole bucket, in
    blocks of parts, where only pairs that are still apart come out. No similar pair in reach that shares a segment loses its connection.
    """
    limit, count = reach(similarity), table.count()
    bits, segments = plan(count, distance_limit(similarity))
    columns = ["n", *WORDS, *MARKS]
    index = _segments(table, bits, segments)
    sizes = materialize(index.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    # Keys above this size are fewer than HUBS, so they are broadcast and their rows stay where they are.
    hub = max(bucket_limit, count * segments // HUBS)
    hubs = sizes.where(F.col("size") > hub).select(F.col("key").alias("hub_key"), F.col("size").alias("hub_size"))
    marked = index.join(F.broadcast(hubs), F.col("key") == F.col("hub_key"), "left")
    rest = marked.where("hub_key is null").join(sizes.where(F.col("size") <= hub), "key").select("id", "key", "size")
    met = materialize(rest.unionByName(marked.where("hub_key is not null").select("id", "key", F.col("hub_size").alias("size"))))
    near = _within(limit) & _alike(similarity) & _possible(similarity, "n", "m")
    cold = met.where(F.col("size") <= bucket_limit).select("id", "key").join(table, "id")
    pairs = materialize(cold.join(_other(cold, "b"), "key").where((F.col("id") > F.col("b")) & near).select(F.col("id").alias("a"), "b").distinct())
    large = met.where(F.col("size") > bucket_limit)
    crowded = not large.isEmpty()
    touched = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    ids = (touched.unionByName(large.select("id")) if crowded else touched).distinct()
    sets = materialize(shingle_sets(docs, ids, id_col, text_col, shingle))
    first = materialize(similar(pairs.groupBy("a").agg(F.min("b").alias("b")), sets, similarity))
    if crowded:
        dealt = large.withColumn("parts", F.ceil(F.col("size") / part).cast("int")).withColumn("q", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        dealt = materialize(dealt.select("id", "key", "parts", "q").join(table, "id"))
        least = dealt.groupBy("key").agg(F.min_by(F.struct("id", *columns), "id").alias("r"), F.max("parts").alias("parts"))
        least = least.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"), "r.*")
        told = materialize(dealt.join(_other(least, "b"), ["key", "q"]).where("id <> b").select("id", "key", "parts", *columns, "b", near.alias("near")))
        stars = materialize(similar(told.where("near").select(F.col("id").alias("a"), "b").distinct(), sets, similarity))
        first = first.unionByName(stars)
        apart = materialize(told.join(stars.select(F.col("a").alias("id"), "b"), ["id", "b"], "left_anti").select("id", "key", "parts", *columns))
    known = materialize(connected_components(first))
    one, other = (known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    joined = pairs.join(one, "a", "left").join(other, "b", "left")
    open_ = joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    if crowded and not apart.isEmpty():
        named = lambda rows: rows.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        shares = apart.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("shares"), F.max("parts").alias("parts"))
        shares = materialize(shares.select("key", "shares", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")))
        whole = named(dealt).join(shares, ["key", "q"]).select("id", "key", "q", *columns, "c", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("p"))
        mine = named(apart).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(shares, ["key", "q"])
        mine = mine.select("id", "key", "q", *columns, "c", F.pmod(F.xxhash64("id", F.lit(1)), F.col("shares")).cast("int").alias("p"))
        whole = _other(whole, "b").withColumnRenamed("c", "d")
        across = mine.join(whole, ["key", "p", "q"]).where((F.col("c") != F.col("d")) & near)
        open_ = open_.unionByName(across.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")))
    return first.unionByName(similar(open_.distinct(), sets, similarity))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(id, component)`` for every row of ``docs``: the smallest id reachable over links of the given similarity.

    Two rows link if the sets of their shingles reach that Jaccard similarity; the search by 256-bit SimHash
    fingerprints finds at least ``RECALL`` of such pairs by plan, most of them far above. Equal fingerprints collapse before the search (sets of less similarity have
    them with a chance below 1e-18). Words are what ASCII white space divides, A-Z lower-cased. Null and empty texts have the fingerprint zero and are copies of
    each other; rows with a null id carry their group's component but name none. Of rows that repeat an id with other texts any may link it. An empty table gives
    an empty result; other columns are ignored.
    """
    prints = materialize(wide_fingerprints(docs, id_col, text_col, shingle))
    least = F.min_by(F.struct("n", *MARKS), "id").alias("r")
    groups = materialize(prints.groupBy(*WORDS).agg(F.min("id").alias("id"), least).select(*WORDS, "id", "r.*"))
    found = connected_components(wide_links(groups.where("id is not null"), docs, similarity, id_col, text_col, shingle))
    named = groups.join(found, F.col("id") == F.col("node"), "left").select(*WORDS, F.coalesce("component", "id").alias("component"))
    out = materialize(prints.select("id", *WORDS).join(named, WORDS).select("id", "component"))
    discard(prints)
    return out


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest id, all columns kept.

    Rows with a null id stay. Of rows that repeat a kept id, one stays.
    """
    return keep_smallest(docs, similar_components(docs, id_col, text_col, shingle, similarity), id_col)
