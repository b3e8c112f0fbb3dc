"""SimHash near-dedup with multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .membership import without_ids
from .scratch import materialize

#: Seed of the shingles' XXH64.
SEED = 42
#: Buckets with more distinct fingerprints than this take the covering-ball path instead of pairwise checks.
BUCKET_LIMIT = 256
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text; zero without words.

    Words are runs of anything but ASCII white space after lower-casing A-Z; shingles of ``shingle``
    words count with repeats. A bit is one if set in more than half of the shingles' hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.array(hashes[at : at + BLOCK], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, bits)`` for every row; ``bits`` is the fingerprint as a signed bigint. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view("<i8"))], names=["id", "bits"])

    kept = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "id bigint, bits bigint")


def _masks(width: int, radius: int) -> list[int]:
    """Every ``width``-bit number with at most ``radius`` bits set."""
    return [reduce(lambda m, b: m | 1 << b, c, 0) for r in range(radius + 1) for c in combinations(range(width), r)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def hamming_links(table: DataFrame, radius: int = 2, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` of ids that connect what fingerprints within ``radius`` bits connect.

    ``table`` holds one ``(id, bits)`` per distinct fingerprint. Two 32-bit segments index it. By
    pigeonhole, a pair within ``radius`` agrees up to ``radius // 2`` bits in the first segment, or up
    to ``(radius - 1) // 2`` in the second. Each fingerprint enumerates those balls, meets the
    table's rows of equal segment value and keeps the pairs whose whole distance is in reach.

    A segment value shared by more than ``bucket_limit`` fingerprints is not paired up. Whoever is
    in or near such a bucket takes the covering ball of the whole fingerprint instead: two are
    within ``radius`` exactly if a point lies within ``radius // 2`` of one and the rest of the
    other, so all who meet in a point link to one of them. That is linear in the rows and loses no
    connection.
    """
    if not 1 <= radius <= 3:
        raise ValueError("radius must be 1, 2 or 3")
    halves = [F.shiftrightunsigned("bits", 32), F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF))]
    reach = [radius // 2, (radius - 1) // 2]
    index = table.select(
        "id", "bits", F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), h.alias("key")) for s, h in enumerate(halves)))).alias("k")
    ).select("id", "bits", "k.seg", "k.key")
    ball = F.when(F.col("seg") == 0, F.array(*map(F.lit, _masks(32, reach[0])))).otherwise(F.array(*map(F.lit, _masks(32, reach[1]))))
    probe = index.select(
        F.col("id").alias("a"), F.col("bits").alias("bits_a"), "seg", F.explode(F.transform(ball, lambda m: F.col("key").bitwiseXOR(m.cast("bigint")))).alias("key")
    )
    hot = materialize(index.groupBy("seg", "key").count().where(F.col("count") > bucket_limit).select("seg", "key"))
    has_hot = not hot.isEmpty()
    cold = index.join(hot, ["seg", "key"], "left_anti") if has_hot else index
    met = probe.join(cold.select(F.col("id").alias("b"), F.col("bits").alias("bits_b"), "seg", "key"), ["seg", "key"])
    near = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= radius
    links = met.where((F.col("bits_a") < F.col("bits_b")) & near).select("a", "b")
    if not has_hot:
        return links
    crowd = probe.join(hot, ["seg", "key"], "left_semi").select(F.col("a").alias("id"), F.col("bits_a").alias("bits")).distinct()
    outer, inner = radius - radius // 2, radius // 2
    points = F.array(*(F.struct(F.lit(_signed(m)).cast("bigint").alias("mask"), F.lit(m.bit_count() <= inner).alias("inner")) for m in _masks(64, outer)))
    cover = crowd.select("id", "bits", F.explode(points).alias("p")).select("id", F.col("bits").bitwiseXOR(F.col("p.mask")).alias("point"), "p.inner")
    centre = cover.where("inner").groupBy("point").agg(F.min("id").alias("b"))
    return links.unionByName(cover.join(centre, "point").where("id <> b").select(F.col("id").alias("a"), "b"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``(id, bits, component)`` for every row of ``docs``.

    ``component`` is the smallest id reachable over links of at most ``radius`` differing bits, the
    row's own included. Equal fingerprints collapse to one representative before any search, so
    groups of copies cost one row. Null and empty texts share the fingerprint zero; rows with a null
    id are fingerprinted and carry their group's component, but give no id to it. An empty table
    gives an empty result; other columns of ``docs`` are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle))
    groups = materialize(prints.groupBy("bits").agg(F.min("id").alias("id")))
    found = connected_components(hamming_links(groups.where("id is not null"), radius))
    named = groups.join(found, F.col("id") == F.col("node"), "left").select("bits", F.coalesce("component", "id").alias("component"))
    return prints.join(named, "bits").select("id", "bits", "component")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest id, all columns kept.

    Rows with a null id stay. Of rows that repeat a kept id, one stays.
    """
    return keep_smallest(docs, materialize(simhash_components(docs, id_col, text_col, shingle, radius)), id_col)


def keep_smallest(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is null or the smallest of its component in ``found`` (``id, component``); of rows that repeat a kept id, one."""
    kept = without_ids(docs, found.where("id <> component").select("id"), id_col)
    repeated = found.where("id = component").groupBy("id").count().where("count > 1").select(F.col("id").alias("__again"))
    if repeated.isEmpty():
        return kept
    again = F.col(id_col) == F.col("__again")
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates([id_col]))


def hex_bits(bits: str = "bits"):
    """A signed bigint's bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(bits)), 16, "0"))
