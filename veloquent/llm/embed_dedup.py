"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .components import connected_components
from .scratch import materialize

#: Chance that a pair exactly at the threshold shares a bucket in some table; closer pairs do better.
RECALL = 0.98
#: Vectors of a bucket compared in one task; larger buckets are cut into pairs of parts of this size.
BLOCK = 1024
SEED = 20240229
#: Vectors whose rows all have a null id stand under numbers from here on; ids lie below.
NAMELESS = 1 << 62


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a signature and tables: bits grow with the logarithm of the rows, tables keep ``RECALL`` at the threshold.

    Three bits beyond the logarithm leave unrelated vectors in buckets of their own, which are dropped
    before any vector is shuffled.
    """
    bits = min(max(math.ceil(math.log2(max(n, 2))) + 3, 16), 56)
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - share))


def _signatures(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """``[row, table]`` sign signatures; the hyperplanes follow from the seed and the dimension."""
    planes = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _labels(adjacent: np.ndarray) -> np.ndarray:
    """Smallest reachable row index of each row of a small symmetric adjacency."""
    now = np.arange(len(adjacent))
    while True:
        low = np.minimum(now, np.where(adjacent, now[None, :], len(now)).min(1))
        low = low[low]
        if (low == now).all():
            return now
        now = low


def _compare(block: dict[str, np.ndarray], threshold: float, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links inside one block: ``(rows, weighted link counts)`` and the edges that join their components.

    A pair counts in the first table in which its signatures meet, and in no later one. In a block of
    two parts only pairs across count.
    """
    unit, part, table = block["unit"], block["part"], int(block["tab"][0])
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    if part.any():
        near &= part[:, None] != part[None, :]
    if not near.any():
        none = np.empty(0, np.int64)
        return none, none, none, none
    i, j = np.nonzero(near)
    first = np.ones(len(i), bool)
    # Signatures are short work beside the shuffle that they would cost, so they are taken anew from the vectors.
    sig = np.zeros((len(unit), table), np.int64)
    met = np.unique(i)
    if table:
        sig[met] = _signatures(unit[met], bits, tables)[:, :table]
    for at in range(0, len(i), 1 << 18):
        x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        first[at : at + (1 << 18)] = ~(sig[x, :table] == sig[y, :table]).any(1)
    counts = np.bincount(i[first], weights=block["n"][j[first]], minlength=len(unit)).astype(np.int64)
    low = _labels(near)
    moved = np.flatnonzero(low != np.arange(len(low)))
    touched = np.flatnonzero(counts)
    return block["rep"][touched], counts[touched], block["rep"][moved], block["rep"][low[moved]]


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, by their largest component first."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id)`` for every row of ``table``.

    Vectors link if their cosine, in double precision, reaches the threshold. Equal vectors collapse
    to one weighted representative first, so copies are never paired. Representatives hash to
    sign signatures in several tables; each bucket's vectors are compared by one matrix product. A
    bucket over ``BLOCK`` vectors is cut into parts and each pair of parts compared apart, so no task
    sees more than two parts and no pair is lost. Only sums of links and edges between components
    leave a task. Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing; vectors of different lengths never meet. A row with a null id counts as a link of
    others but names no component: one of such rows alone has null. Repeated rows count as links of each other; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), _numbers(table, vector_col).alias("v"))
    kind = rows.schema["v"].dataType.simpleString()
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(sound, F.col("v")))
    reps = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = materialize(reps.withColumn("rep", F.coalesce("rep", F.pmod(F.xxhash64("v"), F.lit(1 << 61)) + NAMELESS)).withColumn("dim", F.size("v")))
    count = reps.count()
    bits, tables = plan(count, threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                mine = batch.filter(pa.array(dims == dim))
                sig = _signatures(_unit(_stack(mine.column(0), int(dim))), bits, tables)
                held = pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel(), pa.int64()), tables).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*mine.columns, held], names=["v", "rep", "n", "dim", "sig"])

    signed = reps.mapInArrow(sign, f"v {kind}, rep bigint, n bigint, dim int, sig array<bigint>")
    spread = signed.select("v", "rep", "n", "dim", F.posexplode("sig").alias("tab", "key"))
    sizes = materialize(spread.groupBy("dim", "tab", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    small = sizes.where(F.col("size") <= BLOCK).select("dim", "tab", "key", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("part"))
    blocks = spread.join(small, ["dim", "tab", "key"])
    large = sizes.where(F.col("size") > BLOCK)
    if not large.isEmpty():
        cut = spread.join(large, ["dim", "tab", "key"]).withColumn("parts", F.ceil(F.col("size") / (BLOCK // 2)).cast("int"))
        mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
        every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, mine).alias("p"), F.greatest(o, mine).alias("q"), (o < mine).cast("int").alias("part")))
        blocks = blocks.unionByName(cut.withColumn("b", F.explode(every)).select(*spread.columns, "b.p", "b.q", "b.part"))
    blocks = blocks.select("v", "rep", "n", "dim", "tab", "key", "p", "q", "part")
    keyed = ["dim", "tab", "key", "p", "q"]
    dealt = blocks.repartition(*keyed).sortWithinPartitions(*keyed, "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                held = batch if held is None else pa.concat_batches([held, batch])
            if held is None or not held.num_rows:
                continue
            ids = np.stack([held.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4, 5, 6, 7)])
            edges = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
            starts = np.concatenate(([0], edges, [held.num_rows] if batch is None else []))
            out: list[tuple] = []
            for a, b in zip(starts[:-1].astype(int), starts[1:].astype(int)):
                if b - a < 2:
                    continue
                group = held.slice(a, b - a)
                got = {
                    "unit": _unit(_stack(group.column(0), int(ids[0, a]))),
                    "rep": group.column(1).to_numpy(),
                    "n": group.column(2).to_numpy(),
                    "tab": ids[1, a : a + 1],
                    "part": group.column(8).to_numpy() + 1 if ids[3, a] != ids[4, a] else np.zeros(b - a, np.int64),
                }
                out.append(_compare(got, threshold, bits, tables))
            held = held.slice(int(starts[-1])) if batch is not None else None
            if out:
                x, c, s, t = (np.concatenate(z) for z in zip(*out))
                zero = np.zeros(len(s), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((x, s))), pa.array(np.concatenate((c, zero))), pa.array(np.concatenate((x, t)))], names=["rep", "links", "to"])

    found = materialize(dealt.mapInArrow(compare, "rep bigint, links bigint, to bigint"))
    links = found.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("rep <> to").select("rep", "to"), "rep", "to")
    named = reps.join(links, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    named = named.select(F.xxhash64("v").alias("h"), "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")).withColumn("component", F.when(F.col("component") < NAMELESS, F.col("component")))
    out = rows.withColumn("h", F.xxhash64("v")).join(named, ["h", "v"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))


def _numbers(table: DataFrame, column: str) -> Column:
    """The vectors as they are stored if of floats, else as doubles: the shuffle carries no wider numbers than the table."""
    element = table.schema[column].dataType.elementType
    return F.col(column) if isinstance(element, (FloatType, DoubleType)) else F.col(column).cast("array<double>")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches and then None, for the last group."""
    yield from batches
    yield None
