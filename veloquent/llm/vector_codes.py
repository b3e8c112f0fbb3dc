"""Product-quantiser codes of integer vectors: float32 screening, int64 decisions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose distances are screened at once.
BLOCK = 4096
#: Components reach up to here: with it no distance of a vector of 8192 components leaves 64 bits.
REACH = 1 << 24
#: Label sums are broadcast up to this many labels and joined beyond.
FEW_LABELS = 20_000
#: Half the distance between 1 and the next float32.
UNIT = 2.0**-24


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``(index, squared distance, entries re-evaluated)`` of the entry nearest to each row, ties to the lower index; all int64.

    ``|c|^2 - 2 x.c`` is screened with a float32 product. By the standard model of rounding, converting both factors and
    summing d products in any order errs by at most (d + 3) units of sum |x_i c_i| <= |x| |c|, which
    also covers fused steps; the float64 steps around it err by a few units of theirs. Entries whose interval reaches below the least
    upper end are evaluated in int64.
    """
    d = x.shape[1]
    xf, cf = x.astype(np.float64), entries.astype(np.float64)
    square = (cf * cf).sum(1)
    dot = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    score = square - 2 * dot
    size = np.sqrt((xf * xf).sum(1))[:, None] * np.sqrt(square)
    slack = 2.04 * (d + 3) * UNIT * size + 2.0**-44 * (square + size)
    row, entry = np.nonzero(score - slack <= (score + slack).min(1, keepdims=True))
    gap = x[row] - entries[entry]
    exact = (gap * gap).sum(1)
    starts = np.searchsorted(row, np.arange(len(x)))
    best = np.minimum.reduceat(exact, starts) if len(x) else exact
    tied = np.flatnonzero(exact == best[row])
    first = tied[np.unique(row[tied], return_index=True)[1]]
    return entry[first], best, len(row)


def to_integers(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); the product is exact, as the scale is a power of two."""
    return np.floor(flat.astype(np.float64) * SCALE).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of up to ``BLOCK`` rows with their integer vectors ``[row, part, component]``."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            some = batch.slice(a, BLOCK)
            yield some, to_integers(some.column(column).flatten().to_numpy(zero_copy_only=False)).reshape(some.num_rows, PARTS, dim // PARTS)


def _assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [nearest(x[:, p], books[p])[:2] for p in range(PARTS)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def sound_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *others: str) -> DataFrame:
    """``(vec_id, v, others)`` of the rows whose vector holds finite components within reach and no null."""
    kind = table.schema[vector_col].dataType.elementType.simpleString()
    v = F.col(vector_col) if kind in ("float", "double") else F.col(vector_col).cast("array<double>")
    inside = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(REACH // SCALE)))
    return table.where(F.coalesce(inside, F.lit(False)) & (F.size(vector_col) > 0)).select(F.col(id_col).alias("vec_id"), v.alias("v"), *others)


def fit_codebooks(vectors: DataFrame, dim: int) -> np.ndarray:
    """Codebooks ``[part, entry, component]`` of ``vectors`` (``vec_id, v``, all of ``dim`` components).

    They start as the parts of the ``ENTRIES`` smallest ids (equal ids by their vectors) and take ``ROUNDS`` steps of assigning all parts and moving every used entry to the
    floor of its parts' mean. A task sums by part and entry before the shuffle; the sums that
    reach the driver are as many as the entries.
    """
    some = vectors.where("vec_id is not null").orderBy("vec_id", "v").limit(ENTRIES).select("v").collect()
    books = to_integers(np.array([r["v"] for r in some])).reshape(len(some), PARTS, -1).transpose(1, 0, 2).copy()
    k, width = books.shape[1], dim // PARTS
    for _ in range(ROUNDS):
        shared = vectors.sparkSession.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((PARTS * k, width), np.int64), np.zeros(PARTS * k, np.int64)
            for _, x in _blocks(batches, 0, dim):
                index, _ = _assign(x, shared.value)
                cell = (index + np.arange(PARTS) * k).ravel()
                np.add.at(total, cell, x.reshape(-1, width))
                count += np.bincount(cell, minlength=PARTS * k)
            used = np.flatnonzero(count)
            held = [pa.array(used), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(width))]
            yield pa.RecordBatch.from_arrays(held, names=["cell", "n", *(f"s{i}" for i in range(width))])

        names = [f"s{i}" for i in range(width)]
        told = vectors.select("v").mapInArrow(sums, "cell bigint, n bigint, " + ", ".join(f"{s} bigint" for s in names))
        for r in told.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", *names))).collect():
            books[r["cell"] // k, r["cell"] % k] = [r[s] // r["n"] for s in names]
        shared.unpersist()
    return books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, books: np.ndarray, dim: int) -> DataFrame:
    """``vectors`` with ``code`` (two hex digits a part) and ``error`` in place of ``v``."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    at = vectors.columns.index("v")
    rest = [f for f in vectors.schema if f.name != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, at, dim):
            index, distance = _assign(x, shared.value)
            digits = index.astype(np.uint8).tobytes().hex()
            codes = [digits[a : a + 2 * PARTS] for a in range(0, len(digits), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(codes, pa.string()), pa.array(distance.sum(1))], names=[*(f.name for f in rest), "code", "error"])

    return vectors.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", code string, error bigint")


def with_sums(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with ``label_error``, the error summed over its label, null labels together.

    Sums are aggregated before any shuffle; the rows of a hot label stay where they are while the labels are few, which is counted.
    """
    sums = coded.groupBy(F.col(label_col).alias("__label")).agg(F.sum("error").alias("label_error"))
    few = sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    return coded.join(F.broadcast(sums) if few else sums, F.col(label_col).eqNullSafe(F.col("__label"))).drop("__label")


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` for every sound row of ``table``.

    Rows whose vector is null, empty, or holds null or non-finite components are dropped; so are components of 65,536 or more, whose squared distances could leave 64 bits,
    and vectors of another length than the sound one of smallest id. That length must be a multiple of 16. Fewer vectors than 64
    make shorter codebooks. Rows with a null id are coded but start no entry; if all ids are null, nothing can start and the result is empty. Repeated rows come back as often
    and may start several entries. A null label is a label of its own. An empty table gives an empty result; other columns are ignored.
    """
    vectors = sound_vectors(table, id_col, vector_col, label_col).withColumnRenamed(label_col, "label")
    first = vectors.where("vec_id is not null").orderBy("vec_id", "v").select(F.size("v").alias("n")).first()
    if first is None:
        return vectors.where("false").select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    dim = first["n"]
    if dim % PARTS:
        raise ValueError(f"vectors of {dim} components do not fall into {PARTS} equal parts")
    vectors = vectors.where(F.size("v") == dim)
    books = fit_codebooks(vectors.select("vec_id", "v"), dim)
    coded = encode_vectors(vectors, books, dim)
    return with_sums(coded).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
