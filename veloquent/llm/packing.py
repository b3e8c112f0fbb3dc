"""Best-fit packing of token sequences, improved by swap-based local search."""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .scratch import materialize

CAPACITY = 1024
#: Id that ends every document.
END = 2
#: Pieces packed together; each block is one task's search.
BLOCK = 8192
#: Texts over this many characters are encoded by the other library.
LONG = 1_000_000
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: The vocabulary's one special token.
SPECIAL = "<|endoftext|>"


@lru_cache(4)
def _reference(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(4)
def _fast(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, vocabulary: str, ranks: str) -> list[int]:
    """The text's ids as the vocabulary file's own library gives them without special tokens added.

    The rank file holds the same vocabulary and encodes several times as fast; texts with the
    special token's string, which the two libraries read differently, and very long ones take the
    vocabulary file.
    """
    if not text:
        return []
    if SPECIAL in text or len(text) > LONG:
        return _reference(vocabulary).encode(text, add_special_tokens=False).ids
    return _fast(ranks).encode_ordinary(text)


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole if it fits, else full pieces after a shorter first one."""
    first = length if length <= capacity else length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def tokenized(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, ids_crc32[, ids])`` of every row; a null or empty text holds the end id alone.

    Texts of any length are encoded whole. Repeated rows and null ids are pieces like any other, an empty table gives none, and
    other columns are ignored.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    ranks = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py(), vocabulary, ranks), END], "<u4")
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[at : at + n]
                    rows.append((doc, k, at, n, zlib.crc32(part.tobytes()), part.tolist() if with_ids else None))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            take = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:take], kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:take])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fits = open_gaps >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps ^= 1 << gap
            bins[b].append(item)
        else:
            gap, b = capacity, len(bins)
            bins.append([item])
        left = gap - size
        if left:
            by_gap[left].append(b)
            open_gaps |= 1 << left
    return bins


class Search:
    """Local search over underfull bins; every accepted step raises the sum of squared fills."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int = CAPACITY):
        self.sizes, self.capacity = sizes, capacity
        self.bins = {b: list(items) for b, items in enumerate(bins)}
        self.gap = {b: capacity - sum(sizes[i] for i in items) for b, items in self.bins.items()}
        #: Underfull bins by the sizes that they hold, and by gap.
        self.holding: dict[int, dict[int, None]] = defaultdict(dict)
        self.by_gap: dict[int, dict[int, None]] = defaultdict(dict)
        for b in self.bins:
            self._list(b)

    def _list(self, b: int) -> None:
        if self.gap[b] > 0:
            self.by_gap[self.gap[b]][b] = None
            for i in self.bins[b]:
                self.holding[self.sizes[i]][b] = None

    def _unlist(self, b: int) -> None:
        self.by_gap.get(self.gap[b], {}).pop(b, None)
        if b in self.bins and not self.by_gap.get(self.gap[b], True):
            del self.by_gap[self.gap[b]]
        for i in self.bins[b]:
            self.holding[self.sizes[i]].pop(b, None)

    def _trade(self, low: int, give: list[int], other: int, take: list[int]) -> None:
        """Move items ``give`` from bin ``low`` to ``other`` and ``take`` back."""
        self._unlist(low)
        self._unlist(other)
        for i in give:
            self.bins[low].remove(i)
            self.bins[other].append(i)
        for i in take:
            self.bins[other].remove(i)
            self.bins[low].append(i)
        moved = sum(self.sizes[i] for i in give) - sum(self.sizes[i] for i in take)
        self.gap[low] += moved
        self.gap[other] -= moved
        if self.bins[low]:
            self._list(low)
        else:
            del self.bins[low], self.gap[low]
        self._list(other)

    def _into(self, low: int, size: int) -> int | None:
        """The fullest other bin with room for ``size``, no emptier than ``low``."""
        for gap in sorted(g for g in self.by_gap if size <= g <= self.gap[low]):
            for b in self.by_gap[gap]:
                if b != low:
                    return b
        return None

    def _for(self, low: int, size: int) -> tuple[int, int] | None:
        """A bin and an item of it, smaller than ``size`` by what its gap allows, that leaves the least gap."""
        widest = min(max(self.by_gap, default=0), self.gap[low])
        for less in range(min(widest, size - 1), 0, -1):
            for b in self.holding.get(size - less, ()):
                if b != low and less <= self.gap[b] <= self.gap[low]:
                    return b, next(i for i in self.bins[b] if self.sizes[i] == size - less)
        return None

    def step(self, low: int) -> bool:
        """One move, one-for-one or two-for-one exchange out of bin ``low``; False if none helps."""
        items = sorted(self.bins[low], key=lambda i: -self.sizes[i])
        for i in items:
            if (b := self._into(low, self.sizes[i])) is not None:
                self._trade(low, [i], b, [])
                return True
        for i in items:
            if found := self._for(low, self.sizes[i]):
                self._trade(low, [i], found[0], [found[1]])
                return True
        for k, i in enumerate(items):
            for j in items[k + 1 :]:
                if self.sizes[i] + self.sizes[j] <= self.capacity and (found := self._for(low, self.sizes[i] + self.sizes[j])):
                    self._trade(low, [i, j], found[0], [found[1]])
                    return True
        return False

    def run(self) -> list[list[int]]:
        """Pass over the underfull bins, the emptiest first, until a whole pass finds no step or as few bins are left as the sum of sizes needs."""
        least = -(-sum(self.sizes) // self.capacity)
        moved = True
        while moved and len(self.bins) > least:
            moved = False
            for low in sorted((b for b in self.bins if self.gap[b] > 0), key=lambda b: (-self.gap[b], b)):
                while low in self.bins and self.gap[low] > 0 and self.step(low):
                    moved = True
                if len(self.bins) <= least:
                    break
        return list(self.bins.values())


def pack_sizes(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers for sizes of 1 to ``capacity``."""
    return Search(sizes, best_fit(sizes, capacity), capacity).run()


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces with a ``length`` of at most ``capacity``.

    Full pieces are sequences of their own. The others are dealt into blocks of about ``block`` by a
    hash of their row, so equal ids or lengths never gather in one task; each block is packed by
    itself, which costs at most a partly filled sequence or so per block. Only rows of numbers are
    shuffled.
    """
    rest = pieces.where(F.col("length") < capacity)
    blocks = max(1, round(rest.count() / block))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def place(table: pa.Table) -> pa.Table:
        number = table["__block"][0].as_py()
        order, sequence, offset = [], [], []
        sizes = table["length"].to_pylist()
        for k, items in enumerate(pack_sizes(sizes, capacity)):
            at = 0
            for i in items:
                order.append(i)
                sequence.append(2 * ((number << 24) + k))
                offset.append(at)
                at += sizes[i]
        placed = table.drop_columns(["__block"]).take(pa.array(order, pa.int64()))
        return placed.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = rest.withColumn("__block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("bigint"))
    packed = dealt.groupBy("__block").applyInArrow(place, f"{types}, sequence_id bigint, offset bigint")
    whole = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("bigint"))
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize every row of ``docs`` once, cut what is too long and pack the pieces into sequences.

    Null and empty texts are one piece of one id. Repeated rows and null ids are packed each; equal lengths are placed in a fixed order. An empty table gives no sequence and
    other columns are ignored.
    """
    return pack(materialize(tokenized(docs, capacity, id_col, text_col, vocabulary, ranks, with_ids)), capacity)
