"""Byte-level BPE: texts to ids by merges over padded matrices, and ids back to bytes."""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of text whose matches are encoded together.
CHARS = 1 << 21
#: Cells of a matrix that merge at once.
CELLS = 1 << 19
#: Matches over this many bytes merge by a heap: a round costs a row's width, so a row costs its square.
LONG = 1024
#: Rank of a pair that does not merge, and the id of padding, which is in no pair.
NONE, PAD = np.int32(2**31 - 1), np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64(token) rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


class PairTable:
    """Hash table with open addressing from a pair of ids to the id, which is the rank, of their union."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = np.array(pairs or np.empty((0, 3)), np.int64).T
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, EMPTY), np.full(1 << self.bits, NONE)
        key, todo = self._key(left, right), np.arange(len(pairs))
        slot = self._slot(key)
        while len(todo):
            free = todo[self.keys[slot[todo]] == EMPTY]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = key[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * MULTIPLIER >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs in the shape of the given arrays; ``NONE`` where they do not merge."""
        key = self._key(left, right).ravel()
        out = np.full(len(key), NONE)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            held = self.keys[slot]
            hit = held == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held != EMPTY)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out.reshape(left.shape)


class Vocabulary:
    """Ranks, their pairs, and the bytes of every id."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.pairs = PairTable(self.ranks)
        self.byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError(f"{path} lacks some single bytes")
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.known = self.lengths > 0


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def width(length: int) -> int:
    """Columns of the matrix that takes a match of this many bytes: exact to 16, then in steps that keep padding under a fifth."""
    if length <= 16:
        return length
    step = 1 << max(length.bit_length() - 3, 2)
    return -(-length // step) * step


def merge_rows(ids: np.ndarray, pairs: PairTable) -> list[np.ndarray]:
    """Ids of every row of a padded matrix once no pair merges.

    A round merges each row's leftmost pair of least rank: its left cell takes the union's id, the
    right one goes, and only the two pairs beside it are looked up again. So all rows lose one cell
    a round; rows without a pair left are taken out.
    """
    out: list[np.ndarray] = [None] * len(ids)
    rows, ranks = np.arange(len(ids)), pairs.find(ids[:, :-1], ids[:, 1:])
    while len(rows):
        n, w = ids.shape
        at = ranks.argmin(1) if w > 1 else np.zeros(n, np.int64)
        low = ranks[np.arange(n), at] if w > 1 else np.full(n, NONE)
        over = low == NONE
        if over.any():
            for row, done in zip(rows[over], ids[over]):
                out[row] = done[done != PAD]
            rows, ids, ranks, at, low = rows[~over], ids[~over], ranks[~over], at[~over], low[~over]
            n = len(rows)
            if not n:
                break
        i = np.arange(n)
        ids[i, at] = low
        kept = np.ones((n, w), bool)
        kept[i, at + 1] = False
        ids = ids[kept].reshape(n, w - 1)
        kept = np.ones((n, w - 1), bool)
        kept[i, at] = False
        ranks = ranks[kept].reshape(n, w - 2)
        before, behind = at > 0, at < w - 2
        x, k = i[before], at[before]
        ranks[x, k - 1] = pairs.find(ids[x, k - 1], ids[x, k])
        x, k = i[behind], at[behind]
        ranks[x, k] = pairs.find(ids[x, k], ids[x, k + 1])
    return out


def merge_long(piece: bytes, vocab: Vocabulary) -> np.ndarray:
    """The same merges for one very long match, from a heap of pairs by rank and place."""
    ids = vocab.byte[np.frombuffer(piece, np.uint8)]
    first = vocab.pairs.find(ids[:-1], ids[1:])
    at = np.flatnonzero(first != NONE)
    heap = list(zip(first[at].tolist(), at.tolist()))
    heapq.heapify(heap)
    now, rank = ids.tolist(), [*first.tolist(), int(NONE)]
    end, none = len(now), int(NONE)
    behind, before = list(range(1, end + 1)), list(range(-1, end - 1))
    seen: dict[tuple[int, int], int] = {}

    def look(k: int) -> None:
        j = behind[k]
        if j >= end:
            rank[k] = none
            return
        pair = (now[k], now[j])
        if pair not in seen:
            seen[pair] = int(vocab.pairs.find(np.array([pair[0]]), np.array([pair[1]]))[0])
        rank[k] = seen[pair]
        if rank[k] != none:
            heapq.heappush(heap, (rank[k], k))

    while heap:
        r, k = heapq.heappop(heap)
        if rank[k] != r:
            continue
        j = behind[k]
        now[k], now[j], rank[j] = r, -1, none
        behind[k] = behind[j]
        if behind[k] < end:
            before[behind[k]] = k
        look(k)
        if before[k] >= 0:
            look(before[k])
    return np.array([x for x in now if x >= 0], np.int32)


def encode_pieces(pieces: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of every match: those of one token at once, the others in matrices of like length."""
    out: list[np.ndarray] = [None] * len(pieces)
    buckets: dict[int, list[int]] = defaultdict(list)
    for k, piece in enumerate(pieces):
        rank = vocab.ranks.get(piece)
        if rank is not None:
            out[k] = np.array([rank], np.int32)
        elif len(piece) > LONG:
            out[k] = merge_long(piece, vocab)
        else:
            buckets[width(len(piece))].append(k)
    for w, members in buckets.items():
        block = max(1, CELLS // w)
        for a in range(0, len(members), block):
            mine = members[a : a + block]
            lengths = np.array([len(pieces[k]) for k in mine])
            ids = np.full((len(mine), w), PAD)
            ids[np.arange(w) < lengths[:, None]] = vocab.byte[np.frombuffer(b"".join(pieces[k] for k in mine), np.uint8)]
            for k, done in zip(mine, merge_rows(ids, vocab.pairs)):
                out[k] = done
    return out


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]``, one behind the other."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def encode_texts(texts: list[str], vocab: Vocabulary, pattern: str = public_tokenizers.PATTERN) -> list[np.ndarray]:
    """Ids of every text. Each distinct match is merged once."""
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    find = _pattern(pattern).findall
    held = [np.fromiter(map(numbers.__getitem__, find(t)), np.int64) for t in texts]
    ids = encode_pieces([p.encode("utf-8") for p in numbers], vocab)
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    starts, flat = np.cumsum(lengths) - lengths, np.concatenate(ids) if ids else np.empty(0, np.int32)
    return [_gather(flat, starts[h], lengths[h]) for h in held]


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    """The bytes of a row of ids."""
    if len(ids) and not (0 <= ids.min() and ids.max() < len(vocab.known) and vocab.known[ids].all()):
        raise ValueError("an id is in no line of the rank file")
    return _gather(vocab.bytes, vocab.starts[ids], vocab.lengths[ids]).tobytes()


def _shares(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of neighbours whose sizes add up to ``most`` or that hold one alone."""
    a = total = 0
    for k, size in enumerate(sizes):
        if k > a and total + size > most:
            yield slice(a, k)
            a, total = k, 0
        total += size
    if a < len(sizes):
        yield slice(a, len(sizes))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row of ``docs``: byte-level BPE by the rank file at ``path``, without special tokens.

    Every match of ``pattern`` is encoded by itself: one that is a token becomes it, in any other the leftmost pair of
    least rank merges until none is left. A null or empty text has no ids, a null id stays, repeated
    rows come back as often, an empty table gives an empty result and other columns are ignored.
    Texts of any length are encoded whole; single matches over ``LONG`` bytes take a heap instead of a matrix, with the same ids.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for some in _shares([len(t) for t in texts], CHARS):
                ids = encode_texts(texts[some], vocab, pattern)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[some.start : some.stop], pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.select(id_col).schema[0].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with the bytes of their ids as ``out_col``, all other columns kept.

    Null ids give null, no ids no bytes; null elements and ids that the file lacks raise an error. Bytes need not be
    UTF-8, since ids may end inside a character.
    """
    path = path or public_tokenizers.path(RANKS)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids = (x.values for x in batch.column(at))
            done = [None if x is None else decode_ids(x.to_numpy(zero_copy_only=False), vocab) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.binary())], names=[*batch.schema.names, out_col])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{types}, `{out_col}` binary")
