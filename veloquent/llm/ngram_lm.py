"""N-gram language-model scores from an Elias-Fano trie.

The corpus is dealt by word: all n-grams that end in a word, with the two words before it, meet in one shard. A chunk of documents
sends each of its distinct n-grams once. The shard counts them, builds its trie in memory-mapped files and answers
every n-gram of every chunk from it; a chunk's answers meet its documents again, where scores are summed. Nothing of the
size of the vocabulary is gathered in one place. A trie can also be kept and asked about other texts (``fit_model``).
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rule_ensemble import bucket
from .scratch import materialize

#: Words whose counts every task holds, the most frequent ones. They are dealt by the word before as well, so that none
#: fills a shard; the model does not depend on it.
HEAD = 1 << 16
#: Pseudo-occurrences that a context gives to the shorter context's estimate: a multiple of a power of its count, for
#: contexts of one and of two words.
SCALE, POWER = (3.0, 2.0), 0.9
#: Steps to an octave in which probabilities are quantised: 64 octaves below one make 4096 codes.
STEPS = 64
#: Occurrences in a shard, about.
SHARD = 1_500_000
#: A pair of frequent words with more occurrences than a shard's over this is dealt by the word before it too.
HOT_PART = 4
#: Tokens that a task gathers before it deals their n-grams to the shards.
CHUNK = 2_000_000
#: Rows whose texts are split at once, and tokens that are scored or sorted by one more column at once.
READ, MERGED = 1 << 11, 1 << 18
#: Stand for the end of a text and for what precedes its first word; no word holds a line feed.
END_MARK = np.uint64(xxhash.xxh64_intdigest(b"\n end"))
START_MARK = np.uint64(xxhash.xxh64_intdigest(b"\n start"))


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed as they are, high bits as a unary bit vector."""

    def __init__(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray, n: int, bits: int):
        self.low, self.high, self.rank, self.n, self.bits = low, high, rank, n, bits

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        take = np.arange(bits, dtype=np.uint64)
        low = np.concatenate([np.packbits(((values[a : a + (1 << 18), None] >> take) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for a in range(0, n, 1 << 18)]) if bits and n else np.empty(0, np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) // 64 + 1) * 64 if n else 64, np.uint8)
        unary[ones] = 1
        high = np.packbits(unary, bitorder="little")
        rank = np.concatenate(([0], np.cumsum(unary.reshape(-1, 64).sum(1, dtype=np.int64)))).astype(np.int64)
        return cls(low, high, rank, n, bits)

    def slice(self, start: int, stop: int, block: int = 1 << 16) -> np.ndarray:
        """Values ``start`` to ``stop``: select the first high bit, then decode onward, a block at a time."""
        if stop - start > block:
            return np.concatenate([self.slice(a, min(a + block, stop), block) for a in range(start, stop, block)])
        if stop <= start:
            return np.empty(0, np.uint64)
        word = int(np.searchsorted(self.rank, start, "right")) - 1
        last = int(np.searchsorted(self.rank, stop - 1, "right"))
        ones = np.flatnonzero(np.unpackbits(self.high[word * 8 : last * 8], bitorder="little"))
        skip = start - int(self.rank[word])
        high = ones[skip : skip + stop - start] + word * 64 - np.arange(start, stop)
        if not self.bits:
            return high.astype(np.uint64)
        first = start * self.bits
        raw = np.unpackbits(self.low[first // 8 : (stop * self.bits + 7) // 8], bitorder="little")[first % 8 :][: (stop - start) * self.bits]
        low = raw.reshape(-1, self.bits) @ (np.uint64(1) << np.arange(self.bits, dtype=np.uint64))
        return (high.astype(np.uint64) << np.uint64(self.bits)) | low


def to_codes(count: np.ndarray) -> np.ndarray:
    """Codes of n-grams' probabilities: the logarithm of count over total in steps of ``STEPS`` to an octave, counted from one
    occurrence, so that a code means the same whatever the total. Zero is for none."""
    return np.where(count > 0, np.rint(np.log2(np.maximum(count, 1.0)) * STEPS) + 1, 0).astype(np.uint16)


def from_codes(codes: np.ndarray) -> np.ndarray:
    """Counts, that is probabilities times the total, by their codes."""
    return np.where(codes > 0, np.exp2((codes.astype(np.float64) - 1) / STEPS), 0.0)


class Trie:
    """Three levels under a root: words, the words before them, and the words before those.

    Each level holds its nodes in order. A node below the first level is kept relative to its context: its own label, some
    bits of the word's hash, plus the context's rank times the width of a label, so that a whole level is one
    monotone sequence. Monotone pointers say where a node's successors begin in the next level. Codes are quantised
    probabilities. All arrays lie in memory-mapped files of one folder.
    """

    #: Bits of a label on the second and third level.
    WIDTH = (32, 24)
    FILES = tuple(f"{level}.{part}" for level in ("words", "level1", "level2", "pointers0", "pointers1") for part in ("low", "high", "rank", "size")) + ("codes0", "codes1", "codes2")

    def __init__(self, folder: str):
        """Map what ``write`` left in ``folder``."""
        self.folder = folder
        self.words, *self.levels = (self._sequence(n) for n in ("words", "level1", "level2"))
        self.pointers = [self._sequence(f"pointers{k}") for k in range(2)]
        self.codes = [self._array(f"codes{k}", np.uint16) for k in range(3)]

    @classmethod
    def write(cls, folder: str, words: np.ndarray, starts: tuple[np.ndarray, np.ndarray], labels: tuple[np.ndarray, np.ndarray], codes: tuple[np.ndarray, ...]) -> Trie:
        """``words`` sorted; ``starts[k]`` where the successors of level k begin in ``labels[k]``, sorted in each node's range."""
        put = lambda name, values: values.tofile(os.path.join(folder, name))

        def sequence(name: str, values: np.ndarray, universe: int) -> None:
            ef = EliasFano.build(values, max(universe, 1))
            for part, value in (("low", ef.low), ("high", ef.high), ("rank", ef.rank), ("size", np.array([ef.n, ef.bits]))):
                put(f"{name}.{part}", value)

        sequence("words", words, 1 << 64)
        above = len(words)
        for k in range(2):
            owner = np.repeat(np.arange(above, dtype=np.uint64), np.diff(starts[k]))
            sequence(f"level{k + 1}", owner << np.uint64(cls.WIDTH[k]) | labels[k].astype(np.uint64), above << cls.WIDTH[k])
            sequence(f"pointers{k}", starts[k], len(labels[k]) + 1)
            above = len(labels[k])
        for k in range(3):
            put(f"codes{k}", codes[k].astype(np.uint16))
        return cls(folder)

    def _array(self, name: str, kind) -> np.ndarray:
        path = os.path.join(self.folder, name)
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)

    def _sequence(self, name: str) -> EliasFano:
        n, bits = np.fromfile(os.path.join(self.folder, f"{name}.size"), np.int64)
        return EliasFano(self._array(f"{name}.low", np.uint8), self._array(f"{name}.high", np.uint8), self._array(f"{name}.rank", np.int64), int(n), int(bits))

    def find(self, words: np.ndarray, labels: tuple[np.ndarray, np.ndarray], block: int = 1 << 16) -> np.ndarray:
        """Codes ``[level, i]`` of n-grams sorted by word and labels, zero where the trie lacks one.

        Words are found block by block; the pointers give the ranges of the next levels, in which each
        n-gram's successor is searched relative to its context.
        """
        out = np.zeros((3, len(words)), np.uint16)
        for first in range(0, self.words.n, block):
            stop = min(first + block, self.words.n)
            own = self.words.slice(first, stop)
            a, b = np.searchsorted(words, own[0], "left"), np.searchsorted(words, own[-1], "right")
            if a == b:
                continue
            rank = np.searchsorted(own, words[a:b])
            at = np.flatnonzero(own[np.minimum(rank, len(own) - 1)] == words[a:b])
            rank = rank[at] + first
            out[0, a + at] = self.codes[0][rank]
            span = (first, stop)
            for k in range(2):
                span = (int(self.pointers[k].slice(span[0], span[0] + 1)[0]), int(self.pointers[k].slice(span[1], span[1] + 1)[0]))
                level = self.levels[k].slice(*span)
                key = rank.astype(np.uint64) << np.uint64(self.WIDTH[k]) | labels[k][a + at].astype(np.uint64)
                place = np.searchsorted(level, key)
                hit = place < len(level)
                hit[hit] = level[place[hit]] == key[hit]
                at, rank = at[hit], place[hit] + span[0]
                out[k + 1, a + at] = self.codes[k + 1][rank]
        return out


@dataclass
class Chunk:
    """Texts of about ``CHUNK`` tokens: ids, whether they train, numbers of tokens, sorted hashes of the distinct words and marks, and each token's place among those."""

    docs: list[int | None]
    train: np.ndarray
    size: np.ndarray
    words: np.ndarray
    code: np.ndarray

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each of ``words`` in training texts, and in all."""
        n = len(self.words)
        return np.bincount(self.code[np.repeat(self.train, self.size)], minlength=n), np.bincount(self.code, minlength=n)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words after lower-casing A-Z, the end mark behind them; each token's place among those, every text ending with the end mark; numbers of tokens."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    words = np.append(np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names)), END_MARK)
    code = coded.indices.to_numpy()
    full = (names != b"").astype(bool)[code]  # white space at either end leaves an empty word
    upto = np.append(0, np.cumsum(full))[np.cumsum(pc.list_value_length(split).to_numpy())]
    size = np.diff(upto, prepend=0) + 1
    out = np.full(int(size.sum()), len(names), np.int32)
    ends = np.zeros(len(out), bool)
    ends[np.cumsum(size) - 1] = True
    out[~ends] = code[full]
    return words, out, size


def word_counts(rows: DataFrame) -> DataFrame:
    """``(word, n, load)``: hash of every token of the rows ``(text, train)``, its count where ``train`` is set, and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches):
            n, load = held.counts()
            some = load > 0
            yield pa.RecordBatch.from_arrays([pa.array(held.words[some].view(np.int64)), pa.array(n[some]), pa.array(load[some])], names=["word", "n", "load"])

    counted = rows.select("doc_id", "text", "train").mapInArrow(count, "word bigint, n bigint, load bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("load").alias("load"))


def hot_pairs(rows: DataFrame, big: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the pairs of words in ``big`` with at least ``least`` occurrences in all rows, and their counts in training.

    ``big`` is sorted and holds every word with so many occurrences. A key is the first word's place in ``big`` (its
    length for the start mark) times its length, plus the second word's place. At most one in ``least`` pairs comes back.
    """
    shared = rows.sparkSession.sparkContext.broadcast(big)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches):
            key = _pair_keys(held, shared.value)
            keys, load = np.unique(key[key >= 0], return_counts=True)
            own, own_n = np.unique(key[(key >= 0) & np.repeat(held.train, held.size)], return_counts=True)
            n = np.zeros(len(keys), np.int64)
            n[np.searchsorted(keys, own)] = own_n
            del key
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(load)], names=["key", "n", "load"])

    counted = rows.select("doc_id", "text", "train").mapInArrow(count, "key bigint, n bigint, load bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("load").alias("load"))
    got = counted.where(F.col("load") >= least).orderBy("key").toArrow()  # bounded: all occurrences over ``least``
    return got["key"].to_numpy(), got["n"].to_numpy().astype(np.float64)


def _places(names: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of ``asked`` among sorted ``names``, -1 where there is none."""
    if not len(names):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    return np.where(names[at] == asked, at, -1)


def _pair_keys(held: Chunk, big: np.ndarray) -> np.ndarray:
    """Each token's key of ``hot_pairs``, -1 where a word of the pair is not in ``big``."""
    place = _places(big, held.words)[held.code]
    key = np.empty(len(place), np.int64)
    key[1:] = place[:-1]
    key[np.cumsum(held.size) - held.size] = len(big)
    return np.where((place < 0) | (key < 0), -1, key * len(big) + place)


def _with_end(batches):
    yield from batches
    yield None


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Rows ``(doc_id, text, train)`` in chunks of about ``CHUNK`` tokens."""
    docs: list[int | None] = []
    parts: list[tuple[np.ndarray, ...]] = []
    tokens = 0
    for batch in _with_end(batches):
        if batch is not None:
            docs += batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, READ):
                part = batch.slice(at, READ)
                parts.append((*_coded(part.column(1)), np.array(part.column(2).to_pylist(), bool)))
                tokens += len(parts[-1][1])
            if tokens < CHUNK and len(docs) < 1 << 20:
                continue
        if docs:
            words = np.sort(np.concatenate([[START_MARK], *(p[0] for p in parts)]))
            words = words[np.append(True, words[1:] != words[:-1])]
            code = np.empty(tokens, np.int32)
            at = 0
            for own, mine, *_ in parts:
                code[at : at + len(mine)] = np.searchsorted(words, own)[mine]
                at += len(mine)
            held = Chunk(docs, np.concatenate([p[3] for p in parts]), np.concatenate([p[2] for p in parts]), words, code)
            docs, parts, tokens = [], [], 0
            batch = part = own = mine = words = code = None
            pa.default_memory_pool().release_unused()
            yield held


def _order(*columns: tuple[np.ndarray, int]) -> np.ndarray:
    """Order of rows by columns of non-negative numbers and their bits, the last column first, as ``np.lexsort``.

    Plain sorts of numbers that carry their row's place are several times as fast as indirect ones.
    """
    n = len(columns[0][0])
    low = max(n - 1, 1).bit_length()
    order = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    held: list[tuple[np.ndarray, int]] = []
    for value, bits in (*columns, (order, 64)):
        if sum(b for _, b in held) + bits + low > 64:
            key, shift = np.arange(n, dtype=np.uint64), low
            for part, b in held:
                for a in range(0, n, MERGED):
                    key[a : a + MERGED] |= part[order[a : a + MERGED]].astype(np.uint64) << np.uint64(shift)
                shift += b
            key.sort()
            key &= np.uint64((1 << low) - 1)
            order = order[key.view(np.int64)]
            held = []
        held.append((value, bits))
    return order


@dataclass(frozen=True)
class Frequent:
    """What every task knows: sorted frequent words with their counts, sorted words of hot pairs, their keys (``hot_pairs``) and counts."""

    head: np.ndarray
    head_n: np.ndarray
    big: np.ndarray
    hot: np.ndarray
    hot_n: np.ndarray

    def of_words(self, words: np.ndarray, count: np.ndarray) -> np.ndarray:
        """``count``, but what is known for frequent words, which lie in several shards."""
        return _told(self.head, self.head_n, words, count)

    def of_pairs(self, words: np.ndarray, before: np.ndarray, count: np.ndarray) -> np.ndarray:
        """``count``, but what is known for hot pairs, by the second word and the label of the first."""
        if not len(self.hot):
            return count
        left, right = np.divmod(self.hot, len(self.big))
        name = lambda w, b: _mixed(w) ^ b.astype(np.uint64)
        hot = name(self.big[right], np.append(self.big, START_MARK)[left] >> np.uint64(32))
        by = np.argsort(hot)
        return _told(hot[by], self.hot_n[by], name(words, before), count)


@dataclass
class Grams:
    """A chunk's distinct n-grams in the order in which they are dealt: by shard, word and labels."""

    shard: np.ndarray
    word: np.ndarray
    labels: tuple[np.ndarray, np.ndarray]
    train: np.ndarray
    #: Each token's n-gram.
    place: np.ndarray


def _told(names: np.ndarray, values: np.ndarray, asked: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """Values by sorted name, ``otherwise`` where there is none."""
    if not len(names):
        return otherwise
    at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    return np.where(names[at] == asked, values[at], otherwise)


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _grams(held: Chunk, known: Frequent, shards: int) -> Grams:
    """Distinct n-grams of a chunk's texts, how often each occurs in training texts, and where.

    A frequent word's n-grams are dealt by the word before too, those of a hot pair by both words before.
    """
    words, word, begins = held.words, held.code, np.cumsum(held.size) - held.size
    before, second = np.empty_like(word), np.empty_like(word)
    before[1:] = word[:-1]
    before[begins] = np.searchsorted(words, START_MARK)
    second[1:] = before[:-1]
    second[begins] = before[begins]
    bits = len(words).bit_length()
    order = _order((second, bits), (before, bits), (word, bits))
    new = np.zeros(len(order), bool)
    new[0] = True
    for column in (word, before, second):
        column = column[order]
        new[1:] |= column[1:] != column[:-1]
    del column
    one, two, three = (column[order[new]] for column in (word, before, second))
    del before, second
    number = np.cumsum(new, dtype=np.int32) - np.int32(1)
    trained = np.repeat(held.train, held.size)[order]
    train = np.bincount(number[trained], minlength=len(one)).astype(np.uint32)
    del new, trained
    key = words[one]
    frequent = (_places(known.head, words) >= 0)[one]
    key[frequent] ^= _mixed(words)[two[frequent]]
    if len(known.hot):
        place = _places(known.big, words)
        left = np.where(words == START_MARK, len(known.big), place)[two]
        hot = (left >= 0) & (place[one] >= 0)
        hot[hot] = _places(known.hot, left[hot] * len(known.big) + place[one[hot]]) >= 0
        key[hot] = _mixed(words[one[hot]] ^ _mixed(words)[two[hot]]) ^ words[three[hot]]
    shard = ((_mixed(key) >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)
    dealt = _order((shard, max(shards - 1, 1).bit_length()))
    rank = np.empty(len(dealt), np.int32)
    rank[dealt] = np.arange(len(dealt), dtype=np.int32)
    del key
    place = np.empty(len(order), np.int32)
    place[order] = rank[number]
    del order, number, rank
    labels = (words[two[dealt]] >> np.uint64(32)).astype(np.uint32), (words[three[dealt]] >> np.uint64(40)).astype(np.uint32)
    return Grams(shard[dealt], words[one[dealt]], labels, train[dealt], place)


def _dealt(rows: DataFrame, known, shards: int) -> DataFrame:
    """One row of n-grams per chunk and shard that share any: ``(shard, chunk, n, grams)``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for chunk, held in enumerate(_chunks(batches), first):
            g = _grams(held, known.value, shards)
            del held
            ends = np.flatnonzero(np.append(g.shard[1:] != g.shard[:-1], True)) + 1
            for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                runs = np.flatnonzero(np.append(True, g.word[a + 1 : b] != g.word[a : b - 1]))
                low = g.labels[1][a:b]
                parts = (g.word[a:b][runs], np.diff(np.append(runs, b - a)).astype(np.uint32), g.train[a:b], g.labels[0][a:b], (low & np.uint32(0xFFFF)).astype(np.uint16), (low >> np.uint32(16)).astype(np.uint8))
                payload = b"".join(x.tobytes() for x in parts)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((int(g.shard[a]), chunk, b - a, payload), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "chunk", "n", "grams"])

    return rows.select("doc_id", "text", "train").mapInArrow(deal, "shard bigint, chunk bigint, n bigint, grams binary")


def _unpacked(n: int, grams: bytes) -> tuple[np.ndarray, ...]:
    """``(words, lengths of their runs, first label, second label, occurrences in training)`` of one packet."""
    runs = (len(grams) - 11 * n) // 12
    cut = np.cumsum([0, 8 * runs, 4 * runs, 4 * n, 4 * n, 2 * n]).tolist()
    at = lambda k, kind, m: np.frombuffer(grams, kind, m, cut[k])
    return at(0, np.uint64, runs), at(1, np.uint32, runs), at(3, np.uint32, n), at(4, np.uint16, n).astype(np.uint32) | at(5, np.uint8, n).astype(np.uint32) << np.uint32(16), at(2, np.uint32, n)


def _placed(rows: DataFrame, known, shards: int) -> DataFrame:
    """One row per chunk: its documents, their sizes, and each token's n-gram by its place among the chunk's.

    Tokens are read a second time, since these numbers would otherwise pass through the shards with the n-grams.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for chunk, held in enumerate(_chunks(batches), first):
            docs, train, sizes = pa.array(held.docs, pa.int64()), pa.array(held.train), pa.array(held.size)
            at = _grams(held, known.value, shards).place
            del held
            payload = (at & 0xFFFF).astype(np.uint16).tobytes() + (at >> 16).astype(np.uint8 if len(at) < 1 << 24 else np.uint16).tobytes()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (docs, train, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists, pa.array([payload], pa.binary())], names=["chunk", "docs", "train", "sizes", "places"])

    return rows.select("doc_id", "text", "train").mapInArrow(place, "chunk bigint, docs array<bigint>, train array<boolean>, sizes array<bigint>, places binary")


def _summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def _build(folder: str, word: np.ndarray, labels: tuple[np.ndarray, np.ndarray], n: np.ndarray, known: Frequent) -> tuple[Trie, np.ndarray, np.ndarray]:
    """The trie of a shard's sorted n-grams, its words and their exact counts; only those with a training occurrence enter.

    Counts of frequent words and of hot pairs, which lie in several shards, are what every task knows.
    """
    seen = n > 0
    word, first, second, n = word[seen], labels[0][seen], labels[1][seen], n[seen].astype(np.float64)
    change = lambda *columns: np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))) if len(word) else np.empty(0, np.int64)
    at1, at2, at3 = change(word), change(word, first), change(word, first, second)
    words = word[at1]
    count = known.of_words(words, _summed(n, at1))
    pairs = known.of_pairs(word[at2], first[at2], _summed(n, at2))
    starts = np.append(np.searchsorted(at2, at1), len(at2)), np.append(np.searchsorted(at3, at2), len(at3))
    trie = Trie.write(folder, words, starts, (first[at2], second[at3]), (to_codes(count), to_codes(pairs), to_codes(_summed(n, at3))))
    return trie, words, count


def _answers(table: pa.Table, trie: Trie, words: np.ndarray, count: np.ndarray, sizes: list[int], order: np.ndarray, columns: tuple[np.ndarray, ...], known: Frequent) -> pa.Table:
    """Per packet: exact counts of its n-grams' words, and the codes of their pairs and triples, in the packet's order."""
    word, first, second = columns
    codes = trie.find(word, (first, second))
    runs = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    # A shard may hold no training text with a frequent word or a hot pair of its n-grams.
    told = known.of_words(word[runs], _told(words, count, word[runs], np.zeros(len(runs)))).astype(np.uint64)
    exact = np.repeat(told, np.diff(np.append(runs, len(word))))
    pairs = codes[1]
    if len(known.hot):
        hot = np.flatnonzero(np.repeat(_places(known.big, word[runs]) >= 0, np.diff(np.append(runs, len(word)))))
        own = to_codes(known.of_pairs(word[hot], first[hot], np.zeros(len(hot))))
        pairs[hot] = np.where(own > 0, own, pairs[hot])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    out, begin = [], 0
    for size in sizes:
        mine = back[begin : begin + size]
        begin += size
        out.append(zlib.compress(exact[mine].tobytes() + pairs[mine].tobytes() + codes[2][mine].tobytes(), 1))
    return pa.table({"chunk": table["chunk"], "shard": table["shard"], "answer": pa.array(out, pa.binary())})


def _read_packets(table: pa.Table):
    """The packets' sizes, the common sorted order of their n-grams, and the columns in it."""
    sizes = table["n"].to_pylist()
    held, runs, first, second, n = (np.concatenate(x) for x in zip(*(_unpacked(n, g) for n, g in zip(sizes, table["grams"].to_pylist()))))
    words, code = np.unique(held, return_inverse=True)
    code = np.repeat(code, runs)
    order = _order((second, 24), (first, 32), (code, len(words).bit_length()))
    return sizes, order, (words[code[order]], first[order], second[order]), n[order]


ANSWER = "chunk bigint, shard bigint, answer binary"


def _asked(dealt: DataFrame, known) -> DataFrame:
    """Every shard's trie built from its n-grams, and all of them answered from it."""

    def run(table: pa.Table) -> pa.Table:
        sizes, order, columns, n = _read_packets(table)
        with tempfile.TemporaryDirectory() as folder:
            trie, words, count = _build(folder, columns[0], columns[1:], n, known.value)
            return _answers(table, trie, words, count, sizes, order, columns, known.value)

    return dealt.groupBy("shard").applyInArrow(run, ANSWER)


def _merge(one: pa.Table, answers: pa.Table, total: float, distinct: float, starts: float) -> pa.Table:
    """Scores of a chunk's documents from the answers to its n-grams."""
    by = np.argsort(answers["shard"].to_numpy())
    exact, pairs, triples = [], [], []
    packets = answers["answer"].to_pylist()
    for k in by.tolist():
        data = zlib.decompress(packets[k])
        n = len(data) // 12
        exact.append(np.frombuffer(data, np.uint64, n))
        pairs.append(np.frombuffer(data, np.uint16, n, 8 * n))
        triples.append(np.frombuffer(data, np.uint16, n, 10 * n))
    docs, train, sizes = (one[c].combine_chunks()[0].values for c in ("docs", "train", "sizes"))
    size = np.asarray(sizes, np.int64)
    tokens = int(size.sum())
    raw = one["places"][0].as_py()
    high = np.frombuffer(raw, np.uint8 if len(raw) == 3 * tokens else np.uint16, tokens, 2 * tokens)
    low = np.frombuffer(raw, np.uint16, tokens)
    exact, pairs, triples = (np.concatenate(x) for x in (exact, pairs, triples))
    ends = np.cumsum(size)
    sums = []
    for a, b in _runs(ends, MERGED):  # some texts at a time, so that no column of the whole chunk is held
        start = int(ends[a] - size[a])
        place = low[start : ends[b - 1]] | high[start : ends[b - 1]].astype(np.int32) << 16
        first = ends[a:b] - size[a:b] - start
        c1 = exact[place].astype(np.float64)
        p, base = smoothed(c1, from_codes(pairs[place]), from_codes(triples[place]), first, total, distinct, starts)
        sums.append([np.add.reduceat(x, first) for x in ((c1 > 0).astype(np.int64), base, np.log10(p))])
    known, base, model = (pa.array(np.concatenate(x)) for x in zip(*sums))
    return pa.table({"doc_id": docs, "train": train, "tokens": sizes, "known": known, "base": base, "model": model})


def _runs(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts, which end at ``ends``, of about ``size`` tokens each, one text at least."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield a, b
        a = b


def smoothed(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, first: np.ndarray, total: float, distinct: float, starts: float) -> tuple[np.ndarray, np.ndarray]:
    """Each token's probability after the two words before it, and log10 of its base share, from counts of what ends in it.

    ``first`` is where texts begin. A context's count is that of what ends in the token before, or of the starts of texts.
    """
    one, two = np.append(starts, c1[:-1]), np.append(starts, c2[:-1])
    one[first] = two[first] = starts
    share = (c1 + 0.5) / (total + 0.5 * (distinct + 1))
    p = share
    for count, context, scale in ((c2, one, SCALE[0]), (c3, two, SCALE[1])):
        mass = scale * np.maximum(context, 1.0) ** POWER
        # Quantised, an n-gram may count a little more than its context.
        p = (np.minimum(count, context) + mass * p) / (context + mass)
    return p, np.log10(share)


def _by_word(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Words in order and their counts."""
    words, n = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy().astype(np.float64)
    by = np.argsort(words)
    return words[by], n[by]


@dataclass
class Totals:
    """Training tokens, distinct ones, texts, and tokens of all rows."""

    tokens: float
    distinct: float
    texts: float
    load: int


def _surveyed(rows: DataFrame, head_size: int, shard_size: int) -> tuple[Totals, Frequent]:
    """Totals and what every task has to know, from the words' counts; all that comes back is bounded by the parameters or ``least``."""
    kept = materialize(word_counts(rows))
    size = kept.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.sum("load").alias("load")).first()
    least = max(1, shard_size // HOT_PART)
    many = kept.where(F.col("load") >= least)  # bounded: all occurrences over ``least``
    big, _ = _by_word(many.toArrow())
    # All words of hot pairs are among the frequent ones, as they too lie in several shards.
    head, head_n = _by_word(kept.orderBy(F.desc("n"), "word").limit(head_size).union(many).distinct().toArrow())
    hot, hot_n = hot_pairs(rows, big, least) if len(big) else (np.empty(0, np.int64), np.empty(0))
    ended = kept.where(F.col("word") == int(END_MARK.astype(np.int64))).first()  # texts start as often as they end
    return Totals(float(size["n"] or 0), float(size["v"]), float(ended["n"]) if ended else 0.0, size["load"] or 0), Frequent(head, head_n, big, hot, hot_n)


def _finished(rows: DataFrame, answers: DataFrame, known, shards: int, totals: Totals) -> DataFrame:
    """Chunks' documents with their answers: the columns of ``score_texts``."""

    def merge(one: pa.Table, mine: pa.Table) -> pa.Table:
        return _merge(one, mine, totals.tokens, totals.distinct, totals.texts)

    placed = _placed(rows, known, shards)
    per = placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(merge, "doc_id bigint, train boolean, tokens bigint, known bigint, base double, model double")
    return per.select("doc_id", (~F.col("train")).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(int(totals.tokens)).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"))


def _rows(docs: DataFrame, id_col: str, text_col: str, held_out) -> DataFrame:
    held = F.coalesce(held_out if held_out is not None else bucket(id_col, 5) == 1, F.lit(False))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), (~held).alias("train"))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, head_size: int = HEAD, shard_size: int = SHARD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Counts come from all rows that ``held_out`` (by default: CRC-32 of the id's text modulo 5 is 1)
    leaves. The model is a trie of one to three words with Dirichlet smoothing from each order to the next:
    p(w | v) = (c(v w) + m(v) p(w)) / (c(v) + m(v)) for contexts v of one and of two words, m(v) = SCALE c(v)^POWER for every
    context alike, p(w) the smoothed unigram share; c of two and three words are quantised in the trie. Words are told apart by
    64-bit hashes, the words before them by 32 and 24 bits. A null text holds the end mark alone; a null id
    counts as the empty text for the split; rows that repeat an id are scored each; texts of any length count whole. With no training
    row all counts are zero; an empty table gives an empty result; other columns are ignored.
    """
    rows = _rows(docs, id_col, text_col, held_out)
    totals, frequent = _surveyed(rows, head_size, shard_size)
    shards = max(1, int(np.ceil(totals.load / shard_size)))
    known = rows.sparkSession.sparkContext.broadcast(frequent)
    answers = _asked(_dealt(rows, known, shards).repartition(shards, "shard"), known)
    return _finished(rows, answers, known, shards, totals)


@dataclass
class LanguageModel:
    """A trie kept as a table ``(shard, file, data)`` in the shared folder, with what its shards are found by."""

    files: DataFrame
    totals: Totals
    frequent: Frequent
    shards: int

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The columns of ``score_texts`` for any texts; none of them is a training text here."""
        rows = _rows(docs, id_col, text_col, F.lit(True))
        known = rows.sparkSession.sparkContext.broadcast(self.frequent)

        def run(table: pa.Table, files: pa.Table) -> pa.Table:
            if not len(table):
                return pa.table({"chunk": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "answer": pa.array([], pa.binary())})
            sizes, order, columns, _ = _read_packets(table)
            with tempfile.TemporaryDirectory() as folder:
                for name, data in zip(files["file"].to_pylist(), files["data"].to_pylist()):
                    with open(os.path.join(folder, name), "wb") as f:
                        f.write(data)
                if not len(files):  # no training text has an n-gram here
                    none = np.empty(0, np.uint32)
                    Trie.write(folder, np.empty(0, np.uint64), (np.zeros(1, np.int64),) * 2, (none, none), (none,) * 3)
                    np.empty(0).tofile(os.path.join(folder, "counts"))
                trie = Trie(folder)
                words = trie.words.slice(0, trie.words.n)
                return _answers(table, trie, words, np.fromfile(os.path.join(folder, "counts")), sizes, order, columns, known.value)

        answers = _dealt(rows, known, self.shards).groupBy("shard").cogroup(self.files.groupBy("shard")).applyInArrow(run, ANSWER)
        return _finished(rows, answers, known, self.shards, self.totals)


def fit_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, head_size: int = HEAD, shard_size: int = SHARD) -> LanguageModel:
    """Count the training rows as ``score_texts`` does and keep the trie, to score other texts with it."""
    rows = _rows(docs, id_col, text_col, held_out).where("train")
    totals, frequent = _surveyed(rows, head_size, shard_size)
    shards = max(1, int(np.ceil(totals.load / shard_size)))
    known = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(table: pa.Table) -> pa.Table:
        _, _, columns, n = _read_packets(table)
        with tempfile.TemporaryDirectory() as folder:
            _, _, count = _build(folder, columns[0], columns[1:], n, known.value)
            count.tofile(os.path.join(folder, "counts"))
            names = [*Trie.FILES, "counts"]
            data = []
            for name in names:
                with open(os.path.join(folder, name), "rb") as f:
                    data.append(f.read())
        return pa.table({"shard": pa.array([table["shard"][0].as_py()] * len(names), pa.int64()), "file": pa.array(names), "data": pa.array(data, pa.binary())})

    files = materialize(_dealt(rows, known, shards).repartition(shards, "shard").groupBy("shard").applyInArrow(run, "shard bigint, file string, data binary"))
    return LanguageModel(files, totals, frequent, shards)
