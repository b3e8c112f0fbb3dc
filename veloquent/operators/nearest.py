"""The segment that a word belongs to, found by sorted arrays of a stretch of a file instead of pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_reaching(values: np.ndarray, before: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each query the last index below ``before`` whose value is at least ``least``, or -1, by a tree of maxima."""
    low = np.iinfo(np.int64).min
    levels = [values]
    while len(levels[-1]) > 1:
        up = np.append(levels[-1], low) if len(levels[-1]) % 2 else levels[-1]
        levels.append(up.reshape(-1, 2).max(axis=1))
    left, node, found = before.copy(), np.full(len(before), -1), np.full(len(before), -1)
    for k, level in enumerate(levels):
        ask = np.flatnonzero((found < 0) & (left % 2 == 1))
        hit = ask[level[left[ask] - 1] >= least[ask]]
        node[hit], found[hit] = left[hit] - 1, k
        left //= 2
    for k in range(len(levels) - 1, 0, -1):
        down, below = np.flatnonzero(found >= k), levels[k - 1]
        right = 2 * node[down] + 1
        node[down] = right - ((right >= len(below)) | (below[np.minimum(right, len(below) - 1)] < least[down]))
    return node


def best_segments(a: np.ndarray, b: np.ndarray, s: np.ndarray, e: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each word [a, b) the index of the segment [s, e) of the largest overlap, then the nearest middle, then the earliest (start, pos); -1 for none.

    Of segments that hold the word the nearest middle wins: looking back the last one that ends late enough, looking ahead the first
    one that starts early enough. A word that none holds meets segments that hold its start, of which the last end wins, or its end,
    of which the first start wins, or lie inside, for which each length that is shorter than a word is tried from the longest down.
    """
    best = np.full(len(a), -1)
    if not len(s) or not len(a):
        return best
    m, order = a + b, np.lexsort((pos, s, s + e))
    s, e, pos, c = s[order], e[order], pos[order], (s + e)[order]
    back = last_reaching(e, np.searchsorted(c, m, "right"), b)
    back = np.where(back < 0, -1, np.searchsorted(c, c[back], "left"))
    ahead = last_reaching(-s[::-1], len(s) - np.searchsorted(c, m, "left"), -a)
    ahead = np.where(ahead < 0, -1, len(s) - 1 - ahead)
    rest = np.flatnonzero((back < 0) & (ahead < 0))

    def better(words: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Of two segments for each word, either of which may be -1, the better one."""
        key = lambda i: (np.where(i < 0, 1, -(np.minimum(b[words], e[i]) - np.maximum(a[words], s[i]))), np.abs(c[i] - m[words]), s[i], pos[i])
        less, same = np.zeros(len(words), bool), np.ones(len(words), bool)
        for x, y in zip(key(two), key(one)):
            less |= same & (x < y)
            same &= x == y
        return np.where(less, two, one)

    best = better(np.arange(len(a)), back, ahead)
    if len(rest):
        ra, rb, rm = a[rest], b[rest], m[rest]
        start = np.argsort(s, kind="stable")
        rank = np.empty(len(s), np.int64)
        rank[np.lexsort((-pos, s, e))] = np.arange(len(s))  # the later end first, then the later start, then the smaller pos
        last = start[_running_best(rank[start])]
        at = np.searchsorted(s[start], ra, "right") - 1
        holds_start = np.where((at >= 0) & (e[last[at]] > ra), last[at], -1)
        end = np.argsort(-e, kind="stable")
        rank[np.lexsort((-pos, -e, -s))] = np.arange(len(s))
        first = end[_running_best(rank[end])]
        at = np.searchsorted(-e[end], -rb, "right") - 1
        holds_end = np.where((at >= 0) & (s[first[at]] < rb), first[at], -1)
        inside, length = np.full(len(rest), -1), e - s
        for n in np.unique(length[length < (rb - ra).max()])[::-1]:
            own = np.flatnonzero(length == n)
            ask = np.flatnonzero((inside < 0) & (rb - ra > n))
            after = np.minimum(np.searchsorted(c[own], rm[ask], "left"), len(own) - 1)
            before = np.maximum(np.searchsorted(c[own], rm[ask], "left") - 1, 0)
            before = np.searchsorted(c[own], c[own][before], "left")
            near = np.where(np.abs(c[own][after] - rm[ask]) < np.abs(c[own][before] - rm[ask]), own[after], own[before])
            inside[ask] = np.where((n > 0) & (s[near] >= ra[ask]) & (e[near] <= rb[ask]), near, -1)
        best[rest] = better(rest, better(rest, holds_start, holds_end), inside)
    return np.where(best < 0, -1, order[best])


def _running_best(rank: np.ndarray) -> np.ndarray:
    """Index of the largest rank so far."""
    top = np.maximum.accumulate(rank)
    return np.maximum.accumulate(np.where(rank == top, np.arange(len(rank)), 0))


def place_words(words: DataFrame, segments: DataFrame, key: str, longest: int, width: int = 16_000) -> DataFrame:
    """Words with ``hit``, the speaker of the segment that overlaps a word most, and the segments that end before and start after its middle.

    ``words`` hold key, ``pos``, ``start_ms``, ``end_ms`` (at most ``longest`` behind the start) and ``mid2``, the sum of both; ``segments`` hold ``speaker`` instead
    of the last. Added are ``hit``, ``prev_spk``, ``prev_end``, ``next_spk`` and ``next_start``. Words are dealt by key and the bucket of their middle,
    segments by all buckets whose words they may meet; a bucket also takes in the last segment that ends before it and the first that starts behind it.
    """
    number = lambda x: F.floor(x / width)
    dealt = words.withColumn("__b", number(F.col("mid2") / 2))
    segments = segments.dropna(subset=[key, "start_ms", "end_ms"])
    reach = -(-longest // 2)
    met = segments.withColumn("__b", F.explode(F.sequence(number(F.col("start_ms") - reach), number(F.col("end_ms") + reach))))
    asked = dealt.where(F.col("__b").isNotNull()).select(key, "__b").distinct()
    row = ["pos", "start_ms", "end_ms", "speaker"]

    def carried(time: str, sign: int) -> DataFrame:
        first = F.struct((F.col(time) * -sign).alias("t"), *row)
        own = segments.groupBy(key, number(F.col(time)).alias("__b")).agg(F.min(first).alias("__own"))
        every = own.unionByName(asked.withColumn("__asked", F.lit(True)), allowMissingColumns=True).groupBy(key, "__b").agg(F.first("__own", ignorenulls=True).alias("__own"), F.max("__asked").alias("__asked"))
        before = F.last("__own", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.col("__b") * sign).rowsBetween(Window.unboundedPreceding, -1))
        return every.withColumn("__before", before).where("__asked and __before is not null").select(key, "__b", *(F.col(f"__before.{c}").alias(c) for c in row))

    near = met.select(key, "__b", *row).unionByName(carried("end_ms", 1)).unionByName(carried("start_ms", -1))
    kept, added = words.columns, ["hit", "prev_spk", "prev_end", "next_spk", "next_start"]

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict.fromkeys(added, pa.nulls(left.num_rows, pa.int64()))
        if left.num_rows and right.num_rows:
            number = lambda t, c: t[c].fill_null(np.iinfo(np.int64).min).to_numpy()
            a, b, m = (number(left, c) for c in ("start_ms", "end_ms", "mid2"))
            pos, s, e, speaker = (number(right, c) for c in row)
            take = lambda values, at: pa.array(values[at], mask=at < 0)
            got["hit"] = take(speaker, best_segments(a, b, s, e, pos))
            order = np.lexsort((pos, e))
            at = np.searchsorted(2 * e[order], m, "right") - 1
            at = np.where(at < 0, -1, order[np.searchsorted(e[order], e[order][at], "left")])
            got["prev_spk"], got["prev_end"] = take(speaker, at), take(e, at)
            order = np.lexsort((pos, s))
            at = np.searchsorted(2 * s[order], m, "left")
            at = np.where(at < len(s), order[np.minimum(at, len(s) - 1)], -1)
            got["next_spk"], got["next_start"] = take(speaker, at), take(s, at)
        return pa.table({c: left[c] for c in kept} | got)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema) + "".join(f", {c} bigint" for c in added)
    return dealt.groupBy(key, "__b").cogroup(near.groupBy(key, "__b")).applyInArrow(place, schema)
