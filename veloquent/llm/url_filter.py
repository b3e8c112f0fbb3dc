"""URL filters: host and path rules, then a ratio of character language models.

One smoothed variable-order Markov model is trained on accepted and one on rejected URLs; what no rule
decides is judged by the calibrated, length-normalised difference of the log-likelihoods.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize

# The rules (host and path prefix) and their verdicts.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: Longest context in characters; shorter ones are backed off to.
ORDER = 5
#: Strength of the shorter context's estimate in each step of the smoothing.
BACKOFF = 2.0
#: N-gram occurrences that a task counts or asks for at once.
CHUNK = 4_000_000
#: Characters of URLs that are scored together, with the n-grams that they need.
SCORED = 1_000_000
#: One in so many URLs that rules decide is kept from training, for calibration.
CALIBRATION = 5


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits: its host is the url's or a parent domain, its path a prefix of the url's; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at = rule.index("/")
        name, prefix = rule[:at], rule[at:]
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _grams(urls: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact keys ``[o, i]`` of the (o+1)-gram that ends at character ``i``, of all URLs joined, and each character's url number.

    A key holds its n-gram's bytes, the last one lowest, and its order above them; a URL has ``order``
    marks before its first byte and one behind its last.
    """
    coded = [b"\x02" * order + (u or "").lower().encode("utf-8", "surrogatepass") + b"\x03" for u in urls]
    flat = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    starts = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    owner = np.repeat(np.arange(len(coded)), size)
    real = np.flatnonzero(np.arange(len(flat)) - starts[owner] >= order) if len(coded) else np.empty(0, np.int64)
    keys = np.empty((order + 1, len(real)), np.int64)
    value = np.zeros(len(real), np.int64)
    for o in range(order + 1):
        value = value | flat[real - o] << (8 * o)
        keys[o] = value | (o + 1) << 56
    return keys, owner[real]


@dataclass
class UrlModel:
    """Per kind, accepted and rejected: sorted n-gram keys with counts, sorted contexts with the sums of their n-grams' counts."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    order: int

    @classmethod
    def build(cls, counts: list[tuple[np.ndarray, np.ndarray]], order: int) -> UrlModel:
        """From each kind's sorted keys and counts. A context counts what its n-grams in the model count, so probabilities add up to one."""
        contexts = []
        for keys, n in counts:
            names, at = np.unique(_contexts(keys), return_inverse=True)
            contexts.append((names, np.bincount(at, weights=n, minlength=len(names))))
        return cls(counts, contexts, order)

    def probabilities(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Smoothed probability of each character after its context, from the shortest context to the longest."""
        p = np.full(keys.shape[1], 1 / 256)
        for o in range(self.order + 1):
            p = (_looked_up(self.grams[kind], keys[o]) + BACKOFF * p) / (_looked_up(self.contexts[kind], _contexts(keys[o])) + BACKOFF)
        return p

    def ratio(self, urls: list[str | None]) -> np.ndarray:
        """Mean log-likelihood difference per character, rejected minus accepted, the end mark included."""
        keys, owner = _grams(urls, self.order)
        logs = [np.log(self.probabilities(keys, kind)) for kind in (0, 1)]
        n = np.bincount(owner, minlength=len(urls))
        return np.bincount(owner, weights=logs[1] - logs[0], minlength=len(urls)) / np.maximum(n, 1)


def _looked_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Counts of keys in a sorted table, zero where it lacks one."""
    names, n = table
    if not len(names):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, n[at], 0.0)


def count_grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """``(what, key, n0, n1)``: how often each n-gram (``what`` 0) and each context (1) stands in the rows ``(url, kind)`` of kind 0, accepted, and 1, rejected.

    All rows and n-grams count. Tasks count before the shuffle; a context counts what its n-grams count.
    """
    if not 0 <= order <= 6:
        raise ValueError("order must be 0 to 6")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in _with_end(batches):
            if batch is not None:
                kinds = np.asarray(batch.column(1).to_pylist(), np.int64)
                keys, owner = _grams(batch.column(0).to_pylist(), order)
                held.append((keys.ravel(), np.tile(kinds[owner], order + 1)))
                size += keys.size
                if size < CHUNK:
                    continue
            if held:
                keys, kinds = (np.concatenate(x) for x in zip(*held))
                names, at = np.unique(keys, return_inverse=True)
                sums = [np.bincount(at[kinds == kind], minlength=len(names)) for kind in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(names), *map(pa.array, sums)], names=["key", "n0", "n1"])
                held, size = [], 0

    sums = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    counted = urls.select("url", F.col("kind").cast("bigint")).mapInArrow(count, "key bigint, n0 bigint, n1 bigint")
    grams = counted.groupBy("key").agg(*sums).select(F.lit(0).alias("what"), "key", "n0", "n1")
    # The order stays, the last character goes.
    above = F.shiftleft(F.shiftright("key", 56), 56).bitwiseOR(F.shiftright(F.col("key").bitwiseAND(F.lit((1 << 56) - 1)), 8))
    contexts = counted.groupBy(above.alias("key")).agg(*sums).select(F.lit(1).alias("what"), "key", "n0", "n1")
    return grams.unionByName(contexts)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches and then None, for the last chunk."""
    yield from batches
    yield None


def _contexts(keys: np.ndarray) -> np.ndarray:
    return keys >> 56 << 56 | (keys & ((1 << 56) - 1)) >> 8


def ratios(urls: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(url, ratio)`` for each distinct ``url`` of ``urls`` by the written table ``counts``.

    The model stays a table of any size: URLs are dealt into chunks of about ``SCORED`` characters, each chunk asks once for every n-gram and context
    that it needs, and what the table knows of them meets the chunk.
    """
    known = materialize(urls.select("url").distinct())
    length = known.agg(F.sum(F.length("url") + 2).alias("n")).first()["n"] or 0
    chunk = F.pmod(F.xxhash64("url"), F.lit(max(1, math.ceil(length / SCORED)))).alias("chunk")
    dealt = known.select(chunk, "url")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for number in np.unique(chunks):
                keys = np.unique(_grams([texts[k] for k in np.flatnonzero(chunks == number)], order)[0].ravel())
                above = np.unique(_contexts(keys))
                what = np.repeat(np.array([0, 1], np.int32), [len(keys), len(above)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(what), number)), pa.array(what), pa.array(np.concatenate((keys, above)))], names=["chunk", "what", "key"])

    asked = dealt.mapInArrow(ask, "chunk bigint, what int, key bigint").distinct()
    told = asked.join(counts, ["what", "key"]).select("chunk", "what", "key", "n0", "n1")

    def score(mine: pa.Table, told: pa.Table) -> pa.Table:
        what, key, sums = told["what"].to_numpy(), told["key"].to_numpy(), [told[c].to_numpy().astype(np.float64) for c in ("n0", "n1")]
        rank = np.argsort(key, kind="stable")
        parts = [rank[what[rank] == w] for w in (0, 1)]
        grams, contexts = ([(key[at], n[at]) for n in sums] for at in parts)
        texts = mine["url"].to_pylist()
        return pa.table([mine["url"], pa.array(UrlModel(grams, contexts, order).ratio(texts), pa.float64())], names=["url", "ratio"])

    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, "url string, ratio double")


def calibrate(held: DataFrame, bins: int = 4096, steps: int = 200) -> tuple[float, float]:
    """Slope and offset by logistic regression on held rows ``(ratio, kind)``, over a histogram of fixed size."""
    ratio = held.withColumn("bin", F.least(F.greatest(F.floor(F.col("ratio") * 256), F.lit(-bins // 2)), F.lit(bins // 2)))
    got = ratio.groupBy("bin", "kind").count().toArrow()  # bounded by the bins
    if not got.num_rows:
        return 1.0, 0.0
    x = (got["bin"].to_numpy().astype(float) + 0.5) / 256
    y, w = got["kind"].to_numpy().astype(float), got["count"].to_numpy().astype(float)
    w = w / np.where(y == 1, max(w[y == 1].sum(), 1.0), max(w[y == 0].sum(), 1.0))  # both kinds weigh the same
    theta, ridge = np.zeros(2), np.diag([1e-3, 1e-3])
    features = np.stack([x, np.ones_like(x)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(theta @ features, -50, 50)))
        grad = features @ (w * (p - y)) + ridge @ theta
        step = np.linalg.solve((features * (w * p * (1 - p))) @ features.T + ridge, grad)
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] = RULES, order: int = ORDER) -> DataFrame:
    """``page_id, host, path, rule, verdict, rejected`` for every row of ``pages``.

    URLs that a rule decides are the models' training rows, but for one in ``CALIBRATION`` by CRC-32
    that calibrate. The verdict is the rule's, else block where the calibrated probability of
    rejection exceeds one half. A null URL counts as empty and is judged by the models; URLs of any length count
    whole. With no decided URL of one kind the other URLs are allowed: there is nothing to compare with. Repeated rows
    count and are judged each; an empty table gives an empty result; other columns are ignored.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    kind = F.when(F.col("rule").isin([r for r, v in rules.items() if v == "block"]), 1).otherwise(0)
    decided = rows.where("rule is not null").select("url", kind.alias("kind"))
    held = F.crc32(F.col("url").cast("binary")) % CALIBRATION == 0
    counts = materialize(count_grams(decided.where(~held), order))
    both = counts.agg(F.coalesce(F.sum("n0"), F.lit(0)).alias("n0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("n1")).first()
    scored = materialize(ratios(rows, counts, order))
    discard(counts)
    measured = rows.join(scored.withColumnRenamed("url", "__url"), F.col("url").eqNullSafe(F.col("__url")), "left").drop("__url")
    slope, offset = calibrate(measured.where(F.col("rule").isNotNull() & held).select("ratio", kind.alias("kind")))
    if not both["n0"] or not both["n1"]:
        slope, offset = 0.0, -math.inf
    rejected = 1 / (1 + F.exp(-F.greatest(F.least(F.lit(slope) * F.col("ratio") + offset, F.lit(50.0)), F.lit(-50.0))))
    judged = measured.withColumn("rejected", rejected)
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin([r for r, v in rules.items() if v == "block"]), "block").otherwise("allow")).when(F.col("rejected") > 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "rejected")
