"""Mixing to target weights with soft domain membership.

A classifier fitted on the labels table gives every document a posterior over domains. Projected
gradient steps over all documents find nonnegative rates whose expected token totals per domain match
the targets in the least-squares sense.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Domains in the order of the posterior, and the share of all tokens that each shall have.
TARGETS = {"clean": 0.95, "toxic": 0.05, "low": 0.0}
#: The domain whose tokens set the size of the mix: its documents keep a rate about one.
ANCHOR = "clean"
#: Labelled documents that the classifier learns from at most: those with the smallest hashes of their ids.
MAX_TRAIN = 10_000
#: Words whose presence the classifier sees.
WORDS = 256
#: Posteriors are multiples of one in so many; documents with equal ones have equal rates.
GRID = 1024
#: Largest rate of a document.
MAX_RATE = 4.0
#: Steps at most, and the share of all tokens by which no domain's total may still move when the steps end.
STEPS, TOLERANCE = 200, 1e-5
#: Share of all tokens by which a domain's total may miss its goal before a warning says so.
UNMET = 0.005
#: Documents whose rates are rounded together, about.
BLOCK = 100_000

SYMBOLS, MARKS = b"#*$%&|<>", b"!?"
UPPER = bytes(range(65, 91))
EDGE = b".,;:!?\"'()#*$%&|<>"
N_STATS = 5


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _stats(text: str | None, words: list[bytes], distinct: int) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    return [min(1.0, 10 * share(SYMBOLS)), min(1.0, 10 * share(MARKS)), min(1.0, 4 * share(UPPER)), 1 - distinct / max(len(words), 1) ** 0.9, min(1.0, np.log1p(len(words)) / 10)]


@dataclass(frozen=True)
class DomainModel:
    """Words by feature number, and the weights of a multinomial logistic regression."""

    words: dict[bytes, int]
    coefficients: np.ndarray
    intercepts: np.ndarray

    def features(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of words, and the feature vector: statistics, then which words occur."""
        words = _words(text)
        found = set(words)
        out = np.zeros(N_STATS + len(self.words))
        out[:N_STATS] = _stats(text, words, len(found))
        for w in found:
            at = self.words.get(w.strip(EDGE))
            if at is not None:
                out[N_STATS + at] = 1.0
        return len(words), out

    def posterior(self, features: np.ndarray) -> np.ndarray:
        logits = features @ self.coefficients.T + self.intercepts
        e = np.exp(logits - logits.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)


def domain() -> Column:
    """Number of a labelled row's domain: toxic, else low quality, else clean."""
    return F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).otherwise(0)


def fit_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, n_words: int = WORDS) -> DomainModel:
    """Fit the posterior on at most ``max_train`` labelled documents.

    The words are those whose document counts over the domains stray most from independence.
    A domain without a labelled row has no documents; with one domain alone all
    documents share the labels' frequencies.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = materialize(known.orderBy(F.xxhash64("__id"), "__id").limit(max_train).select("__id", domain().cast("int").alias("k")))
    rows = materialize(docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("text", "k"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, kinds = [], []
            for text, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {w.strip(EDGE) for w in _words(text)}
                words.extend(found)
                kinds.extend([k] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(kinds, pa.int32())], names=["word", "k"])

    sizes = {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a domain
    total = max(sum(sizes.values()), 1)
    counts = rows.mapInArrow(spell, "word binary, k int").groupBy("word").agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col("k") == k).cast("int")).alias(f"n{k}") for k in range(len(TARGETS))))
    stray = sum((F.pow(F.col(f"n{k}") - F.col("n") * (sizes.get(k, 0) / total), F.lit(2.0)) / (F.col("n") * ((sizes.get(k, 0) + 1) / total)) for k in range(len(TARGETS))), F.lit(0.0))
    top = counts.where("n >= 5").orderBy(stray.desc(), "word").limit(n_words).select("word").collect()  # n_words at most
    words = {bytes(r["word"]): i for i, r in enumerate(top)}
    blank = DomainModel(words, np.zeros((len(TARGETS), N_STATS + len(words))), np.log([(sizes.get(k, 0) + 1) / total for k in range(len(TARGETS))]))
    if len(sizes) < 2:
        return blank

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [blank.features(t.as_py())[1].tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "k"])

    ready = rows.mapInArrow(featurise, "x array<double>, k int").select(array_to_vector("x").alias("x"), F.col("k").cast("double").alias("k"))
    fit = LogisticRegression(featuresCol="x", labelCol="k", family="multinomial", regParam=0.001, maxIter=60).fit(materialize(ready))
    found, bias = fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()
    weights, intercepts = blank.coefficients.copy(), blank.intercepts.copy()
    weights[: len(found)], intercepts[: len(bias)] = found, bias
    for k in range(len(TARGETS)):
        if k not in sizes:
            intercepts[k] = -np.inf
    return DomainModel(words, weights, intercepts)


def posteriors(docs: DataFrame, model: DomainModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``tokens`` (words) and ``p``, the posterior over the domains in steps of one in ``GRID``, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.features(t.as_py()) for t in batch.column(len(keep))]
            p = shared.value.posterior(np.stack([x for _, x in got])) if got else np.empty((0, len(TARGETS)))
            p = np.floor(p * GRID + 0.5) / GRID
            p[:, 0] = 1 - p[:, 1:].sum(1)
            held = pa.array(p.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([n for n, _ in got], pa.int64()), held], names=[*keep, "tokens", "p"])

    wanted = docs.select(*keep, F.col(text_col).alias("__text"))
    types = ", ".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in keep)
    return wanted.mapInArrow(run, f"{types}, tokens bigint, p array<double>")


def _rates(p: np.ndarray, steps: list[np.ndarray], max_rate: float, ahead: bool = False) -> np.ndarray:
    """Rates after the steps: each moves by the document's posterior times a vector and projects back.

    Each step starts from a point ahead of the last rates, by Nesterov's momentum; ``ahead`` gives the
    point from which the next one starts.
    """
    rate = point = np.ones(len(p))
    for k, v in enumerate(steps):
        before, rate = rate, np.clip(point - p @ v, 0.0, max_rate)
        point = rate + k / (k + 3) * (rate - before)
    return point if ahead else rate


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.asarray(batch.column(at).flatten(), np.float64).reshape(batch.num_rows, len(TARGETS))


def fit_rates(table: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = ANCHOR, max_rate: float = MAX_RATE, steps: int = STEPS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """The gradient steps that lead from rate one to the fitted rates, over a written table ``(tokens, p)``.

    Minimises the sum over domains of (expected tokens - target)^2 / target by accelerated projected
    gradient, documents weighing by their tokens. The step size comes from the largest eigenvalue of the
    domains' Gram matrix. A document's rate follows from its posterior and the steps alone, so tokens
    are summed by posterior first, at most ``GRID``^2 / 2 rows for three domains however many documents there are; a
    step moves K sums to the driver and K numbers back. A warning tells of goals that the rates do not reach.
    """
    k = len(targets)
    names = [f"s{i}" for i in range(k)]

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            p = _matrix(batch, 1)
            total += p.T @ (p * batch.column(0).to_numpy()[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.ravel()], names=[f"g{i}" for i in range(k * k)])

    rows = materialize(table.groupBy("p").agg(F.sum("tokens").alias("tokens")).where("tokens > 0").select("tokens", "p"))
    got = rows.mapInArrow(gram, ", ".join(f"g{i} double" for i in range(k * k))).agg(*(F.sum(f"g{i}").alias(f"g{i}") for i in range(k * k))).first()
    h = np.array([x or 0.0 for x in got]).reshape(k, k)
    now = h.sum(1)
    share = np.array(list(targets.values()))
    at = list(targets).index(anchor)
    goal = share * (now[at] / share[at])
    if not goal.sum():
        return []
    weight = 1 / np.maximum(goal, 0.01 * goal.sum())
    root = np.sqrt(weight)
    rate = 1 / max(np.linalg.eigvalsh(root[:, None] * h * root[None, :]).max(), 1e-300)
    done: list[np.ndarray] = []
    still = 0

    def totals(ahead: bool) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch], done=tuple(done)) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k)
            for batch in batches:
                p = _matrix(batch, 1)
                total += p.T @ (batch.column(0).to_numpy() * _rates(p, done, max_rate, ahead))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=names)

        found = rows.mapInArrow(sums, ", ".join(f"{n} double" for n in names)).agg(*(F.sum(n).alias(n) for n in names)).first()
        return np.array([x or 0.0 for x in found])

    for _ in range(steps):
        done.append(rate * weight * (now - goal))
        last, now = now, totals(True)
        still = still + 1 if np.abs(now - last).max() < tolerance * goal.sum() else 0
        if still == 2:
            break
    missed = np.abs(totals(False) - goal) / goal.sum()
    if missed.max() > UNMET:
        warnings.warn("rates miss the goals by these shares of all tokens: " + ", ".join(f"{n} {x:.4f}" for n, x in zip(targets, missed)), stacklevel=2)
    return done


def round_rates(rate: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Whole copies for rates, one up or down, so that the sums of ``load`` (row, domain) stay as the rates have them.

    Rows are taken by falling load. Each takes the whole number on either side of its rate that
    leaves the smaller error, summed over the rows so far, so the error left is about that of the smallest row.
    """
    out = np.floor(rate)
    part = rate - out
    error = np.zeros(load.shape[1])
    for i in np.argsort(-load.sum(1), kind="stable"):
        if part[i]:
            down = error - part[i] * load[i]
            up = down + load[i]
            if (up * up).sum() < (down * down).sum():
                out[i] += 1
                error = up
            else:
                error = down
    return out.astype(np.int64)


def mix(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS, max_rate: float = MAX_RATE) -> DataFrame:
    """``keep`` columns, ``tokens``, ``p``, ``rate`` and ``copies`` for every row of ``docs``; other columns are ignored.

    ``copies`` is how often the row enters the mix: its rate rounded up or down so that each domain's expected tokens
    stay (``round_rates``), in blocks of rows by a hash. A null or empty text has no tokens and keeps a rate by its
    posterior; texts of any length count whole. Rows that repeat an id are rounded each; a row with a null id has one copy. An empty table gives
    an empty result.
    """
    model = fit_domains(docs, labels, id_col, text_col)
    own = docs.select(*keep, F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    table = materialize(posteriors(own, model, [*keep, "__id"], "__text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit_rates(table, targets, max_rate=max_rate))
    blocks = max(1, round(table.count() / BLOCK))
    names = [*keep, "tokens", "p"]

    def place(rows: pa.Table) -> pa.Table:
        p = np.asarray(rows["p"].combine_chunks().flatten(), np.float64).reshape(len(rows), len(targets))
        order = np.lexsort((rows["__hash"].to_numpy(),))
        rows, p = rows.take(pa.array(order)), p[order]
        rate = _rates(p, shared.value, max_rate)
        fixed = np.asarray(rows["__id"].is_null())
        load = p * rows["tokens"].to_numpy()[:, None]
        copies = np.where(fixed, 1, round_rates(np.where(fixed, 1.0, rate), load))
        return rows.select(names).append_column("rate", pa.array(rate)).append_column("copies", pa.array(copies, pa.int32()))

    types = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in names)
    dealt = table.withColumn("__hash", F.xxhash64("__id", "tokens", "p")).withColumn("__block", F.pmod("__hash", F.lit(blocks)))
    return dealt.groupBy("__block").applyInArrow(place, f"{types}, rate double, copies int")


def mixed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS, max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say, with the columns of ``docs`` alone.

    Copies are looked up by id; rows with a null id count once.
    """
    found = mix(docs, labels, [id_col], id_col, text_col, targets, max_rate)
    other = found.groupBy(id_col).agg(F.max("copies").alias("__copies")).where("__copies <> 1").withColumnRenamed(id_col, "__id")
    joined = docs.join(materialize(other), F.col(id_col) == F.col("__id"), "left").withColumn("__copies", F.coalesce("__copies", F.lit(1)))
    return joined.withColumn("__copy", F.explode(F.expr("if(__copies > 0, sequence(1, __copies), array())"))).select(*(F.col(f"`{c}`") for c in docs.columns))
