"""Speakers by centroid linkage, then variational Bayes in the space of a two-covariance model.

The model says that a vector is its speaker's point plus noise. Both covariances are fitted by Spark from labelled
vectors: tasks add up sums and products, and what reaches the driver has the square of the dimension, whatever the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import LABELS, _relabel, agglomerate, k_means

# Weights of the acoustic and of the prior term, linkage cut, steps, least gain and least share of a speaker.
FA, FB, CUT, ROUNDS, GAIN, SHARE = 0.07, 0.8, 0.6, 20, 1e-4, 1e-7
#: How sharply the first memberships follow the linkage, and the most dimensions kept.
SHARP, DIMENSIONS = 7.0, 128


def units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)


def sound(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds finite components alone."""
    return vectors.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True))))


@dataclass(frozen=True)
class Projection:
    """Where noise has unit covariance and speakers have the diagonal one of ``spread``, largest first."""

    mean: np.ndarray
    centre: np.ndarray
    rows: np.ndarray
    spread: np.ndarray

    def spherical(self, x: np.ndarray) -> np.ndarray:
        return units(units(x) - self.mean) * np.sqrt(x.shape[1])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.spherical(x) - self.centre) @ self.rows.T


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column])


def _added(rows: DataFrame, measure) -> np.ndarray:
    """The sum over all batches of ``measure``, an array of fixed length: one array a task, added by place before the shuffle."""

    def task(batches):
        total = None
        for p in batches:
            if len(p):
                found = measure(p)
                total = found if total is None else total + found
        if total is not None:
            yield pd.DataFrame({"s": [total]})

    parts = rows.mapInPandas(task, "s array<double>").select(F.posexplode("s").alias("i", "v"))
    found = parts.groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
    return found.v.to_numpy()


def split_covariances(total: np.ndarray, between: np.ndarray, rows: float, labels: float, squares: float) -> tuple[np.ndarray, np.ndarray]:
    """Covariances within and between labels by moments.

    ``total`` adds up products of vectors, ``between`` those of the labels' sums over their sizes, both about the mean; ``squares`` adds up squared sizes.
    """
    within = (total - between) / max(rows - labels, 1)
    return within, (between - (labels - 1) * within) / max(rows - squares / rows, 1e-10)


def joint_axes(within: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that make ``within`` the unit matrix and ``between`` a diagonal, and that diagonal, largest first."""
    d = len(within)
    lower = np.linalg.cholesky(within + np.eye(d) * max(1e-8 * np.trace(within) / d, 1e-12))
    white = np.linalg.inv(lower)
    spread, turn = np.linalg.eigh(white @ between @ white.T)
    return turn[:, ::-1].T @ white, spread[::-1]


def fit_projection(vectors: DataFrame, dimensions: int = DIMENSIONS) -> Projection:
    """Fit the model to ``(label, vec)``: three passes of sums, one aggregation by label.

    Rows without label or sound vector are left out; all vectors have one length. Directions in which labels do not differ beyond the noise are dropped. Fewer than two labels, or none with two
    vectors, raise a ValueError, as they tell nothing of one of the covariances.
    """
    rows = sound(vectors.select("label", "vec")).where("label is not null")
    head = _added(rows, lambda p: np.append(units(_matrix(p.vec)).sum(0), len(p)))
    if not len(head):
        raise ValueError("no labelled vectors")
    n, mean = head[-1], head[:-1] / head[-1]
    d = len(mean)
    plain = Projection(mean, np.zeros(d), np.eye(d), np.ones(d))

    def by_label(batches):
        for p in batches:
            names, at = np.unique(p.label.to_numpy(), return_inverse=True)
            sums = np.zeros((len(names), d))
            np.add.at(sums, at, plain.spherical(_matrix(p.vec)))
            yield pd.DataFrame({"label": names, "n": np.bincount(at), "s": list(sums)})

    kind = rows.schema["label"].dataType.simpleString()
    parts = rows.mapInPandas(by_label, f"label {kind}, n bigint, s array<double>")
    sums = parts.groupBy("label").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(d))).alias("s"))

    def products(p: pd.DataFrame) -> np.ndarray:
        s, size = _matrix(p.s), p.n.to_numpy(float)
        return np.concatenate([((s / size[:, None]).T @ s).ravel(), s.sum(0), [len(p), (size**2).sum()]])

    def scatter(p: pd.DataFrame) -> np.ndarray:
        z = plain.spherical(_matrix(p.vec))
        return (z.T @ z).ravel()

    told = _added(sums, products)
    labels, squares = told[-2:]
    if labels < 2 or labels == n:
        raise ValueError(f"{n:.0f} vectors of {labels:.0f} labels do not tell both covariances")
    centre = told[d * d : -2] / n
    about = n * np.outer(centre, centre)
    within, between = split_covariances(_added(rows, scatter).reshape(d, d) - about, told[: d * d].reshape(d, d) - about, n, labels, squares)
    axes, spread = joint_axes(within, between)
    kept = np.flatnonzero(spread > 0)[:dimensions]
    return Projection(mean, centre, axes[kept], spread[kept])


def memberships(f: np.ndarray, spread: np.ndarray, labels: np.ndarray, fa: float = FA, fb: float = FB, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Each row's share in each speaker, the speakers' shares of all rows, and the bound after each step.

    A speaker's place has a normal posterior: its precision grows with the rows that it holds, and what it leaves uncertain counts against it. A step
    renews places, shares of rows and shares of speakers in turn, so the bound never falls; steps end once it gains less than ``gain``.
    """
    k = int(labels.max()) + 1
    held = np.where(np.arange(k) == labels[:, None], np.exp(SHARP), 1.0)
    held /= held.sum(1, keepdims=True)
    weight = np.full(k, 1 / k)
    noise = -0.5 * ((f * f).sum(1) + f.shape[1] * np.log(2 * np.pi))
    scaled, ratio, bounds = f * np.sqrt(spread), fa / fb, []
    for _ in range(rounds):
        variance = 1 / (1 + ratio * np.outer(held.sum(0), spread))
        place = ratio * variance * (held.T @ scaled)
        fit = fa * (scaled @ place.T - 0.5 * ((variance + place**2) @ spread) + noise[:, None])
        score = fit + np.log(np.maximum(weight, 1e-300))
        top = score.max(1, keepdims=True)
        evidence = top[:, 0] + np.log(np.exp(score - top).sum(1))
        held = np.exp(score - evidence[:, None])
        weight = held.mean(0)
        bounds.append(float(evidence.sum() + fb / 2 * (np.log(variance) - variance - place**2 + 1).sum()))
        if len(bounds) > 1 and bounds[-1] - bounds[-2] < gain:
            break
    return held, weight, bounds


def speakers(x: np.ndarray, projection: Projection, most: int | None = None) -> np.ndarray:
    """Labels of one file's vectors, numbered by first appearance: the nearest of the speakers' soft centroids by cosine.

    Speakers with a share of no more than ``SHARE`` vanish. If more than ``most`` stay, k-means of the unit vectors gives that many centroids instead.
    """
    if len(x) < 2:
        return np.zeros(len(x), int)
    unit = units(x)
    held, weight, _ = memberships(projection(x), projection.spread, _relabel(agglomerate(unit, CUT)))
    held = held[:, weight > SHARE]
    if most is not None and held.shape[1] > most:
        held = np.eye(most)[k_means(unit, most)]
    centroids = (held.T @ x) / (held.sum(0)[:, None] + 1e-8)
    return _relabel(np.round(unit @ units(centroids).T, 12).argmax(1))


def clusters(vectors: DataFrame, projection: Projection, most: int | None = None) -> DataFrame:
    """Cluster each file's ``(file_id, pos, vec)`` apart; rows without a sound vector get no label, an empty table gives an empty one.

    Files spread over the cluster. The linkage of one file holds a matrix of its distances in its task, which bounds a file to some thousand vectors.
    """

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        return pd.DataFrame({"file_id": p.file_id, "pos": p.pos, "cluster": speakers(_matrix(p.vec), projection, most)})

    return sound(vectors).select("file_id", "pos", "vec").groupBy("file_id").applyInPandas(one, LABELS)
