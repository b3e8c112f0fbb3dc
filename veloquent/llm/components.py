"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


#: Nodes of at most this many edges are never split.
FLOOR = 100
#: Hubs are fewer than this: they hold more than this share of all edge ends each.
HUBS = 10_000
#: Edges, of two numbers each, up to which a round is one task's work: planned without exchanges, with the same result.
FEW = 100_000


def _meet(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """``(a, b, m)``: edges with the ``m`` that ``least`` (``u, m, n``) has for ``a``.

    Nodes of more than ``hub`` edges are fewer than ``HUBS`` and are broadcast, so that their edges stay where they are.
    """
    hubs = least.where(F.col("n") > hub).select(F.col("u").alias("h"), F.col("m").alias("hm"))
    marked = edges.join(F.broadcast(hubs), F.col("a") == F.col("h"), "left")
    rest = marked.where("h is null").select("a", "b").join(least.where(F.col("n") <= hub), F.col("a") == F.col("u"))
    return rest.select("a", "b", "m").unionByName(marked.where("h is not null").select("a", "b", F.col("hm").alias("m")))


def _stars(edges: DataFrame, count: int) -> DataFrame:
    """One large-star and one small-star step over ``count`` edges ``(a, b)`` with ``a > b``."""
    few = count <= FEW
    edges = edges.coalesce(1) if few else edges
    hub = max(FLOOR, 2 * count // HUBS)
    meet = (lambda e, least: e.join(least.hint("merge"), F.col("a") == F.col("u")).select("a", "b", "m")) if few else (lambda e, least: _meet(e, least, hub))
    some = [F.min("b").alias("m"), F.count(F.lit(1)).alias("n")]
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    low = both.groupBy("a").agg(*some).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "n")
    large = meet(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a > b").distinct()
    small = meet(large, large.groupBy("a").agg(*some).withColumnRenamed("a", "u"))
    ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
    return small.select(F.explode(ends).alias("e")).select("e.*").where("a > b").distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 100) -> DataFrame:
    """Smallest reachable node for every node that an edge touches.

    Returns ``(node, component)``. Self-loops, repeated edges and nulls are allowed; a null end makes
    no edge. Every round aggregates with map-side combine, joins on node ids, hubs apart, and
    writes its edges to the shared folder and drops the last round's; only a count and a checksum reach the driver.
    """
    pairs = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).where("x <> y")
    now = materialize(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = now.select(mark.alias("m")).first()["m"]
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        last, now = now, materialize(_stars(now, before[0]))
        discard(last)
        after = now.select(mark.alias("m")).first()["m"]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))
    return now.select(F.explode(ends).alias("e")).select("e.*").distinct()
