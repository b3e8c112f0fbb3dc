"""Beam search over score tables by built-in expressions: extend, keep the best, merge equal histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The token that extends no history, and the symbols that every history begins with, which count for its length.
BLANK, CONTEXT = 0, 2
_HYPOTHESIS = "array<struct<cost:double,tokens:array<bigint>,at:array<bigint>>>"


def _log_add(a: Column, b: Column) -> Column:
    """Cost of either of two events of the given costs, which are negative log probabilities."""
    return F.least(a, b) - F.log1p(F.exp(-F.abs(a - b)))


def _extended(found: Column, frame: Column, width: int) -> Column:
    """The best ``width`` extensions of all hypotheses by the tokens of a frame; those with equal histories become one."""
    pairs = F.flatten(F.transform(found, lambda h, i: F.transform(frame["tokens"], lambda t: F.struct((h["cost"] + t["cost"]).alias("cost"), i.alias("i"), t["token"].alias("token")))))

    def grown(c: Column) -> Column:
        h = F.get(found, c["i"])
        more = lambda name, value: F.when(c["token"] == BLANK, h[name]).otherwise(F.concat(h[name], F.array(value)))
        return F.struct(c["cost"].alias("cost"), more("tokens", c["token"]).alias("tokens"), more("at", frame["frame"]).alias("at"))

    def merged(kept: Column, h: Column) -> Column:
        same = lambda k: k["tokens"] == h["tokens"]
        added = lambda k: F.struct(_log_add(k["cost"], h["cost"]).alias("cost"), k["tokens"].alias("tokens"), k["at"].alias("at"))
        return F.when(F.exists(kept, same), F.transform(kept, lambda k: F.when(same(k), added(k)).otherwise(k))).otherwise(F.concat(kept, F.array(h)))

    best = F.transform(F.slice(F.array_sort(pairs), 1, width), grown)
    return F.aggregate(best, F.array().cast(_HYPOTHESIS), merged)


def beam_search(scores: DataFrame, key: str, width: int = 8) -> DataFrame:
    """``(key, tokens, at, cost)``: each utterance's best history with the frames of its tokens, by the cost over its length.

    ``scores`` is ``(key, frame, token, cost)``, costs being negative log probabilities. Per frame every hypothesis takes every token; the best ``width`` pairs stay, ties to the earlier hypothesis, then to the
    smaller token; those with one history add their probabilities and keep the frames of the better one. All hypotheses meet the same costs, so only a frame's best ``width`` tokens are carried, which loses nothing:
    a step compares at most the square of ``width`` pairs, and an utterance is one row of its frames. Rows without token or cost are left out; an utterance without rows gives none.
    """
    told = scores.where("token is not null and cost is not null and not isnan(cost)")
    entry = F.struct(F.col("cost").cast("double").alias("cost"), F.col("token").cast("bigint").alias("token"))
    frames = told.groupBy(key, F.col("frame").cast("bigint").alias("frame")).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, width).alias("tokens"))
    lines = frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("frame", "tokens"))).alias("frames"))
    none = F.array().cast("array<bigint>")
    start = F.array(F.struct(F.lit(0.0).alias("cost"), none.alias("tokens"), none.alias("at")))
    done = lines.select(key, F.aggregate("frames", start.cast(_HYPOTHESIS), lambda found, frame: _extended(found, frame, width)).alias("found"))
    ranked = F.transform("found", lambda h, i: F.struct((h["cost"] / (CONTEXT + F.size(h["tokens"]))).alias("mean"), i.alias("i")))
    best = done.select(key, F.get("found", F.array_min(ranked)["i"]).alias("best"))
    return best.select(key, "best.tokens", "best.at", "best.cost")
