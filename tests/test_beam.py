"""Beam search against a plain loop and against all alignments."""

import itertools
import math
import random

import pytest

from veloquent.operators.beam import beam_search

SCHEMA = "utt bigint, frame bigint, token bigint, cost double"


def plain_beam(frames, width):
    found = [(0.0, (), ())]
    for at, tokens in frames:
        pairs = sorted((h[0] + c, i, t) for i, h in enumerate(found) for t, c in tokens.items())[:width]
        new = {}
        for cost, i, t in pairs:
            history, when = (found[i][1], found[i][2]) if t == 0 else ((*found[i][1], t), (*found[i][2], at))
            if history in new:
                a = new[history][0]
                new[history] = (min(a, cost) - math.log1p(math.exp(-abs(a - cost))), new[history][1])
            else:
                new[history] = (cost, when)
        found = [(c, h, w) for h, (c, w) in new.items()]
    return min(found, key=lambda h: h[0] / (2 + len(h[1])))


def random_frames(rng, length, tokens):
    return [(3 * k, {t: rng.uniform(0.05, 3) for t in range(tokens)}) for k in range(length)]


def searched(spark, utterances, width):
    rows = [(u, at, t, c) for u, frames in utterances.items() for at, tokens in frames for t, c in tokens.items()]
    random.Random(0).shuffle(rows)
    odd = [(0, 1, None, 0.1), (0, 0, 1, None), (0, 0, 2, float("nan")), (77, 0, None, None)]
    return {r.utt: r for r in beam_search(spark.createDataFrame(rows + odd, SCHEMA).repartition(3), "utt", width).collect()}


@pytest.mark.parametrize("width", [1, 3, 8])
def test_equals_a_plain_loop(spark, width):
    rng = random.Random(width)
    utterances = {u: random_frames(rng, rng.choice([1, 2, 9, 25]), 5) for u in range(30)}
    got = searched(spark, utterances, width)
    assert set(got) == set(utterances)
    for u, frames in utterances.items():
        cost, tokens, at = plain_beam(frames, width)
        assert (tuple(got[u].tokens), tuple(got[u].at)) == (tokens, at) and abs(got[u].cost - cost) < 1e-9


def test_wide_beams_sum_over_all_alignments(spark):
    rng = random.Random(9)
    utterances = {u: random_frames(rng, 4, 3) for u in range(8)}
    for u, r in searched(spark, utterances, 200).items():
        total = {}
        for path in itertools.product(range(3), repeat=4):
            history = tuple(t for t in path if t)
            total[history] = total.get(history, 0) + math.exp(-sum(f[1][t] for f, t in zip(utterances[u], path)))
        want = min(total, key=lambda h: -math.log(total[h]) / (2 + len(h)))
        assert tuple(r.tokens) == want and abs(r.cost + math.log(total[want])) < 1e-9


def test_ties_and_nothing(spark):
    """Equal costs everywhere: the smaller token of the earlier hypothesis stays."""
    frames = [(k, dict.fromkeys(range(3), 1.0)) for k in range(3)]
    got = searched(spark, {5: frames}, 2)[5]
    assert (tuple(got.tokens), tuple(got.at)) == plain_beam(frames, 2)[1:]
    assert beam_search(spark.createDataFrame([], SCHEMA), "utt").count() == 0
