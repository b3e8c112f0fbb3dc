"""Words' best segments by sorted arrays equal a plain loop over pairs."""

import random

import numpy as np

from veloquent.operators.nearest import best_segments, last_reaching


def test_last_value_that_reaches():
    r = random.Random(1)
    for n in (1, 2, 3, 8, 13):
        values = np.array([r.randrange(6) for _ in range(n)])
        asked = [(i, v) for i in range(n + 1) for v in range(8)]
        before, least = (np.array(x) for x in zip(*asked))
        assert list(last_reaching(values, before, least)) == [max((j for j in range(i) if values[j] >= v), default=-1) for i, v in asked]


def test_best_segments_equal_a_loop():
    for seed in range(1500):
        r = random.Random(seed)
        n, end, longest = r.randrange(14), r.choice([8, 20, 60, 200]), r.choice([3, 10, 60])
        s = np.array([r.randrange(end) for _ in range(n)], np.int64)
        e, pos = s + np.array([1 + r.randrange(longest) for _ in range(n)], np.int64), np.array(r.sample(range(50), n), np.int64)
        a = np.array([r.randrange(end) for _ in range(5)])
        b = a + np.array([1 + r.randrange(12) for _ in range(5)])
        for x, y, got in zip(a, b, best_segments(a, b, s, e, pos)):
            met = [(max(x, s[i]) - min(y, e[i]), abs(s[i] + e[i] - x - y), s[i], pos[i], i) for i in range(n) if s[i] < y and x < e[i]]
            assert got == (min(met)[-1] if met else -1)
