"""Assignment of speakers to clusters against enumeration."""

from itertools import product

import numpy as np
import pytest

from veloquent.operators.assignment import NONE, SILENT, UNASSIGNED, assign


def plain(rows):
    """The best picks over all combinations: ``rows`` holds each speaker's scores by cluster."""
    k = len(rows[0])
    every = [p for p in product([NONE, *range(k)], repeat=len(rows)) if all(p.count(c) == 1 for c in p if c != NONE)]
    return min(every, key=lambda p: (-sum(r[c] if c != NONE else UNASSIGNED for r, c in zip(rows, p)), p))


@pytest.mark.parametrize("sides, k", [(3, 1), (3, 2), (3, 15), (4, 6)])
def test_equals_enumeration(spark, sides, k):
    rng = np.random.default_rng(k)
    groups = [rng.integers(0, 6 if g % 2 else 2_000_000, (sides - (g % 5 == 0), k)) for g in range(12)]  # every second one full of ties
    for g, r in enumerate(groups):
        r[rng.random(len(r)) < 0.2] = SILENT
    table = [(g, s, c, int(v)) for g, r in enumerate(groups) for s, row in enumerate(r) for c, v in enumerate(row)]
    scores = spark.createDataFrame(table + [(99, 0, None, 5), (99, 1, 2, None)], "chunk bigint, side int, cluster bigint, score bigint")
    got = {(r.chunk, r.side): r.cluster for r in assign(scores, ["chunk"], sides).collect()}
    assert got == {(g, s): c for g, r in enumerate(groups) for s, c in enumerate(plain(r.tolist()))}


def test_empty(spark):
    assert assign(spark.createDataFrame([], "chunk bigint, side int, cluster bigint, score bigint"), ["chunk"], 3).count() == 0
