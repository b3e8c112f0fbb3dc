"""Label scans in pieces against plain loops over whole files."""

import random

import pytest

from veloquent.operators import carried as C
from veloquent.operators import scans as S


def plain_smooth(rows, rules):
    who, a, b, n, ends = (list(v) for v in zip(*rows))
    for i in range(1, len(who) - 1) if "island" in rules else ():
        if who[i - 1] == who[i + 1] != who[i] and (b[i] - a[i] <= 1500 or n[i] <= 4):
            who[i] = who[i - 1]
    for i in range(len(who) - 1) if "lead" in rules else ():
        if n[i] == 1 and b[i] - a[i] <= 800 and not ends[i] and n[i + 1] >= 2 and (i == 0 or a[i] - b[i - 1] >= 1200) and a[i + 1] - b[i] <= 2500:
            who[i] = who[i + 1]
    for i in range(1, len(who) - 1) if "trail" in rules else ():
        if n[i + 1] <= 2 and b[i + 1] - a[i + 1] <= 900 and ends[i + 1] and not ends[i] and a[i + 1] - b[i] <= 250 and who[i + 1] != who[i] == who[i - 1] and a[i] - b[i - 1] <= 1000:
            who[i + 1] = who[i]
    return who


def plain_boundary(rows, rules):
    who, a, b, inside = (list(v) for v in zip(*rows))
    moved = [False] * len(who)
    for i in range(1, len(who)) if "lead" in rules else ():
        if who[i] != who[i - 1] and a[i] - b[i - 1] < 300 and not inside[i]:
            who[i], moved[i] = who[i - 1], True
    for i in range(1, len(who) - 1) if "trail" in rules else ():
        if who[i] == who[i - 1] and who[i + 1] != who[i] and not inside[i] and not moved[i]:
            who[i] = who[i + 1]
    return who


def files(seed, make):
    """Files of one to ninety rows; in every other one a rule applies nearly everywhere, so that labels travel far."""
    rng = random.Random(seed)
    for f in range(14):
        at, rows = 0, []
        for p in range(rng.choice([1, 2, 3, 20, 90])):
            length = rng.choice([100, 400, 700, 2000])
            rows.append((f, p, rng.randrange(3), at, at + length, *make(rng, f % 2)))
            at += length + rng.choice([0, 50, 200, 1300]) * (rng.random() > 0.5 * (f % 2))
        yield f, rows


@pytest.mark.parametrize("rules,pieces", [(("island",), 9), (("lead",), 5), (("trail",), 9), (("island", "lead", "trail"), 40)])
def test_smoothing_in_pieces(spark, rules, pieces):
    made = dict(files(len(rules) + pieces, lambda rng, far: (rng.choice([1, 1, 2, 3] if far else [1, 2, 9]), rng.random() < (0.5 if far else 0.3))))
    table = spark.createDataFrame([r for rows in made.values() for r in rows], S.SEGMENTS)
    want = {(f, r[1]): s for f, rows in made.items() for r, s in zip(rows, plain_smooth([r[2:] for r in rows], rules))}
    rule = [S.SMOOTHING[r] for r in rules]
    assert {(r.file_id, r.pos): r.speaker for r in C.scan_pieces(table, rule, pieces).collect()} == want
    assert {(r.file_id, r.pos): r.speaker for r in S.smooth_speakers(table, rules, size=20).collect()} == want
    assert {(r.file_id, r.pos): r.speaker for r in S.smooth_speakers(table, rules).collect()} == want


@pytest.mark.parametrize("rules,size", [(("lead",), 7), (("trail",), 3), (("lead", "trail"), 1)])
def test_boundary_words_in_pieces(spark, rules, size):
    made = dict(files(size, lambda rng, far: (rng.random() < (0.05 if far else 0.5),)))
    table = spark.createDataFrame([r for rows in made.values() for r in rows], S.WORDS)
    want = {(f, r[1]): s for f, rows in made.items() for r, s in zip(rows, plain_boundary([r[2:] for r in rows], rules))}
    for limit in (size, 1000):
        assert {(r.file_id, r.pos): r.speaker for r in S.move_boundary_words(table, rules=rules, size=limit).collect()} == want


def test_a_label_travels_through_pieces_that_do_not_know_it(spark):
    """One speaker's first row, then words of others that all follow: speaker 7 occurs in no later piece."""
    rows = [(1, i, 7 if i == 0 else 1 + i % 2, 100 * i, 100 * i + 90, False) for i in range(60)]
    table = spark.createDataFrame(rows, S.WORDS)
    assert {r.speaker for r in S.move_boundary_words(table, rules=("lead",), size=4).collect()} == {7}
    assert S.move_boundary_words(table.limit(0), size=4).count() == 0
