"""Alignment and clustering against plain definitions."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veloquent.operators import alignment as A
from veloquent.operators import clustering as C

TOKENS = st.lists(st.sampled_from("abc"), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.lists(st.sampled_from("abc"), min_size=1, max_size=4).map(tuple), st.sampled_from([0.5, 1.0, 2.0]), min_size=1, max_size=5), TOKENS)
def test_phrase_scores(phrases, tokens):
    gain = lambda p: max(s for q, s in phrases.items() if q[: len(p)] == p)
    paid = lambda p: sum(gain(p[: k + 1]) for k in range(len(p)))
    begins = lambda p: any(q[: len(p)] == p for q in phrases)
    total, state = 0.0, ()
    for t in tokens:
        before = paid(state)
        state = next(state[k:] + (t,) for k in range(len(state) + 2) if not state[k:] + (t,) or k > len(state) or begins(state[k:] + (t,))) if begins((t,)) or state else ()
        while state and not begins(state):
            state = state[1:]
        done = next((state[k:] for k in range(len(state)) if state[k:] in phrases), None)
        total += paid(done if done else state) - before
        if done:
            state = ()
    assert abs(A.Trie(phrases).score(tokens) - (total - paid(state))) < 1e-9


def test_output_links_pay():
    phrases = {("the", "of", "the"): 1.0, ("of",): 0.5}
    assert A.Trie(phrases).score("the of x".split()) == 0.5


def overlap(tail, head):
    """The rule as a table of all shifts."""
    a, b = tail[-100:], head[:100]
    best = (0, 0, 0)
    for shift in range(1 - len(a), len(b)):
        span = [(i, i + shift) for i in range(len(a)) if 0 <= i + shift < len(b)]
        hits = [(i, j) for i, j in span if A.alike(a[i][0], b[j][0])]
        if len(hits) > best[0] and len(hits) / len(span) >= 0.5:
            best = (len(hits), len(a) - 1 - hits[-1][0], hits[-1][1] + 1)
    if not tail or not head:
        return 0, 0, 0
    n, pop, cut = best
    if n == 0 or n < min(len(a), len(b)) and pop:
        old, new = (tail, head) if not n else (tail[-pop:], head[cut:])
        mean = lambda x: sum(p for _, p in x) / max(len(x), 1)
        return (n, 0, len(head)) if mean(old) > mean(new) else (n, len(tail), 0)
    return best


WORDS = st.lists(st.tuples(st.sampled_from(["aa", "bb", "abba", "longword", "longwort", ""]), st.sampled_from([0.1, 0.5, 0.9])), max_size=8)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_overlap(tail, head):
    assert A.best_overlap(tail, head) == overlap(tail, head)


def test_overlap_reaches_a_hundred_words():
    words = [(f"word{i}x{i * 7919}", 0.5) for i in range(150)]
    assert A.best_overlap(words, words[70:]) == (80, 0, 80)
    assert A.best_overlap(words[:5], [("other", 0.9)]) == (0, 5, 0) and A.best_overlap([("a", 0.9)], [("zz", 0.1)]) == (0, 0, 1)


def test_vote():
    w = lambda text, at, conf: {"text": text, "start_ms": at, "conf": conf}
    a, b = [w("ban", 0, 0.9), w("so", 300, 0.6), w("xong", 600, 0.9)], [w("ban", 0, 0.9), w("to", 300, 0.4), w("xong", 600, 0.9)]
    assert A.vote(a, b) == [("ban", False), ("so", True), ("xong", False)]
    assert A.vote(a, b, ("ban to",))[1] == ("to", True)  # the bonus of the side that completes a hot phrase
    assert A.vote(a, b, ("ban",))[1] == ("so", True)
    more = [*a, w("them", 900, 0.21), w("it", 1200, 0.2)]
    assert [t for t, _ in A.vote(a, more)] == ["ban", "so", "xong", "them"]
    twice = [w("ban", 0, 0.9), w("xong", 590, 0.9), *b[1:]]
    assert [t for t, _ in A.vote([a[0], a[2]], [b[0], w("Xong", 500, 0.5), b[2]])] == ["ban", "xong"] and len(A.vote(a, twice)) >= 3
    assert A.vote([], b) == [(x["text"], False) for x in b]


def test_hot_share():
    assert A.hot_share(["to", "chuc", "ky"], ("ban to chuc",), ["ban"], []) == 2 / 3
    assert A.hot_share(["a", "b"], ("b c",), [], ["c"]) == 0.5 and A.hot_share([], ("a",)) == 0.0 and A.hot_share(["x"], ()) == 0.0


def test_sentences():
    words = "uh hello big world how are they all".split()
    assert A.place_sentences(words, ["Hello world.", "", "How are they?", "Gone"]) == [(0, 1, 4, True), (2, 4, 7, True), (3, 7, 8, False)]
    assert A.place_sentences(words, ["xxx yyy"]) == [(0, 0, 2, False)] and A.place_sentences([], ["a"]) == []
    far = ["pad"] * 60 + ["needle", "one", "two"]
    assert A.place_sentences(far, ["needle one two"]) == [(0, 60, 63, False)]  # behind the look-ahead: by its first word alone


def test_linkage_against_plain_merging():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40, 90):
        x = C._units(rng.standard_normal((n, 4)))
        groups = [[i] for i in range(n)]
        while len(groups) > 1:
            c = np.array([x[g].mean(0) for g in groups])
            d = ((c[:, None] - c[None]) ** 2).sum(2) + np.diag(np.full(len(c), np.inf))
            i, j = sorted(np.unravel_index(d.argmin(), d.shape))
            if d[i, j] >= 0.36:
                break
            groups[i] += groups.pop(j)
        got = C.agglomerate(x)
        assert sorted(sorted(g) for g in groups) == sorted(sorted(np.flatnonzero(got == k).tolist()) for k in np.unique(got))


def test_more_than_eight_speakers():
    rng = np.random.default_rng(2)
    for k in (3, 12):
        centres = np.linalg.qr(rng.standard_normal((16, 16)))[0][:k]
        x = C._units(np.repeat(centres, 12, 0) + 0.02 * rng.standard_normal((12 * k, 16)))
        truth = np.repeat(np.arange(k), 12)
        for labels in (C.spectral(x), C.METHODS["merge"](x)):
            assert len(set(zip(truth, labels))) == k == len(set(labels))


def test_random_folds_keep_unique_words():
    rng = random.Random(3)
    words = [(f"w{i}q{rng.random()}", 0.5) for i in range(60)]
    assert A.best_overlap(words[20:40], words[30:50]) == (10, 0, 10)
