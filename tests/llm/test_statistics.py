"""Quality rules, rule ensemble and mixing against plain Python and on planted cases."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veloquent.llm import quality_rules as Q
from veloquent.llm.mixing import TARGETS, _rates, fit_rates, mix, mixed, round_rates
from veloquent.llm.rule_ensemble import FEATURES, Rule, RuleModel, bucket, filter_quality, fit_quality, fit_rules, score_quality, tree_rules
from veloquent.llm.text_stats import with_base_stats

SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string"


def stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))


RNG = random.Random(1)
P = prose(RNG, 12)
TEXTS = [None, "", " \t\n\x0b", "one", "a\nb\na\n\n \n", "x " * 100, P + "\n" + P, P + " " + prose(RNG, 30) + " " + P, "é ü z # $%| <a>&*", prose(RNG, 7), prose(RNG, 8), ("a b c d e f g h i " * 3), P + " " + P[:20] + "\n" + P, "w" * 3000 + " " + prose(RNG, 3000)]


def test_base_statistics(spark):
    got = with_base_stats(spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")).collect()
    for r in got:
        assert tuple(r[c] for c in Q.BASE) == stats(r["text"]), r["text"]


def corpus(n=600):
    rng = random.Random(2)
    rows = [(i, prose(rng, int(math.exp(rng.gauss(5, 0.5)))), ("en", "de", None)[i % 3], "hot" if i % 3 else "s", "x") for i in range(n)]
    for k in range(12):
        i = 10 + 37 * k
        rows[i] = (i, " ".join(w + "###$$$" for w in prose(rng, 200).split()), *rows[i][2:])
    return rows, {10 + 37 * k for k in range(12)}


def test_verdicts_on_planted_junk(spark):
    rows, junk = corpus()
    rows += [(None, None, None, None, None), (1, rows[1][1], "en", "hot", "x")]
    got = Q.quality_stats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    lost = {r["doc_id"] for r in got if not r["kept"] and not r["base_failed"]}
    assert lost == junk
    kept = Q.apply_quality_rules(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_words"]
    assert kept.count() == len(rows) - len(junk) - 1


def test_estimates_against_numpy(spark):
    rng = np.random.default_rng(3)
    clean = rng.multivariate_normal([5, 1.8, 0.1, 0.05, 0.1], np.diag([0.5, 0.1, 0.05, 0.05, 0.1]) ** 2, 500)
    x = np.concatenate([clean, clean[:100] + [0, 0, 5, 0, 0]])
    table = spark.createDataFrame([("g", "l", *map(float, v)) for v in x], "grp string, lang string, " + ", ".join(f"{f} double" for f in Q.FEATURES))
    fit = Q.mcd_estimates(table).first()
    floor = np.diag(np.square(Q.FLOORS))
    mean, cov = np.median(x, 0), np.diag(((np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) / 1.349) ** 2)
    for _ in range(10):
        d = x - mean
        d2 = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov + floor), d)
        best = x[np.argsort(d2)[: int(0.75 * len(x))]]
        mean, cov = best.mean(0), np.cov(best.T, bias=True)
    assert np.allclose([fit[f"m{i}"] for i in range(5)], mean, atol=0.03)
    low = np.array([[fit[f"l{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    assert np.allclose(low @ low.T, cov + floor, atol=0.02)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert Q.quality_stats(empty).count() == 0 and Q.apply_quality_rules(empty).count() == 0
    model = fit_quality(empty, labels)
    assert score_quality(empty, model).count() == 0 and filter_quality(empty, model).count() == 0
    assert mix(empty, labels, ["doc_id"]).count() == 0 and mixed(empty, labels).count() == 0


def test_each_group_has_its_own_estimate_whatever_its_size(spark):
    rng = np.random.default_rng(5)
    rows = []
    for grp, n, length in (("big", 400, 6.0), ("odd", 200, 3.0), ("tiny", 3, 6.0)):
        rows += [(grp, "l", float(length + 0.3 * rng.standard_normal()), *(float(m + 0.05 * rng.standard_normal()) for m in (1.8, 0.1, 0.05, 0.1))) for _ in range(n)]
    rows.append(("tiny", "l", 6.0, 1.8, 5.0, 0.05, 0.1))
    fit = {r["grp"]: r for r in Q.mcd_estimates(spark.createDataFrame(rows, "grp string, lang string, " + ", ".join(f"{f} double" for f in Q.FEATURES))).collect()}
    assert fit["big"]["m0"] > 5.4 and fit["odd"]["m0"] < 4.0  # a group far from the others is not measured by them
    assert fit["tiny"]["m2"] < 0.5  # one odd row of four moves nothing
    assert set(fit) == {"big", "odd", "tiny"}


def test_many_groups_meet_their_estimates_by_salt(spark, monkeypatch):
    docs = spark.createDataFrame(corpus()[0], SCHEMA)
    near = {r["doc_id"]: (r["kept"], round(r["d2"], 6)) for r in Q.quality_stats(docs).collect()}
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(Q, "FEW_GROUPS", 0)
    far = {r["doc_id"]: (r["kept"], round(r["d2"], 6)) for r in Q.quality_stats(docs).collect()}
    assert near == far


def test_native_plan(spark):
    plan = Q.quality_stats(spark.createDataFrame(corpus()[0], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def labelled():
    rows, junk = corpus()
    labels = [(r[0], int(r[0] not in junk), 0) for r in rows if r[0] % 2 or r[0] in junk]
    return rows, junk, [*labels, (3, 1, 0), (None, 0, 0), (5, None, None)]


def test_rule_ensemble(spark):
    rows, junk, labels = labelled()
    rows += [(None, None, None, None, None), (7001, "", "en", "s", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = fit_quality(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert model.rules or model.linear
    got = {r["doc_id"]: r["score"] for r in score_quality(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert max(got[i] for i in junk) < 0.5 < min(s for i, s in got.items() if i not in junk and i is not None and i < 600)
    kept = filter_quality(docs, model)
    assert kept.columns == docs.columns and not junk & {r["doc_id"] for r in kept.collect()}


def test_scores_ignore_labels_lang_source_and_held_out_rows(spark):
    rows, junk, labels = labelled()
    docs = spark.createDataFrame(rows, SCHEMA)
    frame = lambda x: spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")
    usable = bucket("doc_id", 4) != 2
    flipped = [(i, 1 - q if i is not None and q is not None and zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    assert fit_quality(docs, frame(labels), usable) == fit_quality(docs, frame(flipped), usable)


def test_one_class_and_tree_paths(spark):
    one = spark.createDataFrame([(*[0.5] * len(FEATURES), 1)] * 8, ", ".join(f"{f} double" for f in FEATURES) + ", label int")
    assert fit_rules(one) == RuleModel(math.log(9))
    text = "RandomForest\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 1.5)\n     If (feature 1 <= 2.0)\n      Predict: 0.0\n     Else (feature 1 > 2.0)\n      Predict: 1.0\n    Else (feature 0 > 1.5)\n     Predict: 1.0\n"
    assert set(tree_rules(text, ["a", "b"])) == {Rule((("a", True, 1.5),)), Rule((("a", True, 1.5), ("b", True, 2.0))), Rule((("a", True, 1.5), ("b", False, 2.0))), Rule((("a", False, 1.5),))}
    row = spark.createDataFrame([(1.0, 3.0)], "a double, b double")
    model = RuleModel(0.25, [(Rule((("a", True, 1.5), ("b", False, 2.0))), 2.0)], [("b", 0.0, 2.0, -1.0)])
    assert math.isclose(row.select(model.score()).first()[0], 1 / (1 + math.exp(-(0.25 + 2.0 - 2.0))))


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([np.tile([0.97, 0.02, 0.01], (800, 1)), np.tile([0.1, 0.88, 0.02], (200, 1))])
    tokens = rng.integers(50, 500, len(p))
    table = spark.createDataFrame([(int(t), [float(v) for v in q]) for t, q in zip(tokens, p)], "tokens bigint, p array<double>")
    rate = _rates(p, fit_rates(table, {"clean": 0.9, "toxic": 0.1, "low": 0.0}), 4.0)
    total = (tokens * rate) @ p
    assert (rate >= 0).all()
    assert abs(total[1] / total[0] - 1 / 9) < 0.02 and abs(total[0] - tokens @ p[:, 0]) < 0.02 * total[0]


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 80) + (" idiot scum" * 3 if i % 4 == 0 else ""), "en", "s", "x") for i in range(400)]
    rows += [(None, None, None, None, None), (1, rows[1][1], "en", "s", "x"), (900, "", "en", "s", "x")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix(docs, labels, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(r["rate"] >= 0 and abs(sum(r["p"]) - 1) < 1e-9 and len(r["p"]) == len(TARGETS) for r in got)
    clean = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 4]
    toxic = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 4 == 0]
    assert np.mean([r["copies"] == 1 for r in clean]) > 0.97
    whole = [r for r in got if r["doc_id"] is not None]
    for k in range(3):
        want = sum(r["tokens"] * r["rate"] * r["p"][k] for r in whole) + sum(r["tokens"] * r["p"][k] for r in got if r["doc_id"] is None)
        assert abs(sum(r["tokens"] * r["copies"] * r["p"][k] for r in got) - want) <= 100
    assert np.mean([r["copies"] for r in toxic]) < 0.5
    assert all(r["p"][2] == 0 for r in got)
    out = mixed(docs, labels)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} >= {r["doc_id"] for r in got if r["copies"] >= 1}


@pytest.mark.parametrize("n", [3, 500, 20_000])
def test_rounded_rates_keep_the_totals(n):
    rng = np.random.default_rng(n)
    p = rng.dirichlet([5, 1, 1], n)
    tokens = rng.integers(1, 3000, n)
    rate = rng.random(n) * 2
    load = p * tokens[:, None]
    copies = round_rates(rate, load)
    assert (np.abs(copies - rate) < 1).all()
    assert np.abs(load.T @ (copies - rate)).max() <= (3000 if n == 3 else 100)


def test_goals_out_of_reach_are_told(spark):
    table = spark.createDataFrame([(100, [1.0, 0.0, 0.0])] * 50 + [(1, [0.0, 1.0, 0.0])], "tokens bigint, p array<double>")
    with pytest.warns(UserWarning, match="miss the goals"):
        fit_rates(table)


def test_mixing_of_long_text_and_clashing_columns(spark):
    rows = [(i, "word " * (50_000 if i == 7 else 20), 1, 2.0, 3.0, 4) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tokens int, p double, rate double, copies int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["tokens"] for r in mix(docs, labels, ["doc_id"]).collect()}
    assert got[7] == 50_000 and len(got) == 30
    assert mixed(docs, labels).columns == docs.columns


def test_bucket(spark):
    got = spark.range(50).select("id", bucket("id", 4).alias("b")).collect()
    assert all(r["b"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in got)
    assert spark.range(1).select(F.lit(None).cast("bigint").alias("x")).select(bucket("x", 4)).first()[0] == 0
