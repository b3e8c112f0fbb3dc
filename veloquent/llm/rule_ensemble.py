"""Quality classifier: a sparse ensemble of tree rules over text statistics, compiled to Spark expressions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .text_stats import with_base_stats

FEATURES = ["f_words", "f_word_len", "f_symbols", "f_upper", "f_digits", "f_marks", "f_commas", "f_lines", "f_dup_lines", "f_repeats", "f_distinct", "f_short", "f_other"]
#: Labelled rows that the fit uses at most: those with the smallest hashes of their ids.
MAX_TRAIN = 20_000
TREES, DEPTH, LASSO = 24, 3, 0.002
#: Scores from here on predict label 1.
THRESHOLD = 0.7


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the statistics that rules may test. Nothing but the text enters them; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    share = lambda pattern: F.least((F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / chars, F.lit(1.0))
    return with_base_stats(docs, text_col).withColumns(
        {
            "f_words": F.log1p(F.col("n_words").cast("double")),
            "f_word_len": F.col("word_chars") / n,
            "f_symbols": F.col("n_symbols") / chars,
            "f_upper": share(r"\p{Lu}+"),
            "f_digits": share(r"[0-9]+"),
            "f_marks": share(r"[!?]+"),
            "f_commas": share(r"[,.;:]+"),
            "f_lines": F.size(F.split(text, "\n")) / n,
            "f_dup_lines": F.col("n_dup_lines") / n,
            "f_repeats": F.col("n_repeat_words") / n,
            "f_distinct": F.size(F.array_distinct("__words")) / F.greatest(F.pow(F.col("n_words").cast("double"), F.lit(0.8)), F.lit(1.0)),
            "f_short": F.size(F.filter("__words", lambda w: F.length(w) <= 2)) / n,
            "f_other": share(r"[^\p{L}\p{N}\s!?,.;:#*$%&|<>'-]+"),
        }
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests ``(feature, at_most, bound)``: value <= bound if ``at_most``, else value > bound."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        hit = F.lit(True)
        for name, at_most, bound in self.tests:
            hit = hit & ((F.col(name) <= bound) if at_most else (F.col(name) > bound))
        return hit.cast("double")


@dataclass(frozen=True)
class RuleModel:
    """Intercept, weighted rules and weighted linear terms ``(feature, low, high, weight)`` of clipped statistics."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[str, float, float, float]] = field(default_factory=list)

    def score(self) -> Column:
        """Probability of label 1 as one built-in expression over the feature columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + rule.column() * weight
        for name, low, high, weight in self.linear:
            total = total + F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high)) * weight
        return 1 / (1 + F.exp(-total))


def tree_rules(described: str, names: list[str]) -> list[Rule]:
    """The conjunctions of every node but the roots, from a tree ensemble's debug string."""
    found: dict[Rule, None] = {}
    path: list[tuple[str, bool, float]] = []
    for line in described.splitlines():
        if re.match(r"\s*Tree ", line):
            path = []
            continue
        test = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.Ee]+)\)", line)
        if test:
            depth = (len(test[1]) - 4) // 1
            path = [p for p in path if p[3] < depth] + [(names[int(test[2])], test[3] == "<=", float(test[4]), depth)]
            found[Rule(tuple(sorted(p[:3] for p in path)))] = None
    return list(found)


def fit_rules(labelled: DataFrame, label_col: str = "label", trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """Fit on rows with the feature columns and a 0/1 label.

    A random forest proposes conjunctions, a logistic regression with an L1 penalty over their
    indicators and the clipped statistics keeps a few. One class, or no row, gives its share as a constant.
    """
    rows = materialize(labelled.select(*FEATURES, F.col(label_col).cast("double").alias("label")).where("label is not null"))
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
    if not count["n"] or count["ones"] in (0.0, float(count["n"])):
        share = ((count["ones"] or 0.0) + 1) / (count["n"] + 2)
        return RuleModel(math.log(share / (1 - share)))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=10, featureSubsetStrategy="onethird", seed=7)
    rules = tree_rules(forest.fit(vectors).toDebugString, FEATURES)
    bounds = rows.agg(*(F.percentile_approx(x, F.array(F.lit(0.025), F.lit(0.975)), 1000).alias(x) for x in FEATURES)).first()
    clip = [F.least(F.greatest(F.col(x), F.lit(bounds[x][0])), F.lit(bounds[x][1])).alias(f"l_{x}") for x in FEATURES]
    terms = rows.select("label", *(r.column().alias(f"r{i}") for i, r in enumerate(rules)), *clip)
    wide = VectorAssembler(inputCols=[c for c in terms.columns if c != "label"], outputCol="x").transform(terms).select("label", "x")
    lasso_fit = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=80, standardization=True).fit(materialize(wide))
    weights = lasso_fit.coefficients.toArray()
    chosen = [(r, float(w)) for r, w in zip(rules, weights) if w]
    lines = [(x, *map(float, bounds[x]), float(w)) for x, w in zip(FEATURES, weights[len(rules) :]) if w]
    return RuleModel(float(lasso_fit.intercept), chosen, lines)


def bucket(id_col: str, mod: int) -> Column:
    """CRC-32 of the id's text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> RuleModel:
    """Fit on the texts of at most ``max_train`` labelled documents.

    ``usable``, over the id column, says which labels may be learnt from. Labels that repeat an id
    count once, by their smallest value; rows that repeat it all count. The chosen ids are at most
    ``max_train``, so their broadcast is bounded.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known if usable is None else known.where(usable)
    chosen = known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(F.broadcast(materialize(chosen)), F.col("__doc") == F.col("__id"))
    return fit_rules(with_features(texts.select("text", "label")))


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``, in one pass without a shuffle.

    A null text counts as empty, and an empty one has a score like any other. Texts of any length count whole; repeated rows and null ids are scored each; an empty
    table gives an empty result; other columns are ignored, also those named like a statistic.
    """
    rows = with_features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", *FEATURES)
    return rows.select("doc_id", model.score().alias("score"))


def filter_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with the columns of ``docs`` alone.

    Rows are judged one by one: repeated rows stay or go together, null and empty texts are scored like any other, an empty table stays empty.
    """
    own = docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)))
    text = f"__c{docs.columns.index(text_col)}"
    kept = with_features(own, text).where(model.score() >= threshold)
    return kept.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))
