"""Robust multivariate outlier rules: minimum-covariance-determinant estimates per language and source.

Built-in Spark expressions only.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .membership import without_ids
from .scratch import discard, materialize
from .text_stats import with_base_stats

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Transformed statistics that the estimates see.
FEATURES = ["x_length", "x_word", "x_symbols", "x_lines", "x_repeats"]
#: Share of a group's rows in the minimum-determinant subset.
SUBSET = 0.75
#: Squared distance beyond which a document goes; a chi-square with five degrees passes 35 about once in a million.
CUTOFF = 35.0
#: Documents that a group's own estimate has to outweigh: the language counts as so many documents in a group's estimate,
#: and all documents as so many in a language's. So every group has its own estimate, whatever its size.
PRIOR = 50.0
#: Concentration steps at most, and the change of a log determinant below which all groups have settled.
STEPS, SETTLED = 30, 0.02
#: Smallest variance of each feature, so that constant features never make a singular matrix.
FLOORS = [0.3, 0.1, 0.05, 0.12, 0.3]
#: Width of the bins in which squared distances are ranked, as a share of the distance.
BIN = 0.02
#: Groups up to which their table of estimates, some 500 bytes a group, is broadcast; beyond, rows and estimates meet by group and salt.
BROADCAST_GROUPS, SALTS = 20_000, 64
#: Groups up to which tables of sums by group and bin, at most some thousand rows a group, are worked on in one partition, which needs no exchange.
FEW_GROUPS = 256
#: Median of a chi-square with five degrees of freedom.
MEDIAN = 4.351

PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
#: An estimate as one array: means, then the lower half of the covariance.
NUMBERS = len(FEATURES) + len(PAIRS)


def transformed(docs: DataFrame) -> DataFrame:
    """Add the transformed statistics: logs of counts, square roots of shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return docs.withColumns(
        {
            "x_length": F.log1p(n),
            "x_word": F.log1p(F.col("word_chars") / n),
            "x_symbols": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
            "x_lines": F.sqrt(F.col("n_dup_lines") / n),
            "x_repeats": F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0))),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _sums() -> Column:
    """Count, sums and sums of products of the features as one array: moments that add up over groups."""
    products = [f"sum({FEATURES[i]} * {FEATURES[j]})" for i, j in PAIRS]
    return F.expr(f"array(cast(count(1) as double), {', '.join([f'sum({x})' for x in FEATURES] + products)})").alias("s")


def _added() -> Column:
    """The arrays of several rows, added place by place."""
    return F.expr(f"array({', '.join(f'sum(s[{k}])' for k in range(NUMBERS + 1))})").alias("s")


def _estimate() -> Column:
    """Means and covariances from the sums, zeros without rows."""
    mean = lambda k: f"coalesce(try_divide(s[{k}], s[0]), 0D)"
    n = len(FEATURES)
    means, covs = [mean(1 + i) for i in range(n)], [f"{mean(1 + n + k)} - {mean(1 + i)} * {mean(1 + j)}" for k, (i, j) in enumerate(PAIRS)]
    return F.expr(f"array({', '.join(means + covs)})").alias("e")


def _gathered(sums: DataFrame, groups: int) -> DataFrame:
    """``sums`` in one partition if it is of few groups, so that what follows is planned without exchanges; the rows are the same."""
    return sums.coalesce(1) if groups <= FEW_GROUPS else sums


def _drawn(own: str, n: str, other: str) -> str:
    """``own``, an array from ``n`` documents, drawn to ``other``, which counts as ``PRIOR`` documents."""
    return f"zip_with({own}, {other}, (x, y) -> ({n} * x + {PRIOR}D * y) / ({n} + {PRIOR}D))"


def _shrunk(own: DataFrame) -> DataFrame:
    """``grp, lang, e``: estimates of a written table ``(grp, lang, n, e)`` drawn to those of ``lang``, and they to those of all.

    The rows of the other levels carry null keys: ``(null, lang, n, e)`` for a language, ``(null, null, n, e)`` for all.
    """
    lang = own.where("grp is null and lang is not null").select(F.col("lang").alias("__l"), F.col("n").alias("l_n"), F.col("e").alias("l_e")).hint("merge")
    everything = own.where("lang is null").select(F.col("e").alias("a_e"))
    both = own.where("grp is not null").join(lang, F.col("lang") == F.col("__l")).crossJoin(F.broadcast(everything))  # one row
    return both.selectExpr("grp", "lang", _drawn("e", "n", _drawn("l_e", "l_n", "a_e")) + " AS e")


def _factor(estimates: DataFrame) -> DataFrame:
    """``grp, lang, m{i}``, the lower Cholesky factor ``l{i}_{j}`` and the log determinant of each estimate, floors added."""
    n = len(FEATURES)
    out = estimates.selectExpr("grp", "lang", *(f"e[{k}] AS m{k}" for k in range(n)), *(f"e[{n + k}] + {FLOORS[i] ** 2 if i == j else 0}D AS c{i}_{j}" for k, (i, j) in enumerate(PAIRS)))
    for j in range(n):  # column by column: a column needs those before it
        out = out.selectExpr("*", f"sqrt(greatest(c{j}_{j}{''.join(f' - l{j}_{k} * l{j}_{k}' for k in range(j))}, {FLOORS[j] ** 2}D)) AS l{j}_{j}")
        if j + 1 < n:
            out = out.selectExpr("*", *(f"(c{i}_{j}{''.join(f' - l{i}_{k} * l{j}_{k}' for k in range(j))}) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, n)))
    det = " + ".join(f"2 * ln(l{i}_{i})" for i in range(n))
    return out.selectExpr("grp", "lang", *(f"m{i}" for i in range(n)), *(f"l{i}_{j}" for i, j in PAIRS), f"{det} AS logdet")


def _distance(rows: DataFrame) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance by forward substitution against the row's factor."""
    out = rows
    for i, x in enumerate(FEATURES):
        out = out.selectExpr("*", f"({x} - m{i}{''.join(f' - l{i}_{k} * z{k}' for k in range(i))}) / l{i}_{i} AS z{i}")
    return out.selectExpr("*", " + ".join(f"z{i} * z{i}" for i in range(len(FEATURES))) + " AS d2")


def _meet(rows: DataFrame, fit: DataFrame, groups: int) -> DataFrame:
    """Every row with its group's estimate: by broadcast while there are few groups, else by group and salt, so that no group fills a task."""
    fit = fit.drop("lang")
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(fit), "grp", "left")
    salted = fit.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)).cast("int")).join(salted, ["grp", "__salt"], "left").drop("__salt")


def _quantiles(counts: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """``keys, n, q``: the bins at which the running count of ``n`` reaches each share, per ``keys``; a few hundred bins a key."""
    run = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumns({"__u": F.sum("n").over(run), "__t": F.sum("n").over(Window.partitionBy(*keys))})
    cuts = [F.min(F.when(F.col("__u") >= F.ceil(F.col("__t") * q - 1e-9), F.col("bin"))).cast("double") for q in at]
    return upto.groupBy(*keys).agg(F.max("__t").cast("double").alias("n"), F.array(*cuts).alias("q"))


def _start(rows: DataFrame) -> tuple[DataFrame, int]:
    """Estimates to start from, and the number of groups: medians, and spreads from the middle half, off-diagonals zero, drawn together like all later ones.

    Quantiles come from fixed bins of a thousandth, so they are the same under any partitioning.
    """
    long = rows.select("grp", "lang", F.posexplode(F.array(*FEATURES)).alias("i", "x")).withColumn("bin", F.floor(F.col("x") / 0.001).cast("bigint"))
    own = materialize(long.groupBy("grp", "lang", "i", "bin").agg(F.count(F.lit(1)).alias("n")))
    groups = own.select("grp").distinct().count()
    own = _gathered(own, groups)
    none = F.lit(None).cast("string")
    lang = own.groupBy(none.alias("grp"), "lang", "i", "bin").agg(F.sum("n").alias("n"))
    everything = own.groupBy(none.alias("grp"), none.alias("lang"), "i", "bin").agg(F.sum("n").alias("n"))
    q = _quantiles(own.unionByName(lang).unionByName(everything), ["grp", "lang", "i"], [0.25, 0.5, 0.75])
    pick = lambda c, i: f"max(if(i = {i}, {c}, null))"
    spread = f"pow((q[2] - q[0]) * {0.001 / 1.349}D, 2D)"
    numbers = [*(pick("q[1] * 0.001D", i) for i in range(len(FEATURES))), *(pick(spread, i) if i == j else "0D" for i, j in PAIRS)]
    drawn = materialize(q.groupBy("grp", "lang").agg(F.max("n").alias("n"), F.expr(f"array({', '.join(numbers)})").alias("e")))
    return _shrunk(_gathered(drawn, groups)), groups


def _ranked(rows: DataFrame, fit: DataFrame, groups: int) -> DataFrame:
    """Sums of the rows of each group and bin of squared distance: one pass, one map-side combined aggregation, a few hundred rows a group."""
    binned = _distance(_meet(rows, fit, groups)).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) / BIN).cast("bigint"))
    return materialize(binned.groupBy("grp", "lang", "bin").agg(_sums()))


def _with_cut(bins: DataFrame, share: float) -> DataFrame:
    """``bins`` with ``cut``, the bin of the ``share`` quantile of each group's distances, drawn to that of all documents; running counts stand beside the bins, so nothing is joined."""
    own, run = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = bins.groupBy(F.lit(0).alias("one"), "bin").agg(F.sum(F.expr("s[0]")).alias("n"))
    everything = _quantiles(counts, ["one"], [share]).select("q").scalar()
    upto = bins.withColumns({"__u": F.sum(F.expr("s[0]")).over(run), "n": F.sum(F.expr("s[0]")).over(own), "a_q": everything})
    q = F.min(F.when(F.col("__u") >= F.ceil(F.col("n") * share - 1e-9), F.col("bin"))).over(own)
    return upto.withColumn("q", F.array(q.cast("double"))).withColumn("cut", F.expr(f"ceil({_drawn('q', 'n', 'a_q')}[0])")).drop("__u", "n", "q", "a_q")


def _cuts(bins: DataFrame, share: float) -> DataFrame:
    """``grp, cut``: each group's cut."""
    return _with_cut(bins, share).groupBy("grp").agg(F.max("cut").alias("cut"))


def _concentrated(bins: DataFrame, share: float, groups: int) -> DataFrame:
    """Shrunk estimates from the rows of each group up to its cut; a group without any has its language's."""
    within = _with_cut(bins, share).withColumn("s", F.expr(f"if(bin <= cut, s, array_repeat(0D, {NUMBERS + 1}))"))
    own = _gathered(materialize(within.groupBy("grp", "lang").agg(_added())), groups)
    none = F.lit(None).cast("string")
    lang = own.groupBy(none.alias("grp"), "lang").agg(_added())
    everything = own.groupBy(none.alias("grp"), none.alias("lang")).agg(_added())
    every = own.unionByName(lang).unionByName(everything)
    return _shrunk(every.select("grp", "lang", F.expr("s[0]").alias("n"), _estimate()))


def mcd_estimates(rows: DataFrame, subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant location and scatter per ``grp`` of a written table ``(grp, lang, features)``.

    Deterministic: concentration steps from a coordinate-wise robust start. Each step ranks a group's
    rows by their distance, keeps those up to the ``subset`` quantile's bin, and takes their mean and
    covariance, drawn to the language's and to all documents' (``PRIOR``); so do the cuts, and a
    few odd rows alone in a group neither move its estimate nor pass by it. Steps end when no
    determinant moves by ``SETTLED``; a warning tells if ``steps`` were not enough. Rows are passed once a step and summed
    by group and bin where they are read; the rest works on a few hundred rows a group. What returns to
    the driver is two numbers a step.
    """
    started, groups = _start(rows)
    best = materialize(_factor(started))
    for _ in range(steps):
        ranked = _ranked(rows, best, groups)
        new = materialize(_factor(_concentrated(_gathered(ranked, groups), subset, groups)))
        discard(ranked)
        old = _gathered(best, groups).select(F.col("grp").alias("__g"), F.col("logdet").alias("__old")).hint("merge")
        moved = _gathered(new, groups).join(old, F.col("grp") == F.col("__g")).agg(F.max(F.abs(F.col("logdet") - F.col("__old"))).alias("x")).first()["x"]
        discard(best)
        best = new
        if moved is None or moved < SETTLED:
            break
    else:
        warnings.warn(f"estimates still moved after {steps} steps: a log determinant by {moved:.3g}", stacklevel=2)
    # The median of the squared distances is set to that of a chi-square.
    mid = _cuts(_gathered(_ranked(rows, best, groups), groups), 0.5)
    scale = mid.select("grp", F.greatest(F.exp((F.col("cut") + 1) * BIN) / MEDIAN, F.lit(1.0)).alias("scale"))
    return materialize(_gathered(best, groups).join(scale.hint("merge"), "grp"))


def quality_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base statistics, ``base_failed``, the distance ``d2`` and ``kept`` for every row.

    Base failures never enter the estimates. A group is a language and a source, a null being a
    value of its own; each has an estimate of its own, the more drawn to its language's and to that of all documents the
    fewer documents it has. Where there is no document to estimate from, base rules decide alone. Texts of any length
    count whole; repeated rows count and are judged each; an empty table gives an empty result; other columns are ignored.
    """
    stat = transformed(with_base_stats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))))
    group = F.to_json(F.struct("lang", "source"))
    rows = materialize(stat.select("doc_id", *BASE, *FEATURES, group.alias("grp"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"), base_failed().alias("base_failed")))
    good = rows.where("not base_failed").select("grp", "lang", *FEATURES)
    fit = mcd_estimates(good)
    measured = _distance(_meet(rows, fit, fit.count())).withColumn("d2", F.col("d2") / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return measured.select("doc_id", *BASE, "base_failed", kept.alias("kept"), "d2")


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns kept.

    The verdict of an id is that of its worst row, so repeated ids stay or go together; rows with a
    null id stay only if no row with a null id fails.
    """
    bad = quality_stats(docs, id_col, text_col, lang_col, source_col).where("not kept").select("doc_id")
    return without_ids(docs, bad, id_col)
