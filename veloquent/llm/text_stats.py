"""Text statistics as built-in Spark expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space: the separators of words.
SPACE = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for the row."""
    return F.transform(F.array(value), use).getItem(0)


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order; none for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def repeated_words(tokens: Column, width: int = 8) -> Column:
    """How many words lie in windows of ``width`` words that the text holds twice or more, first ones included.

    Windows are told apart by 64-bit hashes of their words' 64-bit hashes. Only texts in which some
    hash recurs sort their windows.
    """

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1), x + width) - x))
        return F.aggregate(step, F.lit(0), lambda acc, x: acc + x)

    def starts_of(ordered: Column) -> Column:
        twin = lambda e, k: F.coalesce((F.get(ordered, k - 1)["h"] == e["h"]) & (k > 0), F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.filter(F.transform(ordered, lambda e, k: F.when(twin(e, k), e["i"])), lambda x: x.isNotNull()))

    def count(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        dup = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(dup, let(let(pairs, starts_of), covered)).otherwise(0)

    def hashed(ids: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(ids) - width)
        return let(F.transform(at, lambda i: F.xxhash64(*(F.get(ids, i + j) for j in range(width)))), count)

    counted = let(F.transform(tokens, lambda w: F.xxhash64(w)), hashed)
    return F.when(F.size(tokens) > width, counted).otherwise(0).cast("bigint")


def with_base_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the array ``__words``.

    A null text counts as empty. A line counts if it holds a word; it is a duplicate if equal to an earlier one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))
    repeats = let(F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return docs.withColumn("__words", words(F.col(text_col))).withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
            "n_symbols": symbols.cast("bigint"),
            "n_dup_lines": repeats.cast("bigint"),
            "n_repeat_words": repeated_words(F.col("__words")),
        }
    )
