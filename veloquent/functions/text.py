"""Text functions as built-in expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bases() -> tuple[str, str]:
    """Accented Latin letters and their bases, by canonical decomposition; the barred d goes to d."""
    found = {"đ": "d"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii() and c == c.lower():
            found[c] = base
    return "".join(found), "".join(found.values())


def unaccent(text: Column) -> Column:
    """Lower-cased text without accents, for composed Latin letters."""
    return F.translate(F.lower(text), *_bases())


def norm_word(text: Column) -> Column:
    """Lower-cased word without anything but letters, digits and underscores."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_]", "")


def occurrences(text: Column, needle: Column) -> Column:
    """Positions from 1 of all occurrences of a needle, overlapping ones too, in time linear in the text.

    The text is cut before each occurrence, so that every piece but perhaps the first begins one; the
    lengths of the pieces add up to the positions.
    """
    quoted = F.concat(F.lit("(?=\\Q"), needle, F.lit("\\E)"))
    pieces = F.split(text, quoted)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.when((acc["at"] > 1) | F.startswith(text, needle), F.array_append(acc["out"], acc["at"])).otherwise(acc["out"]).alias("out"))
    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def sentences(text: Column) -> Column:
    """Sentences: cuts at white space behind a full stop, question or exclamation mark."""
    return F.split(text, r"(?<=[.?!])\s+")


# What restored punctuation is rewritten to, in this order: before short sentences lose commas, and after. The
# result depends on each pattern and on the order.
MARKS_FIRST = ((r":", " "), (r",+", ","), (r"\.{4,}", "..."), (r",\s*\.", "."))
MARKS_LAST = ((r"([,.!?])([^\s])", "$1 $2"), (r"\s+([,.!?])", "$1"), (r"^,\s*", ""), (r"\.\s*,", ". "), (r"\s+", " "))
#: Words below which a sentence keeps its first comma alone.
SHORT = 8


def _rewritten(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)


def clean_punctuation(text: Column) -> Column:
    """Restored punctuation tidied: marks rewritten, short sentences with one comma at most, sentences begun in upper case."""

    def one_comma(sentence: Column) -> Column:
        clauses = F.split(sentence, ",")
        words = F.filter(F.split(sentence, r"\s+"), lambda w: w != "")
        rest = F.array_join(F.slice(clauses, 2, F.greatest(F.size(clauses) - 1, F.lit(0))), "")
        return F.when((F.size(words) < SHORT) & (F.size(clauses) > 2), F.concat_ws(",", F.get(clauses, F.lit(0)), rest)).otherwise(sentence)

    def begun(sentence: Column) -> Column:
        return F.concat(F.upper(F.left(sentence, F.lit(1))), F.substr(sentence, F.lit(2)))

    thinned = F.array_join(F.transform(sentences(_rewritten(text, MARKS_FIRST)), one_comma), " ")
    return F.trim(F.array_join(F.transform(sentences(_rewritten(thinned, MARKS_LAST)), begun), " "))


def parse_llm_json(raw: Column) -> Column:
    """A reply's JSON text, thinking aside: the first that parses of the whole, what lies inside a fence, and what lies from the
    first brace to the last; else ``{}``."""

    def between(t: Column, first: Column, after: Column) -> Column:
        return F.when((first > 0) & (after > first), F.substring(t, first, after - first))

    def last(t: Column) -> Column:
        """Place behind the last closing brace."""
        return F.length(t) + 2 - F.locate("}", F.reverse(t))

    thought = F.split(F.trim(raw), "<think>")
    spoken = F.array_join(F.transform(thought, lambda x, i: F.when((i > 0) & F.contains(x, F.lit("</think>")), F.substr(x, F.locate("</think>", x) + 8)).when(i > 0, F.concat(F.lit("<think>"), x)).otherwise(x)), "")
    text = F.trim(spoken)
    inside = F.get(F.split(text, "```"), F.lit(1))
    asked = [text, between(inside, F.locate("{", inside), last(inside)), between(text, F.locate("{", text), last(text))]
    return F.coalesce(*(F.when(F.try_parse_json(F.nullif(x, F.lit(""))).isNotNull(), x) for x in asked), F.lit("{}"))
