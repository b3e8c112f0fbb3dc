"""Fill-in-the-middle rearrangement of texts held as ropes, and its inverse."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit is a run of ASCII letters or any other code point.
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
#: Code points of a leaf; a unit that is longer has a leaf of its own.
LEAF = 2048
#: Of a hundred rows, those from here on stay plain; of the others, those under SPM put the suffix first.
PLAIN_FROM, SPM = 90, 20


@dataclass(frozen=True, slots=True)
class Rope:
    """A text as a binary tree. Leaves hold text; every node caches its units and its code points.

    Joins never merge units across their seam, so the units of a rope are those of its parts.
    """

    units: int
    chars: int
    text: str | None = None
    left: Rope | None = None
    right: Rope | None = None

    def split(self, rank: int, by: str = "units") -> tuple[Rope, Rope]:
        """The first ``rank`` units (or ``chars``) and the rest: one walk down, whose path alone is built anew."""
        path: list[tuple[Rope, bool]] = []
        node = self
        while node.text is None:
            first = getattr(node.left, by)
            path.append((node, rank < first))
            node, rank = (node.left, rank) if rank < first else (node.right, rank - first)
        if by == "chars":
            at = rank
            units = len(UNIT.findall(node.text[:at]))
        else:
            units = min(max(rank, 0), node.units)
            at = node.chars if units == node.units else next(m.start() for k, m in enumerate(UNIT.finditer(node.text)) if k == units)
        low, high = _leaf(node.text[:at], units), _leaf(node.text[at:], node.units - units)
        for node, went_left in reversed(path):
            low, high = (low, join(high, node.right)) if went_left else (join(node.left, low), high)
        return low, high

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.text is None:
                todo += (node.right, node.left)
            else:
                yield node.text

    def __str__(self) -> str:
        return "".join(self.leaves())


def _leaf(text: str, units: int) -> Rope:
    return Rope(units, len(text), text)


EMPTY = Rope(0, 0, "")


def join(left: Rope, right: Rope) -> Rope:
    """Both texts one behind the other; an empty one adds no node."""
    if not left.chars:
        return right
    if not right.chars:
        return left
    return Rope(left.units + right.units, left.chars + right.chars, None, left, right)


def _balanced(parts: list[Rope]) -> Rope:
    """One tree over the parts, level by level."""
    while len(parts) > 1:
        parts = [join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else EMPTY


def rope(text: str, leaf: int = LEAF) -> Rope:
    """A balanced rope with leaves of about ``leaf`` code points that end where units end."""
    if not text:
        return EMPTY
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = ((points | 32) >= 97) & ((points | 32) <= 122) & (points < 128)
    begins = ~letter
    begins[0] = True
    begins[1:] |= letter[1:] & ~letter[:-1]
    starts = np.flatnonzero(begins)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(points), leaf)))
    cuts = cuts[cuts < len(starts)]
    at, ranks = [*starts[cuts].tolist(), len(text)], [*cuts.tolist(), len(starts)]
    return _balanced([_leaf(text[a:b], n - m) for a, b, m, n in zip(at, at[1:], ranks, ranks[1:])])


def draws(doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 that follow from the id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rearrange(text: str | None, doc_id: int | None) -> tuple[int, str, int | None, int | None, str]:
    """``(units, form, prefix code points, middle code points, output)`` of one text."""
    text = text or ""
    whole = rope(text)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return whole.units, "plain", None, None, text
    low, high = sorted((h1 % (whole.units + 1), h2 % (whole.units + 1)))
    rest, suffix = whole.split(high)
    prefix, middle = rest.split(low)
    p, s, m = (_leaf(x, len(x)) for x in (PREFIX, SUFFIX, MIDDLE))
    form, order = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < SPM else ("psm", (p, prefix, s, suffix, m, middle))
    return whole.units, form, prefix.chars, middle.chars, str(_balanced(list(order)))


def rebuild(output: str, form: str) -> str:
    """The text that ``rearrange`` was given: the output's rope split at its sentinels and joined in the first order."""
    if form == "plain":
        return output
    if form not in ("psm", "spm"):
        raise ValueError(f"no such form: {form}")
    rest, parts = rope(output), {}
    places = sorted(((output.index(s), s) for s in (PREFIX, SUFFIX, MIDDLE)), reverse=True)
    for at, sentinel in places:
        rest, tail = rest.split(at, "chars")
        parts[sentinel] = tail.split(len(sentinel), "chars")[1]
    return str(_balanced([parts[PREFIX], parts[MIDDLE], parts[SUFFIX]]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs``.

    Texts are cut at two unit ranks that follow from the id alone, so equal rows come out equal. Null and empty texts, texts that hold a
    sentinel and a tenth of the others stay plain, with null lengths. A null id draws as an empty one.
    An empty table gives an empty result; other columns are ignored. A text is held whole, in leaves of ``LEAF`` code points; a longer run of letters is one unit and one leaf.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            ids = batch.column(0)
            columns = list(zip(*(rearrange(t.as_py(), i.as_py()) for i, t in zip(ids, batch.column(1))))) or [()] * 5
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns, kinds)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", out_col: str = "restored") -> DataFrame:
    """``rows`` with the texts rebuilt from output and form as ``out_col``; a null output gives null, an unknown form an error."""
    at = [rows.columns.index(c) for c in (output_col, form_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [None if o.as_py() is None else rebuild(o.as_py(), f.as_py()) for o, f in zip(*(batch.column(k) for k in at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.string())], names=[*batch.schema.names, out_col])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{types}, `{out_col}` string")
