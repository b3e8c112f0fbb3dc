"""Label scans of long files in pieces: each piece maps what may come in to what goes out, maps compose, pieces replay.

A scan walks over ordered rows and keeps (label of the last row, whether the row before had the same). Rules compare labels for equality alone,
so a label that comes in from outside and does not occur in a piece acts as one fresh symbol, ``OTHER``. The map of a piece therefore needs an outcome for
``OTHER`` and those of the few labels that end otherwise, whatever the number of speakers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.run import shared_dir

#: A label that a piece does not hold.
OTHER = "*"
#: Rows of a piece, and of a file that one task still scans whole.
SIZE = 200_000
State = tuple[object, bool]
#: A rule gives the label of a row from the state, the row, the row before it, the one before that and the row behind it; what lies outside the file is None.
Rule = Callable[[State | None, object, object, object, object], object]


def _walk(rows: list, around: tuple[list, list], rule: Rule, state: State | None, each: Callable | None = None) -> State:
    """The state behind ``rows`` of one file, which come in with ``state``; ``each`` is told every label."""
    line = [*around[0], *rows, *around[1]]
    skip = len(around[0])
    for i in range(skip, skip + len(rows)):
        before = line[i - 1] if i else None
        label = rule(state, line[i], before, line[i - 2] if i > 1 else None, line[i + 1] if i + 1 < len(line) else None)
        state = (label, before is not None and label == state[0])
        if each:
            each(label)
    return state


def outcomes(rows: list, around: tuple[list, list], rule: Rule) -> dict[State, State]:
    """What each incoming state becomes; states that meet are walked once from there."""
    incoming = [(w, same) for w in [OTHER, *dict.fromkeys(r.speaker for r in [*rows, *around[1]])] for same in (False, True)]
    now = {s: s for s in incoming}
    line = [*around[0], *rows, *around[1]]
    for at in range(len(rows)):
        alive = set(now.values())
        i = at + len(around[0])
        near = ([line[k] for k in (i - 2, i - 1) if k >= 0], line[i + 1 : i + 2])
        if len(alive) == 1:
            whole = _walk(rows[at:], (near[0], around[1]), rule, alive.pop())
            return dict.fromkeys(incoming, whole)
        moved = {s: _walk([line[i]], near, rule, s) for s in alive}
        now = {k: moved[v] for k, v in now.items()}
    return now


def follow(found: dict[State, State], state: State) -> State:
    """The outcome of a state by a piece's map; ``OTHER`` that comes out stands for what came in."""
    out = found.get(state) or found[OTHER, state[1]]
    return (state[0], out[1]) if out[0] == OTHER else out


def _rows(p: pd.DataFrame) -> list:
    return list(p.sort_values(["file_id", "start_ms", "pos"], kind="stable").itertuples(index=False, name="Row"))


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/carried-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _edges(dealt: DataFrame, names: list[str], order: list[str]) -> tuple[dict, dict]:
    """The first row and the last two rows of each piece."""
    row, key = F.struct(*names), F.struct(*order)
    ends = dealt.groupBy("__piece").agg(F.min_by(row, key).alias("first"), F.max_by(row, key).alias("last"), F.max(key).alias("k"))
    last = ends.select("__piece", "k")
    second = dealt.join(last, "__piece").where(key < F.col("k")).groupBy("__piece").agg(F.max_by(row, key).alias("second"))
    found = ends.join(second, "__piece", "left").select("__piece", "first", "second", "last").collect()
    return {r["__piece"]: r["first"] for r in found}, {r["__piece"]: [x for x in (r["second"], r["last"]) if x is not None] for r in found}


def _surroundings(heads: dict, tails: dict) -> dict[int, tuple[list, list]]:
    """For each piece the rows of its first file before it, two at most, and the row behind it."""
    before, behind, seen, following = {}, {}, [], []
    for k in sorted(heads):
        before[k] = [r for r in seen if r.file_id == heads[k].file_id]
        seen = [*seen, *tails[k]][-2:]
    for k in sorted(heads, reverse=True):
        behind[k] = following
        following = [heads[k]]
    return {k: (before[k], behind[k]) for k in heads}


def _after(dealt: DataFrame, rule: Rule, names: list[str], order: list[str]) -> DataFrame:
    """All pieces with the labels that one rule leaves."""
    heads, tails = _edges(dealt, names, order)
    around = _surroundings(heads, tails)

    def files(p: pd.DataFrame) -> list[tuple[list, tuple[list, list]]]:
        """A piece's rows by file, with what stands around them."""
        before, behind = around[int(p["__piece"].iloc[0])]
        found: list[list] = []
        for r in _rows(p[names]):
            if not found or found[-1][0].file_id != r.file_id:
                found.append([])
            found[-1].append(r)
        return [(rs, (before if i == 0 else [], [r for r in behind if r.file_id == rs[0].file_id])) for i, rs in enumerate(found)]

    def tell(p: pd.DataFrame) -> pd.DataFrame:
        """The map of a piece: outcomes of ``OTHER``, null here, and of labels that end otherwise."""
        rs, near = files(p)[-1]
        table = outcomes(rs, near, rule) if near[0] else dict.fromkeys([(OTHER, False), (OTHER, True)], _walk(rs, near, rule, None))
        usual = {s: o for s, o in table.items() if s[0] == OTHER}
        kept = [(*s, *o) for s, o in table.items() if s in usual or follow(usual, s) != o]
        out = pd.DataFrame(kept, columns=["came", "came_same", "went", "went_same"])
        return out.assign(piece=p["__piece"].iloc[0], **{c: pd.array([None if v == OTHER else v for v in out[c]], "Int64") for c in ("came", "went")})

    maps: dict[int, dict[State, State]] = {}
    name = lambda v: OTHER if v is None else v
    for r in dealt.groupBy("__piece").applyInPandas(tell, "piece int, came bigint, came_same boolean, went bigint, went_same boolean").collect():
        maps.setdefault(r.piece, {})[name(r.came), r.came_same] = (name(r.went), r.went_same)
    enters: dict[int, State | None] = {}
    state: State | None = None
    for k in sorted(heads):
        enters[k] = state if around[k][0] else None
        state = follow(maps[k], enters[k] or (OTHER, False))

    def replay(p: pd.DataFrame) -> pd.DataFrame:
        labels: list = []
        lines: list = []
        for i, (rs, near) in enumerate(files(p)):
            _walk(rs, near, rule, enters[int(p["__piece"].iloc[0])] if i == 0 else None, labels.append)
            lines += rs
        return pd.DataFrame(lines, columns=names).assign(speaker=labels, __piece=p["__piece"].iloc[0])

    return _written(dealt.groupBy("__piece").applyInPandas(replay, dealt.schema))


def scan_pieces(rows: DataFrame, rules: list[Rule], pieces: int) -> DataFrame:
    """``rows`` (file_id, pos, speaker, start_ms, end_ms and what rules read) with the labels after each of ``rules`` in turn, in ``pieces`` of about equal size.

    Rows are dealt by ranges of (file_id, start_ms, pos), so that a file spreads over tasks whatever its length. For each rule the driver sees three rows and one map of each piece, whose number is that of
    the partitions; tasks hold one piece. Labels are whole numbers, none of them null.
    """
    names, order = rows.columns, ["file_id", "start_ms", "pos"]
    dealt = _written(rows.repartitionByRange(pieces, *order).withColumn("__piece", F.spark_partition_id()))
    for rule in rules:
        dealt = _after(dealt, rule, names, order)
    return dealt.drop("__piece")


def scan_labels(rows: DataFrame, rules: list[Rule], size: int = SIZE) -> DataFrame:
    """``rows`` with the labels after each of ``rules``: files of up to ``size`` rows whole, each in one task, longer ones in pieces of about ``size`` rows, with the same labels."""

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["start_ms", "pos"], kind="stable")
        for rule in rules:
            labels: list = []
            _walk(_rows(p), ([], []), rule, None, labels.append)
            p = p.assign(speaker=labels)
        return p

    long = rows.groupBy("file_id").count().where(F.col("count") > size)
    total = long.agg(F.sum("count").alias("n")).first().n or 0
    if not total:
        return rows.groupBy("file_id").applyInPandas(whole, rows.schema)
    long = _written(long.select("file_id"))
    short = rows.join(long, "file_id", "left_anti").groupBy("file_id").applyInPandas(whole, rows.schema)
    return short.unionByName(scan_pieces(rows.join(long, "file_id", "left_semi").select(*rows.columns), rules, -(-total // size)))
