"""Sequence alignment of words, tokens and sentences: one grouped pass per file or block."""

from __future__ import annotations

import re
from collections import deque
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


#: Blocks whose words are Python objects at one time.
HELD = 64


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of longest matching blocks; not an edit distance."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def words_match(rows: DataFrame, a: str, b: str, least: float = 0.8) -> DataFrame:
    """Add ``hit``: equal, one in the other, or a ratio of ``least``. Only pairs the cheap tests leave open reach Python.

    Lengths bound the ratio from above, so pairs that cannot reach it are settled first.
    """
    x, y = F.col(a), F.col(b)
    sure = (x == y) | ((F.length(x) > 2) & (F.length(y) > 2) & (F.contains(x, y) | F.contains(y, x)))
    never = F.coalesce(x, F.lit("")).isin("") | F.coalesce(y, F.lit("")).isin("") | (2.0 * F.least(F.length(x), F.length(y)) < least * (F.length(x) + F.length(y)))
    settled = rows.withColumn("hit", F.when(F.coalesce(never & ~F.coalesce(sure, F.lit(False)), F.lit(True)), F.lit(False)).when(sure, F.lit(True)))
    known = settled.where(F.col("hit").isNotNull())
    return known.unionByName(settled.where(F.col("hit").isNull()).withColumn("hit", ratio(x, y) >= least))


@lru_cache(1 << 16)
def norm(word: str) -> str:
    return re.sub(r"\W", "", word.lower())


@lru_cache(1 << 16)
def alike(a: str, b: str, least: float = 0.8) -> bool:
    """Two normalised words match: equal, one in the other, or by ratio; empty ones never do."""
    if not a or not b:
        return False
    if a == b or len(a) > 2 and len(b) > 2 and (a in b or b in a):
        return True
    return 2 * min(len(a), len(b)) >= least * (len(a) + len(b)) and SequenceMatcher(None, a, b).ratio() >= least


@lru_cache(1 << 16)
def _letters(word: str) -> int:
    """One bit for each character of a word, by its code modulo 63."""
    bits = 0
    for c in word:
        bits |= 1 << ord(c) % 63
    return bits


def _pairs_alike(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of two word lists that are alike.

    A character whose bit the other word lacks has no partner there, so bits bound the ratio from above as lengths do; only pairs within the bounds are compared.
    """
    x, y = np.array([_letters(w) for w in a], np.int64)[:, None], np.array([_letters(w) for w in b], np.int64)[None]
    n, m = np.array([len(w) for w in a])[:, None], np.array([len(w) for w in b])[None]
    most = np.minimum(n - np.bitwise_count(x & ~y), m - np.bitwise_count(y & ~x))
    open_ = (2 * np.minimum(np.minimum(n, m), most) >= 0.79 * (n + m)) | ((n > 2) & (m > 2) & ((x & ~y == 0) | (y & ~x == 0)))
    row, col = np.nonzero(open_ & (n > 0) & (m > 0))
    hit = np.array([alike(a[i], b[j]) for i, j in zip(row.tolist(), col.tolist())], bool)
    return row[hit], col[hit]


def _mean(values: list[float]) -> float:
    return sum(values) / len(values) if values else 0.0


def best_overlap(tail: list[tuple[str, float]], head: list[tuple[str, float]], most: int = 100) -> tuple[int, int, int]:
    """``(matches, tail words dropped, head words dropped)`` where a chunk's head, ``(word, probability)``, meets the last one's tail.

    Every shift of the two against each other is tried, over ``most`` words of each; one counts if half of the words in its overlap
    match, and the first of the best wins. The cut falls behind the last match. With no match, or with unmatched
    words behind it while the shorter side is not matched in full, probability decides: the more probable side of what
    differs stays, and the other whole side goes.
    """
    if not tail or not head:
        return 0, 0, 0
    a, b = [norm(w) for w, _ in tail[-most:]], [norm(w) for w, _ in head[:most]]
    if a == b and all(a):  # no other shift has as many words in its overlap
        return len(a), 0, len(a)
    matches, behind, cut = 0, 0, 0
    row, col = _pairs_alike(a, b)
    if len(row):
        shift = np.arange(1 - len(a), len(b))
        span = np.minimum(len(a), len(b) - shift) - np.maximum(0, -shift)
        hits = np.bincount(col - row + len(a) - 1, minlength=len(shift))
        hits[2 * hits < span] = 0
        top = int(hits.argmax())
        if hits[top]:
            last = int(row[col - row == shift[top]].max())
            matches, behind, cut = int(hits[top]), len(a) - 1 - last, last + int(shift[top]) + 1
    if matches and not (behind and matches < min(len(a), len(b))):
        return matches, behind, cut
    old, new = (tail[-behind:], head[cut:]) if matches else (tail, head)
    if _mean([p for _, p in old]) > _mean([p for _, p in new]):
        return matches, 0, len(head)
    return matches, len(tail), 0


def _reach(words, probs, dur: int, step: int, last: bool, reach_ms: int) -> list[tuple[str, float]]:
    """The words that start in the last or the first ``reach_ms`` of a chunk of words ``step`` apart."""
    kept = slice(max(-(-(dur - reach_ms) // step), 0), None) if last else slice(max(-(-reach_ms // step), 0))
    return list(zip(words[kept], probs[kept]))


def _listed(column: pa.ListArray, *fields: str) -> list[list[tuple]]:
    """Lists of structs as lists of tuples."""
    flat = column.flatten()
    rows = list(zip(*(flat.field(f).to_pylist() for f in fields)))
    ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(column).to_pylist())]).tolist()
    return [rows[i:j] for i, j in zip(ends, ends[1:])]


def overlaps(chunks: DataFrame) -> DataFrame:
    """Matches and cuts at each boundary of chunks ``(file_id, chunk_no, tail, head)``, arrays of (text, prob): tail of the last, head of this one."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                part = batch.slice(at, HELD)
                got = np.array([best_overlap(t, h) for t, h in zip(*(_listed(part.column(c), "text", "prob") for c in ("tail", "head")))], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("file_id"), part.column("chunk_no"), *map(pa.array, got.T)], names=["file_id", "chunk_no", "matches", "drop_tail", "drop_head"])

    return chunks.select("file_id", "chunk_no", "tail", "head").mapInArrow(run, "file_id bigint, chunk_no bigint, matches bigint, drop_tail bigint, drop_head bigint")


def merge_chunks(chunks: DataFrame, step: int = 300, reach_ms: int = 3000) -> DataFrame:
    """Fold chunks ``(file_id, chunk_no, words, probs)`` of a file left to right; words start ``step`` ms apart.

    Each boundary is decided from the two raw chunks; words dropped from a tail are popped from what was merged.
    """

    def fold(parts: list[tuple]) -> list[str]:
        out: list[str] = []
        tail: list[tuple[str, float]] = []
        for words, probs in parts:
            _, drop_tail, drop_head = best_overlap(tail, _reach(words, probs, 0, step, False, reach_ms))
            del out[max(len(out) - drop_tail, 0) :]
            out += words[drop_head:]
            tail = _reach(words, probs, step * len(words), step, True, reach_ms)
        return out

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                part = batch.slice(at, HELD)
                got = [fold(parts) for parts in _listed(part.column("parts"), "words", "probs")]
                yield pa.RecordBatch.from_arrays([part.column("file_id"), pa.array([len(g) for g in got], pa.int64()), pa.array([" ".join(g) for g in got], pa.string())], names=["file_id", "n_words", "text"])

    files = chunks.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "words", "probs"))).alias("parts"))  # one text's chunks
    return files.mapInArrow(run, "file_id bigint, n_words bigint, text string")


def hot_share(words: list[str], phrases: tuple[str, ...], before: list[str] = [], after: list[str] = []) -> float:  # noqa: B006
    """Share of the words that touch a hot phrase, looked for in the words with their neighbours around them."""
    every = [norm(w) for w in [*before, *words, *after]]
    text = " ".join(every)
    hot = bytearray(len(text) + 1)
    for phrase in phrases:
        at = text.find(phrase)
        while at >= 0:
            hot[at : at + len(phrase)] = b"\x01" * len(phrase)
            at = text.find(phrase, at + 1)
    starts = [0, *accumulate(len(w) + 1 for w in every)]
    touched = [any(hot[s : s + len(w)]) for s, w in zip(starts, every)]
    return sum(touched[len(before) : len(before) + len(words)]) / len(words) if words else 0.0


def hot_shares(blocks: DataFrame, phrases: tuple[str, ...]) -> DataFrame:
    """``(file_id, pos, ratio)`` of blocks ``(file_id, pos, w, before, after)``."""

    def run(batches):
        for p in batches:
            got = [hot_share(list(w), phrases, list(b), list(a)) for w, b, a in zip(p.w, p.before, p.after)]
            yield pd.DataFrame({"file_id": p.file_id, "pos": p.pos, "ratio": got})

    return blocks.select("file_id", "pos", "w", "before", "after").mapInPandas(run, "file_id bigint, pos bigint, ratio double")


def vote(a: list, b: list, phrases: tuple[str, ...] = (), least: float = 0.2, bonus: float = 0.5, context: int = 3) -> list[tuple[str, bool]]:
    """Words of two hypotheses, lists of (text, start_ms, conf), by vote, and whether the two differ there.

    Equal words stay, and words of the first alone; of differing stretches the one of higher mean confidence wins, where one side
    alone touches hot phrases (seen with the equal words around) it gains ``bonus`` times its share; words of the second alone need more than
    ``least``. In start order, a word that came from the second alone goes if the same word starts within 150 ms.
    """
    if not a or not b:
        return [(w["text"], False) for w in a or b]
    out: list[tuple[int, str, bool, bool]] = []
    take = lambda ws, differs=False, extra=False: out.extend((w["start_ms"], w["text"], differs, extra) for w in ws)
    steps = SequenceMatcher(None, [norm(w["text"]) for w in a], [norm(w["text"]) for w in b], autojunk=False).get_opcodes()
    for k, (kind, i, j, m, n) in enumerate(steps):
        if kind == "insert":
            take((w for w in b[m:n] if w["conf"] > least), True, True)
        elif kind != "replace":
            take(a[i:j])
        else:
            equal = [k > 0 and steps[k - 1][0] == "equal", k + 1 < len(steps) and steps[k + 1][0] == "equal"]
            sides = []
            for words, first, last, low, high in ((a, i, j, 1, 2), (b, m, n, 3, 4)):
                before = words[max(steps[k - 1][low], first - context) : first] if equal[0] else []
                after = words[last : min(steps[k + 1][high], last + context)] if equal[1] else []
                texts = [[w["text"] for w in ws] for ws in (words[first:last], before, after)]
                sides.append((words[first:last], _mean([w["conf"] for w in words[first:last]]), hot_share(texts[0], phrases, *texts[1:])))
            (x, conf_x, hot_x), (y, conf_y, hot_y) = sides
            gain = lambda mine, other: bonus * mine if mine and not other else 0.0
            take(y if conf_y + gain(hot_y, hot_x) > conf_x + gain(hot_x, hot_y) else x, True)
    out.sort(key=lambda w: w[0])
    kept: list[tuple[int, str, bool, bool]] = []
    for w in out:
        if not (w[3] and any(not o[3] and abs(o[0] - w[0]) < 150 and norm(o[1]) == norm(w[1]) for o in kept)):
            kept.append(w)
    return [(text, differs) for _, text, differs, _ in kept]


def rover(pairs: DataFrame, phrases: tuple[str, ...] = ()) -> DataFrame:
    """Vote of two hypotheses per block: ``(file_id, pos, a, b)``, arrays of (text, start_ms, conf); words that differ are marked."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):  # words become Python objects a few blocks at a time
                part = batch.slice(at, HELD)
                sides = ([[{"text": t, "start_ms": s, "conf": c} for t, s, c in ws] for ws in _listed(part.column(x), "text", "start_ms", "conf")] for x in ("a", "b"))
                got = [vote(a, b, phrases) for a, b in zip(*sides)]
                told = [pa.array([" ".join(w for w, _ in g) for g in got], pa.string()), pa.array([sum(d for _, d in g) for g in got], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("file_id"), part.column("pos"), *told], names=["file_id", "pos", "text", "n_disagree"])

    return pairs.select("file_id", "pos", "a", "b").mapInArrow(run, "file_id bigint, pos bigint, text string, n_disagree bigint")


def disagreements(pairs: DataFrame) -> DataFrame:
    """Indices of the first text's words where two texts ``(file_id, pos, a, b)`` differ; an insertion flags both neighbours."""

    def differ(a: list[str], b: list[str]) -> list[int]:
        out: set[int] = set()
        for kind, i, j, _, _ in SequenceMatcher(None, a, b).get_opcodes():
            if kind == "insert":
                out |= {x for x in (i - 1, i) if 0 <= x < len(a)}
            elif kind != "equal":
                out |= set(range(i, j))
        return sorted(out)

    def run(batches):
        for p in batches:
            rows = [(f, s, i) for f, s, a, b in zip(p.file_id, p.pos, p.a, p.b) for i in differ(list(a), list(b))]
            yield pd.DataFrame(rows, columns=["file_id", "pos", "word"]).astype("int64")

    return pairs.select("file_id", "pos", "a", "b").mapInPandas(run, "file_id bigint, pos bigint, word bigint")


def _near(a: str, b: str) -> bool:
    return bool(b) and a == b or len(a) > 2 and len(b) > 2 and (a in b or b in a)


def place_sentences(words: list[str], sentences: list[str], reach: int = 50, accept: float = 0.7, sure: float = 0.95) -> list[tuple[int, int, int, bool]]:
    """``(sentence, first word, word after the last, matched)`` by a greedy forward map.

    From the cursor a sentence looks ahead for words like its first one and follows it from there, one surplus word skipped at
    most at each step, until one differs. The first best start wins, at once if ``sure``. Below ``accept`` the sentence
    starts at the next word that holds its first one or lies in it, else at the cursor, and takes as many words as it has.
    Sentences without a word are passed over.
    """

    def follow(want: list[str], at: int) -> tuple[float, int]:
        hits, last, k = 1, at, at + 1
        for w in want[1:]:
            step = next((s for s in (0, 1) if k + s < len(have) and _near(have[k + s], w)), None)
            if step is None:
                break
            hits, last, k = hits + 1, k + step, k + step + 1
        return hits / len(want), last

    have, at, out = [norm(w) for w in words], 0, []
    for number, sentence in enumerate(sentences):
        want = [w for w in map(norm, sentence.split()) if w]
        if not want or not have:
            continue
        best = (0.0, 0, 0)
        for start in range(at, min(at + reach, len(have))):
            if _near(have[start], want[0]):
                score, last = follow(want, start)
                best = max(best, (score, start, last), key=lambda x: x[0])
                if score >= sure:
                    break
        if best[0] >= accept:
            _, first, last = best
        else:
            first = next((i for i in range(at, len(have)) if want[0] in have[i] or have[i] in want[0]), min(at, len(have) - 1))
            last = min(first + len(want), len(have)) - 1
        out.append((number, first, last + 1, best[0] >= accept))
        at = last + 1
    return out


def align_sentences(files: DataFrame) -> DataFrame:
    """Words of each sentence of files ``(file_id, words, sentences)``, by ``place_sentences``."""

    def run(batches):
        for p in batches:
            rows = [(f, *r) for f, w, s in zip(p.file_id, p.words, p.sentences) for r in place_sentences(list(w), list(s))]
            yield pd.DataFrame(rows, columns=["file_id", "sentence", "first_word", "after_word", "matched"])

    return files.select("file_id", "words", "sentences").mapInPandas(run, "file_id bigint, sentence bigint, first_word bigint, after_word bigint, matched boolean")


def merge_token_chunks(chunks: DataFrame, overlap: int = 16, trim: int = 6) -> DataFrame:
    """Join a turn's overlapping token chunks ``(file_id, pos, chunks)``: the seam falls ``trim`` tokens before the overlap's end."""

    def join(parts: list[list[str]]) -> list[str]:
        out = list(parts[0])
        for part in map(list, parts[1:]):
            tail, head = out[-overlap:], part[:overlap]
            blocks = [m for m in SequenceMatcher(None, tail, head, autojunk=False).get_matching_blocks() if m.size]
            keep = overlap - trim
            seam = next((m for m in reversed(blocks) if m.a <= keep), None)
            out = out[: len(out) - len(tail) + seam.a] + part[seam.b :] if seam else out + part
        return out

    def run(batches):
        for p in batches:
            got = [join([list(c) for c in cs]) for cs in p.chunks]
            yield pd.DataFrame({"file_id": p.file_id, "pos": p.pos, "n_tokens": [len(g) for g in got], "text": [" ".join(g) for g in got]})

    return chunks.select("file_id", "pos", "chunks").mapInPandas(run, "file_id bigint, pos bigint, n_tokens bigint, text string")


class Trie:
    """Phrases of tokens with scores. A state is the longest suffix of the tokens that begins a phrase; it is paid token by token.

    As soon as a whole phrase lies at the state's end, be it a shorter one than the state is on the way to, that phrase's payment
    alone stays and the state returns to the root.
    """

    def __init__(self, phrases: dict[tuple[str, ...], float]):
        self.next: list[dict[str, int]] = [{}]
        self.paid, self.fail = [0.0], [0]
        whole: set[int] = set()
        gain = [0.0]
        for phrase, score in sorted(phrases.items()):
            at = 0
            for token in phrase:
                child = self.next[at].setdefault(token, len(self.next))
                if child == len(self.next):
                    self.next.append({})
                    for column in (self.paid, self.fail, gain):
                        column.append(0)
                gain[child] = max(gain[child], score)
                at = child
            whole.add(at)
        self.pays: list[float | None] = [None] * len(self.next)
        todo = deque([0])
        while todo:
            at = todo.popleft()
            for token, child in self.next[at].items():
                self.paid[child] = self.paid[at] + gain[child]
                self.fail[child] = self._step(self.fail[at], token) if at else 0
                self.pays[child] = self.paid[child] if child in whole else self.pays[self.fail[child]]
                todo.append(child)

    def _step(self, at: int, token: str) -> int:
        while at and token not in self.next[at]:
            at = self.fail[at]
        return self.next[at].get(token, 0)

    def score(self, tokens: list[str]) -> float:
        """Sum of the payments; what an unfinished phrase was paid is taken back."""
        total, at = 0.0, 0
        for token in tokens:
            here = self._step(at, token)
            pays = self.pays[here]
            total += (self.paid[here] if pays is None else pays) - self.paid[at]
            at = here if pays is None else 0
        return total - self.paid[at]


def phrase_scores(rows: DataFrame, phrases: dict[tuple[str, ...], float], tokens: str = "tokens") -> Column:
    """Context score of each row's token array; the phrases, a user's short list, go to every task."""
    shared = rows.sparkSession.sparkContext.broadcast(phrases)

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        trie = Trie(shared.value)
        return pd.Series([trie.score(list(x)) for x in column])

    return run(F.col(tokens))
