"""Queries whose steps are sequential within a file, alignment, clustering, and live streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..operators import alignment, density, scans, spectral, variational
from ..operators.beam import beam_search
from ..operators.turns import natural_turns
from ..session import table
from ..streaming.endpoint import changed_partials, endpoints
from ..streaming.run import drain, drain_updates, read_stream
from .base import Group
from .text import words
from .timeline import _D, _S, _W, ORDER, _gap_sql, diar, gap_merge, segs
from .timeline import words as timed_words

query = Group()


def segments(spark: SparkSession, sf: str, dense: bool = False) -> DataFrame:
    d = diar(spark, sf, dense)
    return d.select("file_id", "pos", "speaker", "start_ms", "end_ms", (1 + F.col("pos") % 6).alias("n_words"), (F.col("pos") % 4 == 0).alias("ends_sentence"))


@query("win_smooth_speakers")
def win_smooth_speakers(spark: SparkSession, sf: str) -> DataFrame:
    """Island, lead-singleton and trailing-particle rules on all files (win_island_smooth, win_lead_singleton, win_trail_particle)."""
    return scans.smooth_speakers(segments(spark, sf))


_SEGMENTS = """g AS (SELECT user_id // 3 AS file_id, event_id AS pos, user_id % 3 AS speaker, s AS start_ms, s + 1 + greatest(CAST(floor(value * 100) AS BIGINT), 0) AS end_ms, 1 + event_id % 6 AS n_words, event_id % 4 = 0 AS ends_sentence,
  row_number() OVER (PARTITION BY user_id // 3 ORDER BY s, event_id) AS r FROM (SELECT *, (epoch_us(ts) - 1704067200000000) // 4000000 AS s FROM events))"""
#: What each rule gives row x, from the row a before it with its new speaker, and the row b behind it.
_SMOOTH = {
    "island": "CASE WHEN a.who = b.speaker AND b.speaker <> x.speaker AND (x.end_ms - x.start_ms <= 1500 OR x.n_words <= 4) THEN a.who ELSE x.speaker END",
    "lead": "CASE WHEN x.n_words = 1 AND x.end_ms - x.start_ms <= 800 AND NOT x.ends_sentence AND b.n_words >= 2 AND x.speaker <> b.speaker AND (a.r = 0 OR x.start_ms - a.end_ms >= 1200) AND b.start_ms - x.end_ms <= 2500 THEN b.speaker ELSE x.speaker END",
    "trail": "CASE WHEN a.r > 1 AND x.n_words <= 2 AND x.end_ms - x.start_ms <= 900 AND x.ends_sentence AND NOT a.ends_sentence AND x.start_ms - a.end_ms <= 250 AND x.speaker <> a.who AND a.who = a.before AND a.start_ms - a.before_end <= 1000 THEN a.who ELSE x.speaker END",
}


def _smooth_sql(rule: str, dense: bool) -> str:
    source = _SEGMENTS.replace("user_id // 3", "user_id % 32").replace("user_id % 3 AS", "user_id // 32 % 3 AS") if dense else _SEGMENTS
    return f"""WITH RECURSIVE {source},
    s AS (SELECT file_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS who, CAST(NULL AS BIGINT) AS start_ms, CAST(NULL AS BIGINT) AS end_ms, CAST(NULL AS BOOLEAN) AS ends_sentence, CAST(NULL AS BIGINT) AS before, CAST(NULL AS BIGINT) AS before_end, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS n_words FROM (SELECT DISTINCT file_id FROM g)
      UNION ALL SELECT x.file_id, x.r, coalesce({_SMOOTH[rule]}, x.speaker), x.start_ms, x.end_ms, x.ends_sentence, a.who, a.end_ms, x.pos, x.n_words FROM s a JOIN g x ON x.file_id = a.file_id AND x.r = a.r + 1 LEFT JOIN g b ON b.file_id = x.file_id AND b.r = x.r + 1)
    SELECT file_id, pos, who AS speaker, start_ms, end_ms, n_words, ends_sentence FROM s WHERE r > 0"""


for _name, _rule, _dense in (("win_island_smooth", "island", False), ("win_lead_singleton", "lead", False), ("win_trail_particle", "trail", True)):
    query(_name, _smooth_sql(_rule, _dense))(lambda spark, sf, rule=_rule, dense=_dense: scans.smooth_speakers(segments(spark, sf, dense), (rule,)))


_TURNS = f"""WITH {_D}, {_S}, {_W},
  o AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY file_id, speaker ORDER BY start_ms, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 2000 THEN 0 ELSE 1 END AS o FROM d),
  k AS (SELECT *, sum(o) OVER (PARTITION BY file_id, speaker ORDER BY start_ms, pos) AS turn, count(*) OVER (PARTITION BY file_id) AS n FROM o),
  tn AS (SELECT file_id, speaker, turn, min(start_ms) AS a, max(end_ms) AS b FROM k GROUP BY file_id, speaker, turn),
  m AS (SELECT file_id, (start_ms + end_ms) / 2 AS at FROM w),
  h AS (SELECT t.*, p.speaker AS host FROM tn t JOIN tn p ON p.file_id = t.file_id AND p.speaker <> t.speaker AND p.a <= t.a AND t.b <= p.b AND (p.a < t.a OR p.speaker < t.speaker)
    WHERE t.b - t.a < 2000 QUALIFY row_number() OVER (PARTITION BY t.file_id, t.speaker, t.turn ORDER BY p.a, p.speaker) = 1),
  few AS (SELECT file_id, speaker, turn, host FROM h WHERE (SELECT count(*) FROM m WHERE m.file_id = h.file_id AND m.at BETWEEN h.a AND h.b) <= 3),
  nt AS (SELECT k.file_id, k.pos, CASE WHEN n > 2 THEN coalesce(few.host, k.speaker) ELSE k.speaker END AS speaker, start_ms, end_ms, n FROM k LEFT JOIN few USING (file_id, speaker, turn)),
  big AS (SELECT * FROM nt WHERE n > 2),"""


@query(
    "win_natural_turn",
    f"""{_TURNS} {_gap_sql(500, source="big")}
    SELECT file_id, island, min(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM i GROUP BY file_id, island
    UNION ALL SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, speaker, pos), speaker, start_ms, end_ms, 1 FROM nt WHERE n < 3""",
)
def win_natural_turn(spark: SparkSession, sf: str) -> DataFrame:
    """Back-channels inside turns relabelled, then neighbours of one speaker within half a second merged; files under three segments stay as they are."""
    d = diar(spark, sf).drop("event_type")
    named = natural_turns(d, timed_words(spark, sf))
    full = d.groupBy("file_id").count().where("count > 2").select("file_id")
    merged = gap_merge(named.join(full, "file_id", "left_semi"), 500)
    few = named.join(full, "file_id", "left_anti").withColumn("island", F.row_number().over(Window.partitionBy("file_id").orderBy(*ORDER)).cast("bigint"))
    rows = merged.unionByName(few.select(*merged.columns))
    return rows.groupBy("file_id", "island").agg(F.min("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"))


def short_words(spark: SparkSession, sf: str) -> DataFrame:
    return diar(spark, sf).select("file_id", "pos", "speaker", "start_ms", F.least("end_ms", F.col("start_ms") + 400).alias("end_ms"), (F.col("pos") % 3 != 0).alias("inside"))


_SHORT = """d AS (SELECT user_id // 3 AS file_id, event_id AS pos, user_id % 3 AS speaker, s AS start_ms, least(s + 1 + greatest(CAST(floor(value * 100) AS BIGINT), 0), s + 400) AS end_ms, event_id % 3 <> 0 AS inside,
  row_number() OVER (PARTITION BY user_id // 3 ORDER BY s, event_id) AS r FROM (SELECT *, (epoch_us(ts) - 1704067200000000) // 4000000 AS s FROM events))"""
_BOUNDARY = {
    "lead": "CASE WHEN a.r > 0 AND x.speaker <> a.who AND x.start_ms - a.end_ms < 300 AND NOT x.inside THEN a.who ELSE x.speaker END",
    "trail": "CASE WHEN a.r > 0 AND x.speaker = a.who AND b.speaker <> x.speaker AND NOT x.inside THEN b.speaker ELSE x.speaker END",
}


def _boundary_sql(rule: str) -> str:
    return f"""WITH RECURSIVE {_SHORT},
    s AS (SELECT file_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS who, CAST(NULL AS BIGINT) AS start_ms, CAST(NULL AS BIGINT) AS end_ms, CAST(NULL AS BOOLEAN) AS inside, CAST(NULL AS BIGINT) AS pos FROM (SELECT DISTINCT file_id FROM d)
      UNION ALL SELECT x.file_id, x.r, coalesce({_BOUNDARY[rule]}, x.speaker), x.start_ms, x.end_ms, x.inside, x.pos FROM s a JOIN d x ON x.file_id = a.file_id AND x.r = a.r + 1 LEFT JOIN d b ON b.file_id = x.file_id AND b.r = x.r + 1)
    SELECT file_id, pos, who AS speaker, start_ms, end_ms, inside FROM s WHERE r > 0"""


@query("win_continuity", _boundary_sql("lead"))
def win_continuity(spark: SparkSession, sf: str) -> DataFrame:
    """Leading words of a block that belong to the one before move there."""
    return scans.move_boundary_words(short_words(spark, sf), rules=("lead",))


@query("win_trailing_word", _boundary_sql("trail"))
def win_trailing_word(spark: SparkSession, sf: str) -> DataFrame:
    """Last words of a block outside their speaker's diarization move to the next."""
    return scans.move_boundary_words(short_words(spark, sf), rules=("trail",))


@query("fn_chunk_plan")
def fn_chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks near 30 s cut at silences."""
    return scans.plan_chunks(segs(spark, sf))


@query(
    "fn_chunk_lines",
    """WITH RECURSIVE l AS (SELECT conv_id AS f, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    c AS (SELECT f, CAST(-1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS z, n, CAST(0 AS BIGINT) AS nxt FROM (SELECT DISTINCT f, n FROM l)
      UNION ALL SELECT f, k + 1, nxt, z2, n, CASE WHEN z2 = n THEN n ELSE greatest(z2 - 5, nxt + 1) END FROM (
        SELECT c.f, c.k, c.nxt, c.n, greatest((SELECT count(*) FROM l WHERE l.f = c.f AND l.upto - coalesce((SELECT upto FROM l q WHERE q.f = c.f AND q.i = c.nxt - 1), 0) <= 12000), c.nxt + 1) AS z2 FROM c WHERE c.nxt < c.n))
    SELECT f AS file_id, k AS chunk_no, a AS first_line, z AS after_line FROM c WHERE k >= 0""",
)
def fn_chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Transcript lines packed for a model."""
    return scans.pack_lines(table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("pos"), F.length("text").cast("bigint").alias("n_chars")))


@query("fn_suspect_spans")
def fn_suspect_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of suspect words in the turns' texts."""
    w = words(spark, sf).where("k < 20").groupBy("file_id", F.col("seg_no").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("suspects"))
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("pos"), "text")
    return scans.suspect_spans(t.join(w, ["file_id", "pos"]))


def turn_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("pos"), F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))


@query("fn_words_match")
def fn_words_match(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring words that match, by ratio where the cheap tests leave it open."""
    w = words(spark, sf, following=True).select("file_id", "pos", F.lower("text").alias("a"), F.lower("following").alias("b"))
    return alignment.words_match(w, "a", "b").select("file_id", "pos", "hit")


@query("fn_fuzzy_score")
def fn_fuzzy_score(spark: SparkSession, sf: str) -> DataFrame:
    """Score of a phrase in benchmark texts: contained, contained without accents, else by ratio."""
    from ..functions.text import unaccent

    t = table(spark, sf, "benchmark").select("item_id", "text").withColumn("q", F.lit("tionéa"))
    sure = F.when(F.contains(F.lower("text"), F.col("q")), 1.0).when(F.contains(unaccent(F.col("text")), unaccent(F.col("q"))), 0.9)
    known = t.withColumn("score", sure)
    rest = known.where("score is null").withColumn("score", alignment.ratio(F.lower("text"), F.col("q")))
    return known.where("score is not null").unionByName(rest).select("item_id", "score")


def chunked(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as overlapping chunks of 40 words every 30, 300 ms a word, with probabilities."""
    w = turn_words(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.size("w") - 1) / 30), F.lit(0)).cast("int"))))
    c = w.select((F.col("file_id") * 1000 + F.col("pos")).alias("file_id"), F.col("i").cast("bigint").alias("chunk_no"), F.slice("w", F.col("i") * 30 + 1, F.lit(40)).alias("words"))
    return c.withColumn("probs", F.transform("words", lambda x, i: (i * 7 + F.col("chunk_no") * 3) % 10 / 10))


@query("aln_overlap")
def aln_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Best shift at each boundary of overlapping chunks; every fourth chunk lost its place, so that probability decides."""
    pairs = F.transform(F.arrays_zip("words", "probs"), lambda x: F.struct(x["words"].alias("text"), x["probs"].alias("prob")))
    c = chunked(spark, sf).withColumn("x", F.when(F.col("chunk_no") % 4 == 3, F.reverse(pairs)).otherwise(pairs))
    c = c.withColumn("tail", F.lag("x").over(Window.partitionBy("file_id").orderBy("chunk_no")))
    return alignment.overlaps(c.where("tail is not null").select("file_id", "chunk_no", "tail", F.col("x").alias("head")))


@query("aln_merge_chunks", "SELECT conv_id * 1000 + turn AS file_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS BIGINT) AS n_words, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), ' ') AS text FROM conversations")
def aln_merge_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping chunks folded back: the turn's words, each once."""
    return alignment.merge_chunks(chunked(spark, sf))


def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """Two hypotheses of each turn: the second lacks, doubles or changes some words."""
    w = words(spark, sf).withColumn("conf", F.col("k") / 100.0)
    item = F.when(F.col("k") % 19 == 0, F.lit(None)).otherwise(F.struct("pos", "text", "start_ms", "conf"))
    other = F.when(F.col("k") % 17 == 0, F.lit(None)).otherwise(F.struct("pos", F.when(F.col("k") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"), "start_ms", (1 - F.col("conf")).alias("conf")))
    g = w.withColumn("x", item).withColumn("y", other).groupBy("file_id", F.col("seg_no").alias("pos")).agg(F.array_sort(F.collect_list("x")).alias("a"), F.array_sort(F.collect_list("y")).alias("b"))
    return g


@query("set_chunk_union", "SELECT conv_id * 1000 + turn AS file_id, CAST(w.i AS BIGINT) AS pos, w.x AS word FROM (SELECT conv_id, turn, unnest(list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), lambda x, i: {'x': x, 'i': i})) AS w FROM conversations)")
def set_chunk_union(spark: SparkSession, sf: str) -> DataFrame:
    """Words of successive chunks as one list: chunks appended, what they share kept once."""
    merged = alignment.merge_chunks(chunked(spark, sf)).where("n_words > 0")
    return merged.select("file_id", F.posexplode(F.split("text", " ")).alias("i", "word")).select("file_id", (F.col("i") + 1).cast("bigint").alias("pos"), "word")


@query("aln_rover")
def aln_rover(spark: SparkSession, sf: str) -> DataFrame:
    """Vote of two hypotheses."""
    return alignment.rover(hypotheses(spark, sf), HOT)


@query("aln_disagree")
def aln_disagree(spark: SparkSession, sf: str) -> DataFrame:
    """Words on which two hypotheses differ."""
    texts = lambda c: F.transform(c, lambda x: x["text"])
    return alignment.disagreements(hypotheses(spark, sf).select("file_id", "pos", texts("a").alias("a"), texts("b").alias("b")))


@query("aln_sentence")
def aln_sentence(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of each turn mapped to its words."""
    t = turn_words(spark, sf).join(table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("pos"), sentences(F.col("text")).alias("sentences")), ["file_id", "pos"])
    return alignment.align_sentences(t.select((F.col("file_id") * 1000 + F.col("pos")).alias("file_id"), F.col("w").alias("words"), "sentences"))


@query("aln_chunk_tokens", "SELECT conv_id AS file_id, turn AS pos, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), ' ') AS text FROM conversations")
def aln_chunk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token chunks of 56 every 40 joined at their overlaps: the turn's tokens, each once."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("w") - 56) / 40), F.lit(0)).cast("int"))
    return alignment.merge_token_chunks(turn_words(spark, sf).select("file_id", "pos", F.transform(starts, lambda i: F.slice("w", i * 40 + 1, F.lit(56))).alias("chunks")))


@query(
    "aln_beam",
    """WITH RECURSIVE e AS (SELECT user_id AS u, event_id, CAST(abs(floor(value * 100)) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events),
    t AS (SELECT u, f, k AS token, CAST((event_id * (k + 3) * 7919 + v * (k + 1) * 101) % 10007 AS DOUBLE) / 2500 AS cost FROM e, (VALUES (0), (1), (2), (3), (4), (5)) AS x(k)),
    s AS (SELECT u, CAST(0 AS BIGINT) AS f, CAST(0 AS DOUBLE) AS cost, CAST([] AS BIGINT[]) AS tokens, CAST([] AS BIGINT[]) AS spots, CAST(1 AS BIGINT) AS place FROM (SELECT DISTINCT u FROM e)
      UNION ALL SELECT u, f, min(low) - ln(sum(exp(low - cost))), tokens, arg_min(spots, rn), min(rn) FROM (
        SELECT *, min(cost) OVER (PARTITION BY u, tokens) AS low FROM (
          SELECT t.u, t.f, s.cost + t.cost AS cost, CASE WHEN token = 0 THEN s.tokens ELSE list_append(s.tokens, CAST(token AS BIGINT)) END AS tokens, CASE WHEN token = 0 THEN s.spots ELSE list_append(s.spots, t.f) END AS spots,
            row_number() OVER (PARTITION BY t.u ORDER BY s.cost + t.cost, s.place, token) AS rn FROM s JOIN t ON t.u = s.u AND t.f = s.f + 1) WHERE rn <= 4) GROUP BY u, f, tokens),
    l AS (SELECT u, max(f) AS f FROM e GROUP BY u)
    SELECT u AS user_id, array_to_string(tokens, ',') AS tokens, array_to_string(spots, ',') AS frames, round(cost / (2 + len(tokens)), 6) AS mean_cost FROM s JOIN l USING (u, f)
    QUALIFY row_number() OVER (PARTITION BY u ORDER BY cost / (2 + len(tokens)), place) = 1""",
)
def aln_beam(spark: SparkSession, sf: str) -> DataFrame:
    """The best token history of each user's frames over a table of six costs a frame, four hypotheses wide."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events").select("user_id", "event_id", F.abs(F.floor(F.col("value") * 100)).alias("v"), F.row_number().over(w).alias("frame"))
    t = e.withColumn("token", F.explode(F.sequence(F.lit(0), F.lit(5))))
    mixed = F.col("event_id") * (F.col("token") + 3) * 7919 + F.col("v") * (F.col("token") + 1) * 101
    best = beam_search(t.withColumn("cost", (mixed % 10007).cast("double") / 2500), "user_id", 4)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return best.select("user_id", joined("tokens").alias("tokens"), joined("at").alias("frames"), F.round(F.col("cost") / (2 + F.size("tokens")), 6).alias("mean_cost"))


HOT = ("the of", "der die", "und")
PHRASES = {("der", "die"): 1.5, ("die", "und"): 2.0, ("the", "of", "the"): 1.0, ("of",): 0.5}


@query("aln_trie")
def aln_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Context scores of all turns against a list of phrases."""
    t = turn_words(spark, sf).select("file_id", "pos", F.transform("w", F.lower).alias("tokens"))
    return t.select("file_id", "pos", alignment.phrase_scores(t, PHRASES).alias("score"))


@query("fn_hotword_ratio")
def fn_hotword_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a turn's words that touch a hot phrase, with three words of the turns before and after as context."""
    w = Window.partitionBy("file_id").orderBy("pos")
    none = F.array().cast("array<string>")
    t = turn_words(spark, sf).withColumns({"p": F.coalesce(F.lag("w").over(w), none), "n": F.coalesce(F.lead("w").over(w), none)}).where(F.size("w") > 0)
    last = F.slice("p", F.greatest(F.size("p") - 2, F.lit(1)), F.lit(3))
    return alignment.hot_shares(t.select("file_id", "pos", "w", last.alias("before"), F.slice("n", 1, 3).alias("after")), HOT)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings of 128 vectors each, so that their number grows with the table."""
    return table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 128).alias("file_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))


@query("clu_spectral")
def clu_spectral(spark: SparkSession, sf: str) -> DataFrame:
    """Speakers by spectral clustering."""
    return spectral.clusters(vectors(spark, sf))


@query("clu_spectral_long")
def clu_spectral_long(spark: SparkSession, sf: str) -> DataFrame:
    """Speakers of all vectors as one long recording, by a sparse neighbour matrix in pieces and its eigenvectors by block iteration."""
    return spectral.clusters(vectors(spark, sf).withColumn("file_id", F.lit(0).cast("bigint")), size=256)


@query("clu_density")
def clu_density(spark: SparkSession, sf: str) -> DataFrame:
    """Speakers of all vectors as one long recording, by the stable clusters of their density hierarchy; those of no dense place are noise."""
    return density.density_clusters(vectors(spark, sf).withColumn("file_id", F.lit(0).cast("bigint")))


@query("clu_merge_cos")
def clu_merge_cos(spark: SparkSession, sf: str) -> DataFrame:
    """Speakers by joining similar centroids."""
    return spectral.clusters(vectors(spark, sf), "merge")


@query("clu_ahc_vbx")
def clu_ahc_vbx(spark: SparkSession, sf: str) -> DataFrame:
    """Speakers by centroid linkage, then variational Bayes in the space of a model fitted to the labelled vectors."""
    fitted = variational.fit_projection(table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vec")))
    return variational.clusters(vectors(spark, sf), fitted)


@query("fn_affine", "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * ((i - 1) * 7 % 5 - 2))) + 0.5, 5) AS y0, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * ((i - 1) * 7 % 3 - 1))) - 0.5, 5) AS y1 FROM embeddings")
def fn_affine(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors through an affine map; the matrix is a literal, so the work stays inside the JVM."""
    from ..functions.vectors import dot

    row = lambda m, c: F.array(*(F.lit(float(i * 7 % m - c)) for i in range(64)))
    return table(spark, sf, "embeddings").select("vec_id", F.round(dot(F.col("embedding"), row(5, 2)) + 0.5, 5).alias("y0"), F.round(dot(F.col("embedding"), row(3, 1)) - 0.5, 5).alias("y1"))


def _endpoint_sql(speech: str, quiet: int, longest: int) -> str:
    """The endpoint machine as a recursive query: one row per stream and step."""
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id AS f, {speech} AS speech, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
    s AS (SELECT user_id, CAST(0 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS opened, CAST(-1 AS BIGINT) AS last, CAST(0 AS BIGINT) AS silent, CAST(0 AS BIGINT) AS frames, CAST(NULL AS BIGINT) AS o, CAST(NULL AS BIGINT) AS l, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT user_id, r, CASE WHEN why IS NOT NULL THEN -1 ELSE opened END, CASE WHEN why IS NOT NULL THEN -1 ELSE last END, CASE WHEN why IS NOT NULL THEN 0 ELSE silent END, CASE WHEN why IS NOT NULL THEN 0 ELSE frames END,
        CASE WHEN why IS NOT NULL THEN opened END, CASE WHEN why IS NOT NULL THEN last END, why FROM (
        SELECT *, CASE WHEN was >= 0 AND silent > {quiet} THEN 'silence' WHEN was >= 0 AND frames > {longest} THEN 'length' END AS why FROM (
          SELECT e.user_id, e.r, s.opened AS was, CASE WHEN s.opened < 0 THEN CASE WHEN speech THEN f ELSE -1 END ELSE s.opened END AS opened, CASE WHEN speech THEN f ELSE s.last END AS last,
            CASE WHEN s.opened < 0 OR speech THEN 0 ELSE s.silent + 1 END AS silent, CASE WHEN s.opened < 0 THEN CASE WHEN speech THEN 1 ELSE 0 END ELSE s.frames + 1 END AS frames
          FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)))
    SELECT user_id AS stream_id, o AS first_frame, l AS last_frame, reason FROM s WHERE reason IS NOT NULL"""


@query("str_endpoint_model", _endpoint_sql("event_type <> 'error'", 0, 12))
def str_endpoint_model(spark: SparkSession, sf: str) -> DataFrame:
    """Utterances whose end the model flags, or that grow too long: the same machine, a flag column, no quiet frames allowed."""
    e = read_stream(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame"), (F.col("event_type") != "error").alias("speech"))
    return drain(endpoints(e, quiet=0, longest=12))


@query("str_endpoint", _endpoint_sql("value >= 20", 2, 12))
def str_endpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Utterances of live streams, one per user: speech where the value is high."""
    e = read_stream(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame"), (F.col("value") >= 20).alias("speech"))
    return drain(endpoints(e, quiet=2, longest=12))


@query(
    "str_partial_final",
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS at_ms, event_type || props AS text, event_type = 'purchase' AS final, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events),
    s AS (SELECT user_id, CAST(0 AS BIGINT) AS r, '' AS shown, CAST(-1152921504606846976 AS BIGINT) AS sent, CAST(NULL AS BIGINT) AS at_ms, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS BOOLEAN) AS is_final FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT e.user_id, e.r, CASE WHEN final THEN '' WHEN e.text <> s.shown AND e.at_ms - s.sent >= 3600000 THEN e.text ELSE s.shown END, CASE WHEN final THEN -1152921504606846976 WHEN e.text <> s.shown AND e.at_ms - s.sent >= 3600000 THEN e.at_ms ELSE s.sent END,
        CASE WHEN final OR (e.text <> s.shown AND e.at_ms - s.sent >= 3600000) THEN e.at_ms END, e.text, final FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)
    SELECT user_id AS stream_id, at_ms, text, is_final FROM s WHERE at_ms IS NOT NULL""",
)
def str_partial_final(spark: SparkSession, sf: str) -> DataFrame:
    """Changed partials and finals of live streams."""
    at = F.expr("unix_millis(cast(ts as timestamp))")
    e = read_stream(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("stream_id"), at.alias("at_ms"), "event_id", F.concat("event_type", "props").alias("text"), (F.col("event_type") == "purchase").alias("is_final"))
    return drain(changed_partials(e, least=3_600_000))


@query("str_late", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS began, count(*) AS n FROM events GROUP BY began")
def str_late(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts over a stream with a watermark, from the stream's own updates: of each window the last one counts."""
    e = read_stream(spark, f"{sf}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    counted = e.groupBy(F.window("at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("began"), "n")
    return drain_updates(counted, ["began"])
