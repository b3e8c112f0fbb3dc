"""Text queries: normalisation, search, splitting, cleanup and JSON, over conversations, benchmark, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_punctuation, norm_word, occurrences, parse_llm_json, sentences, unaccent
from ..session import table
from .base import Group

query = Group()


def words(spark: SparkSession, sf: str, following: bool = False) -> DataFrame:
    """Words of every turn: file_id, seg_no, speaker, pos (from 1 in the file), text, times and confidences; with ``following``, the file's next word too.

    Counts of words are summed over turns without their texts and meet the texts in a hash join, so no task sorts or holds texts. Turns that share a number take turns word by word; they alone are grouped.
    """
    t = table(spark, sf, "conversations").where("text is not null")
    t = t.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_no"), F.col("role").alias("speaker"), "text")
    split = F.filter(F.split("text", " "), lambda x: x != "")
    counts = t.select("file_id", "seg_no", F.size(split).alias("n"), *([F.struct("speaker", F.get(split, F.lit(0)).alias("word")).alias("first")] if following else [])).where("n > 0")
    counts = counts.groupBy(F.col("file_id").alias("f"), F.col("seg_no").alias("s")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), *([F.min("first").alias("first")] if following else []))
    order = Window.partitionBy("f").orderBy("s")
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if following:
        counts = counts.withColumn("next", F.lead(F.col("first")["word"]).over(order))
    held = ["file_id", "seg_no", "before", *(["next"] if following else [])]
    met = t.join(counts.drop("n", "first").hint("shuffle_hash"), F.col("file_id").eqNullSafe(F.col("f")) & F.col("seg_no").eqNullSafe(F.col("s"))).withColumn("w", split)
    alone = met.where("rows = 1").select(*held, F.transform("w", lambda x: F.struct("speaker", x.alias("text"))).alias("words"))
    shared = met.where("rows > 1").groupBy(*held).agg(F.array_sort(F.collect_list(F.struct("speaker", "w"))).alias("rows"))
    dealt = F.flatten(F.transform("rows", lambda r, d: F.transform(r["w"], lambda x, i: F.struct(i.alias("i"), d.alias("d"), r["speaker"].alias("speaker"), x.alias("text")))))
    w = alone.unionByName(shared.select(*held, F.transform(F.array_sort(dealt), lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"))).alias("words")))
    if following:
        behind = F.slice(F.concat(F.slice(F.col("words")["text"], F.lit(2), F.size("words")), F.array("next")), F.lit(1), F.size("words"))
        w = w.withColumn("words", F.zip_with("words", behind, lambda x, y: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"), y.alias("following"))))
    w = w.select("file_id", "seg_no", "before", F.posexplode("words").alias("i", "x")).withColumn("pos", F.col("before") + F.col("i") + 1)
    k = (F.col("file_id") * 31 + F.col("pos") * 17) % 100
    more = [F.col("x.following")] if following else []
    return w.select("file_id", "seg_no", "x.speaker", "pos", "x.text", (300 * (F.col("pos") - 1)).alias("start_ms"), (300 * (F.col("pos") - 1) + 250).alias("end_ms"), k.alias("k"), *more)


WORDS = """words AS (SELECT *, 300 * (pos - 1) AS start_ms, 300 * (pos - 1) + 250 AS end_ms, (file_id * 31 + pos * 17) % 100 AS k FROM
  (SELECT file_id, seg_no, speaker, x.w AS text, row_number() OVER (PARTITION BY file_id ORDER BY seg_no, x.i) AS pos FROM
    (SELECT conv_id AS file_id, turn AS seg_no, role AS speaker, unnest(list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x, i: {'w': x, 'i': i})) AS x FROM conversations)))"""
FILLERS = ("à", "ờ", "ừ", "ơ", "uh", "um", "an", "la")  # fixed values: hesitations, and two words of the test texts


@query("flt_filler", f"WITH {WORDS} SELECT file_id, pos, text FROM words WHERE lower(text) NOT IN {FILLERS}")
def flt_filler(spark: SparkSession, sf: str) -> DataFrame:
    """Words without hesitations."""
    return words(spark, sf).where(~F.lower("text").isin(*FILLERS)).select("file_id", "pos", "text")


@query("fn_norm_word", f"WITH {WORDS} SELECT file_id, pos, regexp_replace(lower(trim(text)), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS norm FROM words")
def fn_norm_word(spark: SparkSession, sf: str) -> DataFrame:
    """Words for comparison."""
    return words(spark, sf).select("file_id", "pos", norm_word(F.col("text")).alias("norm"))


@query("fn_norm_align", f"WITH {WORDS} SELECT file_id, seg_no, regexp_replace(lower(string_agg(text, ' ' ORDER BY pos)), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS norm FROM words GROUP BY ALL")
def fn_norm_align(spark: SparkSession, sf: str) -> DataFrame:
    """Turns for alignment: letters and digits alone."""
    g = words(spark, sf).groupBy("file_id", "seg_no").agg(F.expr("listagg(text, ' ') within group (order by pos)").alias("t"))
    return g.select("file_id", "seg_no", norm_word(F.col("t")).alias("norm"))


@query("fn_norm_vi", "SELECT doc_id, strip_accents(replace(lower(text), 'đ', 'd')) AS norm FROM documents")
def fn_norm_vi(spark: SparkSession, sf: str) -> DataFrame:
    """Texts lower-cased without accents."""
    return table(spark, sf, "documents").select("doc_id", unaccent(F.col("text")).alias("norm"))


@query("fn_words_match_native", f"WITH {WORDS}, n AS (SELECT file_id, pos, lower(text) AS a, lower(lead(text) OVER (PARTITION BY file_id ORDER BY pos)) AS b FROM words) SELECT file_id, pos, coalesce(a <> '' AND b <> '' AND (a = b OR (length(a) > 2 AND length(b) > 2 AND (contains(a, b) OR contains(b, a)))), false) AS hit FROM n")
def fn_words_match_native(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring words that are equal, or of which one holds the other: the legs without a ratio."""
    w = words(spark, sf, following=True).select("file_id", "pos", F.lower("text").alias("a"), F.lower("following").alias("b"))
    hit = (F.col("a") != "") & (F.col("b") != "") & ((F.col("a") == F.col("b")) | ((F.length("a") > 2) & (F.length("b") > 2) & (F.contains("a", "b") | F.contains("b", "a"))))
    return w.select("file_id", "pos", F.coalesce(hit, F.lit(False)).alias("hit"))


NEEDLE = "eré"
_AT = "unnest(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, length('{n}')) = '{n}'))"


@query(
    "fn_find_matches",
    f"""WITH x AS (SELECT conv_id, turn, {_AT.format(n=NEEDLE)} AS place, 1.0::DOUBLE AS score FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)
    UNION ALL SELECT conv_id, turn, {_AT.format(n='ere')} AS place, 0.9::DOUBLE AS score FROM (SELECT conv_id, turn, strip_accents(replace(lower(text), 'đ', 'd')) AS t FROM conversations))
    SELECT conv_id, turn, place, max(score) AS score FROM x GROUP BY conv_id, turn, place""",
)
def fn_find_matches(spark: SparkSession, sf: str) -> DataFrame:
    """All places of a phrase, exact ones before those without accents, each place once."""
    t = table(spark, sf, "conversations")
    exact = t.select("conv_id", "turn", F.explode(occurrences(F.lower("text"), F.lit(NEEDLE))).alias("place"), F.lit(1.0).alias("score"))
    loose = t.select("conv_id", "turn", F.explode(occurrences(unaccent(F.col("text")), unaccent(F.lit(NEEDLE)))).alias("place"), F.lit(0.9).alias("score"))
    return exact.unionByName(loose).groupBy("conv_id", "turn", F.col("place").cast("bigint").alias("place")).agg(F.max("score").alias("score"))


CROSS = ". th"


@query(
    "fn_search_cross",
    f"""WITH o AS (SELECT conv_id, turn, text, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS b, length(text) AS n FROM conversations),
    f AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn)) AS t FROM conversations GROUP BY conv_id),
    m AS (SELECT conv_id, {_AT.format(n=CROSS)} AS p FROM f),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY p) AS match_no FROM m)
    SELECT r.conv_id, o.turn, r.match_no, CAST(greatest(r.p, o.b) - o.b + 1 AS BIGINT) AS first_char, CAST(least(r.p + {len(CROSS)}, o.b + o.n) - greatest(r.p, o.b) AS BIGINT) AS n_chars
    FROM r JOIN o ON o.conv_id = r.conv_id AND r.p < o.b + o.n AND o.b < r.p + {len(CROSS)}""",
)
def fn_search_cross(spark: SparkSession, sf: str) -> DataFrame:
    """A phrase over turns joined by blanks: one row per turn that a match touches, under one match number.

    Every turn searches itself with the few characters beside it, so no conversation is held as one text.
    """
    n = len(CROSS)
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.lower("text").alias("t"), F.length("text").alias("n"))
    b = (F.sum(F.col("n") + 1).over(w) - F.col("n")).alias("b")
    after = F.concat_ws(" ", *(F.substring(F.lead("t", k).over(w), 1, n) for k in (1, 2, 3)))
    own = t.select("conv_id", "turn", "n", b, F.concat_ws(" ", "t", F.when(F.length(after) > 0, F.substring(after, 1, n))).alias("x"))
    at = F.filter(occurrences(F.col("x"), F.lit(CROSS)), lambda i: i <= F.col("n") + 1)
    m = own.select("conv_id", "b", F.explode(at).alias("i")).select("conv_id", (F.col("i") + F.col("b") - 1).alias("at")).distinct().withColumn("match_no", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("at")).cast("bigint"))
    spans = own.select(F.col("conv_id").alias("c"), "turn", "b", "n")
    hit = (F.col("conv_id") == F.col("c")) & (F.col("at") < F.col("b") + F.col("n")) & (F.col("b") < F.col("at") + n)
    lo = F.greatest("at", "b")
    return m.join(spans, hit).select("conv_id", "turn", "match_no", (lo - F.col("b") + 1).alias("first_char"), (F.least(F.col("at") + n, F.col("b") + F.col("n")) - lo).alias("n_chars"))


@query("fn_sent_split", "SELECT doc_id, CAST(i AS BIGINT) AS i, s FROM (SELECT doc_id, unnest(list_transform(string_split(regexp_replace(text, '([.?!])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x, k: {'s': x, 'i': k}), recursive := true) FROM documents)")
def fn_sent_split(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every document."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("i", "s")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("i"), "s")


@query("fn_comma_split", "SELECT conv_id, turn, CAST(i AS BIGINT) AS i, s FROM (SELECT conv_id, turn, unnest(list_transform(string_split(regexp_replace(text, ',[ \\t\\n\\x0B\\f\\r]+', ',' || chr(1), 'g'), chr(1)), lambda x, k: {'s': x, 'i': k}), recursive := true) FROM conversations)")
def fn_comma_split(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses of every turn: cuts at white space behind commas."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"(?<=,)\s+")).alias("i", "s"))
    return t.select("conv_id", "turn", (F.col("i") + 1).cast("bigint").alias("i"), "s")


@query(
    "fn_split_long",
    """WITH w AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS total, trim(text, ' \t\n' || chr(11) || chr(12) || chr(13)) AS text FROM conversations),
    c AS (SELECT conv_id, turn, total, unnest(list_transform(CASE WHEN total * 300 > 12000 THEN string_split(regexp_replace(text, ',[ \\t\\n\\x0B\\f\\r]+', ',' || chr(1), 'g'), chr(1)) ELSE [text] END, lambda x, i: {'s': x, 'c': i}), recursive := true) FROM w),
    n AS (SELECT conv_id, turn, c, list_filter(regexp_split_to_array(s, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM c),
    o AS (SELECT *, len(w) AS n, CAST(sum(len(w)) OVER (PARTITION BY conv_id, turn ORDER BY c) - len(w) AS BIGINT) AS before FROM n WHERE len(w) > 0),
    k AS (SELECT *, CASE WHEN n * 300 <= 12000 THEN 1 WHEN n * 300 % 12000 = 0 THEN greatest(n * 300 // 12000, 2) ELSE n * 300 // 12000 + 1 END AS k FROM o)
    SELECT conv_id, turn, CAST(c AS BIGINT) AS clause, i AS part, array_to_string(w[CAST(i * (n // k) + least(i, n % k) + 1 AS BIGINT):CAST((i + 1) * (n // k) + least(i + 1, n % k) AS BIGINT)], ' ') AS text, 300 * (before + i * (n // k) + least(i, n % k)) AS start_ms, 300 * (before + (i + 1) * (n // k) + least(i + 1, n % k)) AS end_ms FROM k, LATERAL (SELECT unnest(range(k)) AS i)""",
)
def fn_split_long(spark: SparkSession, sf: str) -> DataFrame:
    """Turns over 12 s cut behind commas first, then clauses still over it into parts of nearly equal words; times by words.

    Parts never overlap, since a word's time follows from its place.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    t = table(spark, sf, "conversations").withColumn("text", F.trim("text", F.lit(" \t\n\x0b\x0c\r")))
    clauses = F.when(F.size(split("text")) * 300 > 12000, F.split("text", r"(?<=,)\s+")).otherwise(F.array("text"))
    c = t.select("conv_id", "turn", F.posexplode(clauses).alias("c", "s")).withColumn("w", split("s")).withColumn("n", F.size("w").cast("bigint")).where("n > 0")
    before = F.sum("n").over(Window.partitionBy("conv_id", "turn").orderBy("c")) - F.col("n")
    d = F.col("n") * 300
    k = F.when(d <= 12000, F.lit(1)).when(d % 12000 == 0, F.greatest(F.floor(d / 12000), F.lit(2))).otherwise(F.floor(d / 12000) + 1)
    p = c.withColumns({"before": before, "k": k.cast("bigint")}).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    q, r = F.floor(F.col("n") / F.col("k")), F.col("n") % F.col("k")
    a, b = F.col("part") * q + F.least("part", r), (F.col("part") + 1) * q + F.least(F.col("part") + 1, r)
    text = F.array_join(F.slice("w", (a + 1).cast("int"), (b - a).cast("int")), " ")
    return p.select("conv_id", "turn", (F.col("c") + 1).cast("bigint").alias("clause"), "part", text.alias("text"), (300 * (F.col("before") + a)).alias("start_ms"), (300 * (F.col("before") + b)).alias("end_ms"))


_DIRTY = "replace(replace(replace(text, ' th', ', th'), '. ', ' ,. '), ' la ', ' : la,, ')"
_SENT = "string_split(regexp_replace({t}, '([.?!])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))"


@query(
    "fn_punct_clean",
    f"""WITH a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(replace({_DIRTY}, ':', ' '), ',+', ',', 'g'), '\\.{{4,}}', '...', 'g'), ',[ \\t\\n\\x0B\\f\\r]*\\.', '.', 'g') AS t FROM conversations),
    b AS (SELECT conv_id, turn, array_to_string(list_transform({_SENT.format(t='t')}, lambda s: CASE WHEN len(list_filter(regexp_split_to_array(s, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) < 8 AND length(s) - length(replace(s, ',', '')) > 1
      THEN split_part(s, ',', 1) || ',' || replace(substr(s, length(split_part(s, ',', 1)) + 2), ',', '') ELSE s END), ' ') AS t FROM a),
    c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([,.!?])([^ \\t\\n\\x0B\\f\\r])', '\\1 \\2', 'g'), '[ \\t\\n\\x0B\\f\\r]+([,.!?])', '\\1', 'g'), '^,[ \\t\\n\\x0B\\f\\r]*', ''), '\\.[ \\t\\n\\x0B\\f\\r]*,', '. ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS t FROM b)
    SELECT conv_id, turn, trim(array_to_string(list_transform({_SENT.format(t='t')}, lambda s: upper(substr(s, 1, 1)) || substr(s, 2)), ' ')) AS text FROM c""",
)
def fn_punct_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Restored punctuation cleaned up."""
    return table(spark, sf, "conversations").select("conv_id", "turn", clean_punctuation(F.expr(_DIRTY)).alias("text"))


@query(
    "fn_case",
    f"""WITH {WORDS} SELECT file_id, pos, CASE k % 5 WHEN 0 THEN lower(text) WHEN 1 THEN upper(text) WHEN 2 THEN upper(substr(text, 1, 1)) || lower(substr(text, 2))
    WHEN 3 THEN substr(text, 1, 1) || upper(substr(text, 2, 1)) || lower(substr(text, 3)) ELSE upper(substr(text, 1, length(text) - 1)) || substr(text, length(text)) END AS text FROM (SELECT file_id, pos, k, replace(text, 'ß', 'ss') AS text FROM words)""",
)
def fn_case(spark: SparkSession, sf: str) -> DataFrame:
    """Words under the five case transforms."""
    t = F.replace("text", F.lit("ß"), F.lit("ss"))
    n = F.length(t)
    rest = lambda i: F.substring(t, i, 1 << 30)
    case = F.when(F.col("k") % 5 == 0, F.lower(t)).when(F.col("k") % 5 == 1, F.upper(t)).when(F.col("k") % 5 == 2, F.concat(F.upper(F.substring(t, 1, 1)), F.lower(rest(2))))
    case = case.when(F.col("k") % 5 == 3, F.concat(F.substring(t, 1, 1), F.upper(F.substring(t, 2, 1)), F.lower(rest(3)))).otherwise(F.concat(F.upper(F.substring(t, F.lit(1), n - 1)), F.substring(t, n, F.lit(1))))
    return words(spark, sf).select("file_id", "pos", case.alias("text"))


@query(
    "fn_apply_edits",
    f"""WITH {WORDS}, e AS (SELECT *, CASE WHEN k % 7 = 0 AND NOT ends_with(text, '.') THEN text || ' .' WHEN k % 5 = 0 THEN upper(replace(text, 'ß', 'ss')) ELSE text END AS t FROM words)
    SELECT file_id, seg_no, string_agg(t, ' ' ORDER BY pos) AS text FROM e GROUP BY ALL""",
)
def fn_apply_edits(spark: SparkSession, sf: str) -> DataFrame:
    """One edit at most per token (append or transform) applied and joined; no mark is appended twice."""
    edit = F.when((F.col("k") % 7 == 0) & ~F.endswith("text", F.lit(".")), F.concat("text", F.lit(" ."))).when(F.col("k") % 5 == 0, F.upper(F.replace("text", F.lit("ß"), F.lit("ss")))).otherwise(F.col("text"))
    return words(spark, sf).withColumn("t", edit).groupBy("file_id", "seg_no").agg(F.expr("listagg(t, ' ') within group (order by pos)").alias("text"))


@query(
    "fn_other_transforms",
    f"WITH {WORDS} SELECT file_id, pos, CASE k % 3 WHEN 0 THEN CASE WHEN ends_with(text, 's') THEN text ELSE text || 's' END WHEN 1 THEN replace(text, 'er', 'er-') ELSE replace(text, '-', ' ') END AS text FROM words",
)
def fn_other_transforms(spark: SparkSession, sf: str) -> DataFrame:
    """Plural, hyphen split and hyphen join."""
    t = F.col("text")
    out = F.when(F.col("k") % 3 == 0, F.when(F.endswith(t, F.lit("s")), t).otherwise(F.concat(t, F.lit("s")))).when(F.col("k") % 3 == 1, F.replace(t, F.lit("er"), F.lit("er-"))).otherwise(F.replace(t, F.lit("-"), F.lit(" ")))
    return words(spark, sf).select("file_id", "pos", out.alias("text"))


_LABEL = "CASE k % 6 WHEN 0 THEN '$APPEND_,' WHEN 1 THEN '$APPEND_.' WHEN 2 THEN '$TRANSFORM_CASE_UPPER' WHEN 3 THEN '$REPLACE_x' WHEN 4 THEN '$APPEND_x' ELSE '$KEEP' END"


@query("fn_action_filter", f"WITH {WORDS} SELECT file_id, pos, label FROM (SELECT file_id, pos, {_LABEL} AS label FROM words) WHERE regexp_full_match(label, '\\$APPEND_[,.?!]|\\$TRANSFORM_CASE_.*')")
def fn_action_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Punctuation appends and case transforms alone."""
    return words(spark, sf).select("file_id", "pos", F.expr(_LABEL).alias("label")).where(F.col("label").rlike(r"^(\$APPEND_[,.?!]|\$TRANSFORM_CASE_.*)$"))


@query(
    "fn_label_nudge",
    """WITH p AS (SELECT vec_id, abs(embedding[1]) AS keep, abs(embedding[2]) AS comma, abs(embedding[3]) AS period, vec_id % 13 / 10.0 AS gap FROM embeddings),
    n AS (SELECT vec_id, gap, keep + CASE WHEN keep >= comma AND keep >= period AND gap >= 1 THEN -0.2 ELSE 0 END AS keep,
      comma + CASE WHEN keep >= comma AND keep >= period AND gap >= 0.2 AND gap < 1 THEN 0.2 WHEN gap < 0.1 THEN -0.3 ELSE 0 END AS comma, period + CASE WHEN keep >= comma AND keep >= period AND gap >= 1 THEN 0.2 ELSE 0 END AS period FROM p)
    SELECT vec_id, CASE WHEN keep >= comma AND keep >= period THEN 'keep' WHEN comma >= period THEN 'comma' ELSE 'period' END AS label FROM n""",
)
def fn_label_nudge(spark: SparkSession, sf: str) -> DataFrame:
    """Label probabilities nudged by pauses, then the largest."""
    e = lambda i: F.abs(F.get("embedding", F.lit(i)))
    p = table(spark, sf, "embeddings").select("vec_id", e(0).alias("keep"), e(1).alias("comma"), e(2).alias("period"), (F.col("vec_id") % 13 / F.lit(10.0)).alias("gap"))
    kept = (F.col("keep") >= F.col("comma")) & (F.col("keep") >= F.col("period"))
    long = kept & (F.col("gap") >= 1)
    n = p.select(
        "vec_id", (F.col("keep") + F.when(long, -0.2).otherwise(0.0)).alias("keep"),
        (F.col("comma") + F.when(kept & (F.col("gap") >= 0.2) & (F.col("gap") < 1), 0.2).when(F.col("gap") < 0.1, -0.3).otherwise(0.0)).alias("comma"), (F.col("period") + F.when(long, 0.2).otherwise(0.0)).alias("period"),
    )
    label = F.when((F.col("keep") >= F.col("comma")) & (F.col("keep") >= F.col("period")), "keep").when(F.col("comma") >= F.col("period"), "comma").otherwise("period")
    return n.select("vec_id", label.alias("label"))


@query(
    "fn_chunk_tokens",
    """WITH n AS (SELECT conv_id, turn, CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM conversations),
    k AS (SELECT *, CASE WHEN n <= 56 THEN 1 WHEN n < 96 THEN 2 ELSE (n - 16 + 39) // 40 END AS c FROM n)
    SELECT conv_id, turn, i AS chunk, CASE WHEN n <= 56 THEN 0 WHEN n < 96 THEN i * ((n + 17) // 2 - 16) ELSE i * 40 END AS first,
    CASE WHEN n <= 56 THEN n WHEN n < 96 THEN CASE i WHEN 0 THEN (n + 17) // 2 ELSE n END ELSE least(i * 40 + 56, n) END AS after FROM k, range(1000) r(i) WHERE i < c""",
)
def fn_chunk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token windows: one up to 56, two halves that share 16 below 96, else 56 every 40."""
    n = F.col("n")
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).cast("bigint").alias("n"))
    count = F.when(n <= 56, F.lit(1)).when(n < 96, F.lit(2)).otherwise(F.ceil((n - 16) / 40)).cast("bigint")
    t = t.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    i, half = F.col("chunk"), F.floor((n + 17) / 2)
    first = F.when(n <= 56, F.lit(0)).when(n < 96, i * (half - 16)).otherwise(i * 40)
    after = F.when(n <= 56, n).when(n < 96, F.when(i == 0, half).otherwise(n)).otherwise(F.least(i * 40 + 56, n))
    return t.select("conv_id", "turn", "chunk", first.cast("bigint").alias("first"), after.cast("bigint").alias("after"))


@query(
    "fn_chunk_even",
    """WITH d AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) * 16 AS n FROM lineitem),
    k AS (SELECT *, CASE WHEN n <= 480000 THEN 1 ELSE (n + 479999) // 480000 END AS c FROM d), s AS (SELECT *, CASE WHEN c = 1 THEN n ELSE (n + (c - 1) * 48000) // c END AS len FROM k)
    SELECT l_orderkey, l_linenumber, i AS chunk, i * (len - 48000) AS first, CASE WHEN i = c - 1 THEN n ELSE least(i * (len - 48000) + len, n) END AS after FROM s, range(40) r(i) WHERE i < c""",
)
def fn_chunk_even(spark: SparkSession, sf: str) -> DataFrame:
    """Long regions cut into equal chunks of at most 30 s that share 3 s."""
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.floor("l_extendedprice").cast("bigint") * 16).alias("n"))
    d = d.withColumn("c", F.when(F.col("n") <= 480000, F.lit(1)).otherwise(F.ceil(F.col("n") / 480000)).cast("bigint"))
    d = d.withColumn("len", F.when(F.col("c") == 1, F.col("n")).otherwise(F.floor((F.col("n") + (F.col("c") - 1) * 48000) / F.col("c")))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)))
    first = F.col("chunk") * (F.col("len") - 48000)
    return d.select("l_orderkey", "l_linenumber", "chunk", first.alias("first"), F.when(F.col("chunk") == F.col("c") - 1, F.col("n")).otherwise(F.least(first + F.col("len"), F.col("n"))).alias("after"))


@query(
    "fn_fmt_line",
    """SELECT conv_id, turn, '[' || lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || '] ' || role || ' (' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '): ' || trim(text) AS line
    FROM (SELECT *, turn * 47 AS s FROM conversations) WHERE trim(text) <> ''""",
)
def fn_fmt_line(spark: SparkSession, sf: str) -> DataFrame:
    """Transcript lines with clock, speaker and number; empty texts take no number."""
    t = table(spark, sf, "conversations").where(F.trim("text") != "").withColumn("s", F.col("turn") * 47)
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    no = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("string")
    line = F.concat(F.lit("["), two(F.floor(F.col("s") / 3600)), F.lit(":"), two(F.floor(F.col("s") / 60) % 60), F.lit(":"), two(F.col("s") % 60), F.lit("] "), "role", F.lit(" ("), no, F.lit("): "), F.trim("text"))
    return t.select("conv_id", "turn", line.alias("line"))


_REPLY = """CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '<think>x {y</think> ' || props WHEN 2 THEN 'Here: ```json ' || props || ' ``` done' WHEN 3 THEN 'It is ' || props || ' so' ELSE 'none' END"""


@query("fn_parse_json", f"SELECT event_id, CASE WHEN event_id % 5 = 4 THEN '{{}}' ELSE props END AS parsed, TRY_CAST(CASE WHEN event_id % 5 < 4 THEN props ->> '$.k' END AS BIGINT) AS k FROM (SELECT *, {_REPLY} AS r FROM events)")
def fn_parse_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON out of model replies: plain, behind thinking, fenced, or inside prose; else an empty object."""
    parsed = table(spark, sf, "events").select("event_id", parse_llm_json(F.expr(_REPLY)).alias("parsed"))
    return parsed.select("event_id", "parsed", F.get_json_object("parsed", "$.k").cast("bigint").alias("k"))


@query("fn_valid_refs", "SELECT conv_id, max_ref, list_filter([turn0, max_ref, max_ref + 1, -1], lambda r: r >= 0 AND r <= max_ref) AS refs, coalesce(CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'title ' || conv_id END, '') AS title FROM (SELECT conv_id, min(turn) AS turn0, max(turn) AS max_ref FROM conversations GROUP BY conv_id)")
def fn_valid_refs(spark: SparkSession, sf: str) -> DataFrame:
    """References inside the transcript kept, missing sections filled."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("turn0"), F.max("turn").alias("max_ref"))
    refs = F.filter(F.array("turn0", "max_ref", F.col("max_ref") + 1, F.lit(-1).cast("bigint")), lambda r: (r >= 0) & (r <= F.col("max_ref")))
    return c.select("conv_id", "max_ref", refs.alias("refs"), F.coalesce(F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("title "), "conv_id")), F.lit("")).alias("title"))


@query(
    "flt_sanitize",
    """SELECT page_id, replace(replace(replace(substr(html, 1, 50000), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text, least(greatest(page_id % 120, 0), 99) AS speaker_id, least(greatest(page_id / 400.0 - 1, 0), 1) AS confidence,
    CASE WHEN regexp_full_match('#' || CAST(page_id AS VARCHAR), '#[0-9a-fA-F]{3,6}') THEN '#' || CAST(page_id AS VARCHAR) END AS colour FROM pages WHERE page_id % 7 <> 3""",
)
def flt_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    """Imported segments: kinds kept by list, text cut to 50 000 characters and escaped, numbers clamped, colours by pattern."""
    text = F.substring("html", 1, 50000)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    colour = F.concat(F.lit("#"), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").where("page_id % 7 <> 3").select(
        "page_id", text.alias("text"), F.least(F.greatest(F.col("page_id") % 120, F.lit(0)), F.lit(99)).alias("speaker_id"),
        F.least(F.greatest(F.col("page_id") / F.lit(400.0) - 1, F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.when(colour.rlike("^#[0-9a-fA-F]{3,6}$"), colour).alias("colour"),
    )


@query(
    "aln_prop_text",
    f"""WITH {WORDS}, g AS (SELECT file_id, seg_no, count(*) AS n FROM words GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY file_id) AS total, coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
    SELECT file_id, seg_no, CAST(round_even(before * 0.8, 0) AS BIGINT) AS first_word, CAST(round_even((before + n) * 0.8, 0) AS BIGINT) AS after_word FROM t""",
)
def aln_prop_text(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a restored text, a fifth shorter, that each group of words gets, halves to even."""
    g = words(spark, sf).groupBy("file_id", "seg_no").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("file_id").orderBy("seg_no"))
    share = lambda x: F.rint(x * F.lit(0.8)).cast("bigint")
    return g.select("file_id", "seg_no", share(upto - F.col("n")).alias("first_word"), share(upto).alias("after_word"))


@query(
    "aln_remap",
    f"""WITH {WORDS}, l AS (SELECT *, (pos + k // 30) // 9 % 3 AS label FROM words), c AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY file_id, seg_no ORDER BY pos) THEN 0 ELSE 1 END AS n FROM l),
    i AS (SELECT *, CAST(sum(n) OVER (PARTITION BY file_id, seg_no ORDER BY pos) AS BIGINT) AS part FROM c)
    SELECT file_id, seg_no, part, min(label) AS label, string_agg(text, ' ' ORDER BY pos) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM i GROUP BY ALL""",
)
def aln_remap(spark: SparkSession, sf: str) -> DataFrame:
    """Word labels put back into sentences, which are cut where the label changes."""
    from ..operators.islands import number_islands

    l = words(spark, sf).withColumn("label", F.floor((F.col("pos") + F.floor(F.col("k") / 30)) / 9) % 3)  # noqa: E741
    i = number_islands(l, ["file_id", "seg_no"], ["pos"], F.col("label"), "part").withColumn("part", F.col("part").cast("bigint"))
    return i.groupBy("file_id", "seg_no", "part").agg(F.min("label").alias("label"), F.expr("listagg(text, ' ') within group (order by pos)").alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query(
    "aln_ngram_dedup",
    f"WITH {WORDS}, n AS (SELECT *, lower(lag(text) OVER w) AS b, lag(k) OVER w AS bk, lower(lead(text) OVER w) AS a, lead(k) OVER w AS ak FROM words WINDOW w AS (PARTITION BY file_id ORDER BY pos)) SELECT file_id, pos, text FROM n WHERE NOT coalesce(lower(text) = b AND k <= bk, false) AND NOT coalesce(lower(text) = a AND k < ak, false)",
)
def aln_ngram_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Of a word said twice in a row the one of higher probability, the first at a tie. Opt-in: it harms real speech."""
    w = Window.partitionBy("file_id").orderBy("pos")
    t = F.lower("text")
    first = F.coalesce((t == F.lag(t).over(w)) & (F.col("k") <= F.lag("k").over(w)), F.lit(False))
    later = F.coalesce((t == F.lead(t).over(w)) & (F.col("k") < F.lead("k").over(w)), F.lit(False))
    return words(spark, sf).withColumns({"x": first, "y": later}).where("not x and not y").select("file_id", "pos", "text")


@query("win_even_words", f"WITH {WORDS}, n AS (SELECT *, pos - min(pos) OVER s AS i, count(*) OVER s AS n FROM words WINDOW s AS (PARTITION BY file_id, seg_no)) SELECT file_id, pos, CASE WHEN i < (n % 4) * (n // 4 + 1) THEN i // (n // 4 + 1) ELSE n % 4 + (i - (n % 4) * (n // 4 + 1)) // greatest(n // 4, 1) END AS part FROM n")
def win_even_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a turn over four parts, the remainder to the first ones."""
    s = Window.partitionBy("file_id", "seg_no")
    n = words(spark, sf).withColumns({"i": F.col("pos") - F.min("pos").over(s), "n": F.count(F.lit(1)).over(s)})
    q, r = F.floor(F.col("n") / 4), F.col("n") % 4
    part = F.when(F.col("i") < r * (q + 1), F.floor(F.col("i") / (q + 1))).otherwise(r + F.floor((F.col("i") - r * (q + 1)) / F.greatest(q, F.lit(1))))
    return n.select("file_id", "pos", part.alias("part"))


@query("win_stratified", f"WITH {WORDS}, n AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM words) SELECT file_id, pos, p AS stratum FROM n, (VALUES (15), (50), (85)) v(p) WHERE abs(100 * pos - p * n) <= 500")
def win_stratified(spark: SparkSession, sf: str) -> DataFrame:
    """Words within five of three points of the file."""
    n = words(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file_id"))).withColumn("stratum", F.explode(F.array(*map(F.lit, (15, 50, 85)))))
    return n.where(F.abs(100 * F.col("pos") - F.col("stratum") * F.col("n")) <= 500).select("file_id", "pos", "stratum")


@query(
    "win_token_merge",
    f"""WITH {WORDS}, t AS (SELECT file_id, pos, unnest(['▁' || substr(text, 1, 3), substr(text, 4, 3), substr(text, 7)]) AS tok, unnest([0, 1, 2]) AS j FROM words),
    w AS (SELECT *, sum(CASE WHEN starts_with(tok, '▁') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos, j) AS word_no FROM t WHERE tok <> '')
    SELECT file_id, CAST(word_no AS BIGINT) AS word_no, string_agg(ltrim(tok, '▁'), '' ORDER BY pos, j) AS word, count(*) AS n_tokens FROM w GROUP BY ALL""",
)
def win_token_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Word pieces joined: a leading mark opens a word, others append."""
    t = words(spark, sf).select("file_id", "pos", F.posexplode(F.array(F.concat(F.lit("▁"), F.substring("text", 1, 3)), F.substring("text", 4, 3), F.substring("text", 7, 1 << 30))).alias("j", "tok")).where("tok <> ''")
    no = F.sum(F.startswith("tok", F.lit("▁")).cast("bigint")).over(Window.partitionBy("file_id").orderBy("pos", "j"))
    g = t.withColumn("word_no", no).withColumn("part", F.ltrim("tok", F.lit("▁"))).groupBy("file_id", "word_no")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "j", "part"))), lambda x: x["part"]), "")
    return g.agg(joined.alias("word"), F.count(F.lit(1)).alias("n_tokens"))


@query("win_word_end", f"WITH {WORDS} SELECT file_id, pos, start_ms, least(start_ms + 80 * (k % 5 + 1), coalesce(lead(start_ms) OVER (PARTITION BY file_id ORDER BY pos), start_ms + 80 * (k % 5 + 1))) AS end_ms FROM words")
def win_word_end(spark: SparkSession, sf: str) -> DataFrame:
    """A word ends a token's length behind its last token, at the next word's start at the latest."""
    end = F.col("start_ms") + 80 * (F.col("k") % 5 + 1)
    return words(spark, sf).select("file_id", "pos", "start_ms", F.least(end, F.lead("start_ms").over(Window.partitionBy("file_id").orderBy("pos"))).alias("end_ms"))


@query(
    "win_best_partial",
    "SELECT event_id, user_id, CASE WHEN before IS NOT NULL AND starts_with(t, before) THEN substr(t, length(before) + 1) ELSE t END AS fresh, coalesce(NOT starts_with(t, before), true) AS reset FROM (SELECT event_id, user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, substr(event_type || props, 1, CAST(1 + event_id % 9 AS BIGINT)) AS t FROM events))",
)
def win_best_partial(spark: SparkSession, sf: str) -> DataFrame:
    """What a growing text adds to the one before it, or all of it where it starts anew."""
    t = table(spark, sf, "events").withColumn("t", F.substring(F.concat("event_type", "props"), F.lit(1), (1 + F.col("event_id") % 9).cast("int")))
    t = t.withColumn("before", F.lag("t").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    grew = F.coalesce(F.startswith("t", "before"), F.lit(False))
    return t.select("event_id", "user_id", F.when(grew, F.substring(F.col("t"), F.length("before") + 1, F.lit(1 << 30))).otherwise(F.col("t")).alias("fresh"), (~grew).alias("reset"))
