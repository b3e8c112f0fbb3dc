"""Transcript interchange and speaker edits over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.islands import number_islands
from ..session import table
from ..sources.files import parse_hotwords, parse_tokens
from .base import Group

query = Group()


#: Who speaks: the role, but the assistant in two of five turns, so that speakers hold several turns in a row.
SPEAKER = "CASE WHEN (turn + conv_id) % 5 < 2 THEN 'assistant' ELSE role END"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").withColumn("role", F.expr(SPEAKER))


_T = f"t AS (SELECT * REPLACE ({SPEAKER} AS role) FROM conversations)"
_B = "b AS (SELECT *, sum(CASE WHEN role = before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t))"


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return number_islands(turns(spark, sf), ["conv_id"], ["turn"], F.col("role"), "block")


@query("snk_transcript_text", f"WITH {_T}, {_B} SELECT conv_id, CAST(block AS BIGINT) AS block, min(role) || ':' || chr(10) || string_agg(trim(text), ' ' ORDER BY turn) AS text FROM b GROUP BY conv_id, block")
def snk_transcript_text(spark: SparkSession, sf: str) -> DataFrame:
    """Speaker header and joined text of each block."""
    joined = blocks(spark, sf).withColumn("t", F.trim("text")).groupBy("conv_id", "block").agg(F.min("role").alias("role"), F.expr("listagg(t, ' ') within group (order by turn)").alias("t"))
    return joined.select("conv_id", "block", F.concat("role", F.lit(":\n"), "t").alias("text"))


@query("snk_live_export", f"WITH {_T}, {_B}, i AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS speaker_id FROM t GROUP BY conv_id, role) SELECT b.conv_id, CAST(block AS BIGINT) AS block, any_value(i.speaker_id) AS speaker_id, string_agg(text, ' ' ORDER BY turn) AS text FROM b JOIN i USING (conv_id, role) GROUP BY b.conv_id, block")
def snk_live_export(spark: SparkSession, sf: str) -> DataFrame:
    """Live segments as export blocks; speakers are numbered by first appearance."""
    first = turns(spark, sf).groupBy("conv_id", "role").agg(F.min("turn").alias("f"))
    ids = first.select("conv_id", "role", (F.row_number().over(Window.partitionBy("conv_id").orderBy("f")) - 1).cast("bigint").alias("speaker_id"))
    g = blocks(spark, sf).groupBy("conv_id", "block", "role").agg(F.expr("listagg(text, ' ') within group (order by turn)").alias("text"))
    return g.join(ids, ["conv_id", "role"]).select("conv_id", "block", "speaker_id", "text")


_ROWS = """r AS (SELECT conv_id, turn, 0 AS k, 'speaker' AS type, role AS speaker, NULL AS text FROM b WHERE before IS DISTINCT FROM role UNION ALL SELECT conv_id, turn, 1, 'text', NULL, text FROM b)"""


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Transcript rows as a separator wherever the speaker changes, then the text."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    kind = lambda k, t, s, x: F.struct(F.lit(k).alias("k"), F.lit(t).alias("type"), s.alias("speaker"), x.alias("text"))
    none = F.lit(None).cast("string")
    text = kind(1, "text", none, F.col("text"))
    rows = turns(spark, sf).withColumn("new", ~before.eqNullSafe(F.col("role")))
    return rows.select("conv_id", "turn", F.explode(F.when(F.col("new"), F.array(kind(0, "speaker", F.col("role"), none), text)).otherwise(F.array(text))).alias("r")).select("conv_id", "turn", "r.*")


@query("win_separator_emit", f"WITH {_T}, {_B}, {_ROWS} SELECT * FROM r")
def win_separator_emit(spark: SparkSession, sf: str) -> DataFrame:
    """Separators where the speaker changes."""
    return tagged(spark, sf)


@query("win_speaker_ffill", f"WITH {_T}, {_B}, {_ROWS}, f AS (SELECT *, last_value(speaker IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, k ROWS UNBOUNDED PRECEDING) AS who FROM r) SELECT conv_id, turn, who AS speaker, text FROM f WHERE type = 'text'")
def win_speaker_ffill(spark: SparkSession, sf: str) -> DataFrame:
    """Text rows with the speaker of the separator before them."""
    w = Window.partitionBy("conv_id").orderBy("turn", "k").rowsBetween(Window.unboundedPreceding, 0)
    return tagged(spark, sf).withColumn("who", F.last("speaker", ignorenulls=True).over(w)).where("type = 'text'").select("conv_id", "turn", F.col("who").alias("speaker"), "text")


@query("win_separator_norm", "WITH r AS (SELECT event_id, user_id, ts, event_type AS type, value FROM events), l AS (SELECT *, lead(type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM r), k AS (SELECT *, type = 'click' AS sep FROM l WHERE NOT (type = 'click' AND coalesce(nxt, '') = 'click')), s AS (SELECT *, CASE WHEN sep THEN event_id % 2 END AS who FROM k), p AS (SELECT *, last_value(who IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS now_ FROM s) SELECT event_id, user_id, sep FROM p WHERE NOT (sep AND now_ IS NOT NULL AND who = now_)")
def win_separator_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Of separators in a row the last; none that repeats the current speaker."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = table(spark, sf, "events").withColumns({"nxt": F.coalesce(F.lead("event_type").over(w), F.lit("")), "sep": F.col("event_type") == "click"})
    k = r.where(~(F.col("sep") & (F.col("nxt") == "click"))).withColumn("who", F.when(F.col("sep"), F.col("event_id") % 2))
    now = F.last("who", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return k.withColumn("now", now).where(~(F.col("sep") & F.coalesce(F.col("who") == F.col("now"), F.lit(False)))).select("event_id", "user_id", "sep")


@query("src_json_transcript", f"WITH {_T} SELECT conv_id, turn, role AS speaker, length(text) AS n_chars FROM t")
def src_json_transcript(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts written as interchange JSON and parsed back with the declared schema."""
    schema = "version int, segments array<struct<type string, turn bigint, speaker string, text string>>"
    made = turns(spark, sf).groupBy("conv_id").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.array_sort(F.collect_list(F.struct("turn", F.lit("text").alias("type"), F.col("role").alias("speaker"), "text"))).alias("segments"))).alias("j"))
    s = made.select("conv_id", F.explode(F.from_json("j", schema)["segments"]).alias("s"))
    return s.select("conv_id", "s.turn", "s.speaker", F.length("s.text").cast("bigint").alias("n_chars"))


@query(
    "snk_json_transcript",
    f"""WITH {_T}, n AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY role) - 1 AS i FROM (SELECT DISTINCT conv_id, role FROM t)),
    m AS (SELECT conv_id, '{{' || string_agg('"' || i || '":' || to_json(role), ',' ORDER BY i) || '}}' AS names FROM n GROUP BY conv_id),
    s AS (SELECT conv_id, '[' || string_agg('{{"type":"text","text":' || to_json(text) || ',"speaker":' || to_json(role) || ',"start_time":' || turn || '.0,"segment_id":' || turn || '}}', ',' ORDER BY turn) || ']' AS segs FROM t GROUP BY conv_id)
    SELECT conv_id, '{{"version":1,"speaker_names":' || names || ',"segments":' || segs || '}}' AS json FROM s JOIN m USING (conv_id)""",
)
def snk_json_transcript(spark: SparkSession, sf: str) -> DataFrame:
    """One interchange JSON per conversation."""
    seg = F.struct(F.lit("text").alias("type"), "text", F.col("role").alias("speaker"), F.col("turn").cast("double").alias("start_time"), F.col("turn").alias("segment_id"))
    g = turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", seg.alias("s")))).alias("l"), F.sort_array(F.collect_set("role")).alias("names"))
    body = F.struct(F.lit(1).alias("version"), F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda i: i.cast("string")), "names").alias("speaker_names"), F.transform("l", lambda x: x["s"]).alias("segments"))
    return g.select("conv_id", F.to_json(body).alias("json"))


@query("edit_rename", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'A &amp; B' WHEN 'assistant' THEN substr(repeat('x', 250), 1, 200) ELSE role END AS speaker FROM conversations")
def edit_rename(spark: SparkSession, sf: str) -> DataFrame:
    """Speaker names from a map, cut to 200 characters and escaped."""
    names = F.create_map(F.lit("user"), F.lit("A & B"), F.lit("assistant"), F.lit("x" * 250))
    name = F.substring(F.coalesce(F.element_at(names, F.col("role")), F.col("role")), 1, 200)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return table(spark, sf, "conversations").select("conv_id", "turn", name.alias("speaker"))


_IDS = "f AS (SELECT conv_id, role, min(turn) AS first FROM t GROUP BY conv_id, role), i AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY first) - 1 AS id FROM f), n AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'assistant' ELSE 'guest' END AS name, max(id) + 1 AS fresh FROM i GROUP BY conv_id), s AS (SELECT n.conv_id, n.name, coalesce(i.id, n.fresh) AS id FROM n LEFT JOIN i ON i.conv_id = n.conv_id AND i.role = n.name)"


@query(
    "edit_split",
    f"""WITH {_T}, {_B}, {_IDS}, k AS (SELECT b.conv_id, b.turn, b.role, i.id, s.name, s.id AS to_id, b.turn >= 4 AND b.block = any_value(CASE WHEN b.turn = 4 THEN b.block END) OVER (PARTITION BY b.conv_id) AS tail FROM b JOIN i USING (conv_id, role) JOIN s USING (conv_id))
    SELECT conv_id, turn, CASE WHEN tail THEN name ELSE role END AS to_end, CASE WHEN tail THEN to_id ELSE id END AS to_end_id, CASE WHEN turn = 4 THEN name ELSE role END AS single, CASE WHEN turn = 4 THEN to_id ELSE id END AS single_id FROM k""",
)
def edit_split(spark: SparkSession, sf: str) -> DataFrame:
    """A speaker from row 4 to the end of its block, or for that row alone with the old one restored after it.

    A name that the transcript has keeps its id, a new one gets the largest id plus one; ids go by first appearance.
    """
    b = blocks(spark, sf)
    first = b.groupBy("conv_id", "role").agg(F.min("turn").alias("f"))
    ids = first.select("conv_id", "role", (F.row_number().over(Window.partitionBy("conv_id").orderBy("f")) - 1).cast("bigint").alias("id"))
    name = F.when(F.col("conv_id") % 2 == 0, "assistant").otherwise("guest")
    new = ids.groupBy("conv_id").agg((F.max("id") + 1).alias("fresh"), F.max(F.when(F.col("role") == name, F.col("id"))).alias("known"))
    new = new.select("conv_id", name.alias("name"), F.coalesce("known", "fresh").alias("to_id"))
    split = F.max(F.when(F.col("turn") == 4, F.col("block"))).over(Window.partitionBy("conv_id"))
    rows = b.withColumn("tail", F.coalesce((F.col("turn") >= 4) & (F.col("block") == split), F.lit(False))).join(ids, ["conv_id", "role"]).join(new, "conv_id")
    pick = lambda where, a, c: F.when(where, F.col(a)).otherwise(F.col(c))
    one = F.col("turn") == 4
    return rows.select("conv_id", "turn", pick(F.col("tail"), "name", "role").alias("to_end"), pick(F.col("tail"), "to_id", "id").alias("to_end_id"), pick(one, "name", "role").alias("single"), pick(one, "to_id", "id").alias("single_id"))


@query(
    "edit_merge",
    f"""WITH {_T}, {_B}, n AS (SELECT conv_id, block, role, lag(role) OVER w AS up, lead(role) OVER w AS down FROM (SELECT conv_id, block, min(role) AS role FROM b GROUP BY conv_id, block) WINDOW w AS (PARTITION BY conv_id ORDER BY block))
    SELECT b.conv_id, b.turn, CASE WHEN b.block = 2 AND b.turn <= 3 THEN coalesce(n.up, b.role) ELSE b.role END AS merged_up, CASE WHEN b.block = 2 AND b.turn >= 3 THEN coalesce(n.down, b.role) ELSE b.role END AS merged_down FROM b JOIN n USING (conv_id, block)""",
)
def edit_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a block up to a row take the speaker above; from it on, the one below."""
    b = blocks(spark, sf)
    w = Window.partitionBy("conv_id").orderBy("block")
    n = b.groupBy("conv_id", "block").agg(F.min("role").alias("r")).select("conv_id", "block", F.lag("r").over(w).alias("up"), F.lead("r").over(w).alias("down"))
    j = b.join(n, ["conv_id", "block"])
    mine = F.col("block") == 2
    return j.select("conv_id", "turn", F.when(mine & (F.col("turn") <= 3), F.coalesce("up", "role")).otherwise(F.col("role")).alias("merged_up"), F.when(mine & (F.col("turn") >= 3), F.coalesce("down", "role")).otherwise(F.col("role")).alias("merged_down"))


_LINE = "CASE item_id % 5 WHEN 0 THEN '# note' WHEN 1 THEN replace(substr(text, 1, 12), 'ß', 'ss') || ' :2.5' WHEN 2 THEN replace(substr(text, 1, 12), 'ß', 'ss') || ':x' WHEN 3 THEN '  ' ELSE replace(substr(text, 1, 12), 'ß', 'ss') END"


@query(
    "src_hotwords",
    f"""WITH l AS (SELECT item_id, trim({_LINE}) AS l FROM benchmark), p AS (SELECT item_id, l, TRY_CAST(trim(regexp_extract(l, ':([^:]*)$', 1)) AS DOUBLE) AS s FROM l WHERE l <> '' AND NOT starts_with(l, '#'))
    SELECT item_id, upper(CASE WHEN s IS NULL THEN l ELSE trim(regexp_replace(l, ':[^:]*$', '')) END) AS phrase, coalesce(s, 1.5) AS score FROM p""",
)
def src_hotwords(spark: SparkSession, sf: str) -> DataFrame:
    """Lines ``phrase [:score]``: blank and comment lines skipped, a suffix that is no number stays in the phrase."""
    return parse_hotwords(table(spark, sf, "benchmark").select("item_id", F.expr(_LINE).alias("l")), "l")


@query("src_tokens", "SELECT CAST(split_part(l, ' ', 2) AS BIGINT) AS id, split_part(l, ' ', 1) AS token FROM (SELECT p_brand || ' ' || p_partkey AS l FROM part)")
def src_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """``token id`` lines as a table."""
    return parse_tokens(table(spark, sf, "part").select(F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string")).alias("l")), "l")


@query("src_vocab", "SELECT namespace, token, row_number() OVER (PARTITION BY namespace ORDER BY first) + 1 AS id FROM (SELECT p_type AS namespace, p_name AS token, min(p_partkey) AS first FROM part GROUP BY ALL)")
def src_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of tokens by namespace in order of appearance; 0 and 1 are left to padding and unknown."""
    t = table(spark, sf, "part").groupBy(F.col("p_type").alias("namespace"), F.col("p_name").alias("token")).agg(F.min("p_partkey").alias("first"))
    return t.select("namespace", "token", (F.row_number().over(Window.partitionBy("namespace").orderBy("first")) + 1).cast("bigint").alias("id"))


@query("src_sqlite", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_sqlite(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of the store by name, through SQL."""
    table(spark, sf, "nation").createOrReplaceTempView("store_nation")
    table(spark, sf, "region").createOrReplaceTempView("store_region")
    return spark.sql("SELECT n_nationkey, n_name, r_name FROM store_nation JOIN store_region ON n_regionkey = r_regionkey")
