"""The service's relational queries.

Stand-ins: users are ``customer``, files ``orders``, queue items the first ``lineitem`` of an order, sessions the
users of ``events``, meetings ``part``. Times are real timestamps and "now" is a literal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from ..streaming.queue import queue_changes
from ..streaming.run import drain, read_stream
from .base import Group

query = Group()
NOW = "TIMESTAMP '2024-01-30 12:00:00'"


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), (F.col("c_acctbal") > 0).alias("is_active"), "c_nationkey")


def files(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "processing").otherwise("uploaded")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("user_id"), F.floor(F.col("o_totalprice") * 100).alias("size_bytes"), status.alias("file_status"), F.col("o_orderdate").alias("created_at")
    )


def queue(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "N", "waiting").when(F.col("l_returnflag") == "R", "processing").otherwise("completed")
    return table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("file_id"), status.alias("status"), F.col("l_shipdate").alias("priority"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_heartbeat"))
    return seen.select(F.col("user_id").alias("session_id"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("user_id"), (F.col("user_id") % 3 == 0).alias("is_anonymous"), "created_at", "last_heartbeat")


_USERS = "users AS (SELECT c_custkey AS user_id, c_name AS username, c_acctbal > 0 AS is_active, c_nationkey FROM customer)"
_FILES = """files AS (SELECT o_orderkey AS file_id, o_custkey AS user_id, CAST(floor(o_totalprice * 100) AS BIGINT) AS size_bytes,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'processing' ELSE 'uploaded' END AS file_status, o_orderdate AS created_at FROM orders)"""
_QUEUE = """queue AS (SELECT l_orderkey AS file_id, CASE l_returnflag WHEN 'N' THEN 'waiting' WHEN 'R' THEN 'processing' ELSE 'completed' END AS status,
  l_shipdate AS priority FROM lineitem WHERE l_linenumber = 1)"""
_SESSIONS = """sessions AS (SELECT user_id AS session_id, CASE WHEN user_id % 3 <> 0 THEN user_id END AS user_id, user_id % 3 = 0 AS is_anonymous,
  min(ts) AS created_at, max(ts) AS last_heartbeat FROM events GROUP BY events.user_id)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


@query("join_queue_files", _with(_FILES, _QUEUE) + "SELECT q.file_id, q.priority, f.user_id, f.size_bytes FROM queue q JOIN files f USING (file_id) WHERE q.status = 'waiting' ORDER BY q.priority, q.file_id LIMIT 1")
def join_queue_files(spark: SparkSession, sf: str) -> DataFrame:
    """Head of the waiting queue with its file."""
    waiting = queue(spark, sf).where("status = 'waiting'")
    return waiting.join(files(spark, sf), "file_id").orderBy("priority", "file_id").limit(1).select("file_id", "priority", "user_id", "size_bytes")


@query("join_queue_admin", _with(_USERS, _FILES, _QUEUE, _SESSIONS) + "SELECT q.file_id, q.status, q.priority, f.file_status, s.session_id, u.username FROM queue q JOIN files f USING (file_id) LEFT JOIN sessions s ON s.session_id = f.user_id LEFT JOIN users u ON u.user_id = s.user_id")
def join_queue_admin(spark: SparkSession, sf: str) -> DataFrame:
    """Every queue item with its file, session and user where known."""
    joined = queue(spark, sf).join(files(spark, sf).withColumnRenamed("user_id", "owner"), "file_id").join(sessions(spark, sf).select("session_id", "user_id"), F.col("owner") == F.col("session_id"), "left")
    return joined.join(users(spark, sf), "user_id", "left").select("file_id", "status", "priority", "file_status", "session_id", "username")


@query("join_session_user", _with(_USERS, _FILES, _SESSIONS) + "SELECT s.session_id, s.last_heartbeat, u.username, (SELECT count(*) FROM files f WHERE f.user_id = s.session_id) AS n_files FROM sessions s LEFT JOIN users u ON u.user_id = s.user_id")
def join_session_user(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with their user and number of files, zero kept."""
    counts = files(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("user_id", "owner")
    joined = sessions(spark, sf).join(users(spark, sf), "user_id", "left").join(counts, F.col("session_id") == F.col("owner"), "left")
    return joined.select("session_id", "last_heartbeat", "username", F.coalesce("n", F.lit(0)).alias("n_files"))


@query(
    "join_anti_orphan",
    _with(_FILES, _QUEUE, _SESSIONS) + f"""SELECT session_id FROM sessions s WHERE NOT is_anonymous AND ((last_heartbeat < {NOW} - INTERVAL 1 DAY AND NOT EXISTS
    (SELECT 1 FROM queue q JOIN files f USING (file_id) WHERE f.user_id = s.session_id AND q.status IN ('waiting', 'processing'))) OR created_at < {NOW} - INTERVAL 690 HOUR)""",
)
def join_anti_orphan(spark: SparkSession, sf: str) -> DataFrame:
    """Logged-in sessions that idle without active queue items, or are too old."""
    active = queue(spark, sf).where("status in ('waiting', 'processing')").join(files(spark, sf), "file_id").select(F.col("user_id").alias("owner"), F.lit(True).alias("busy")).distinct()
    joined = sessions(spark, sf).where("not is_anonymous").join(active, F.col("session_id") == F.col("owner"), "left")
    return joined.where(F.expr(f"(last_heartbeat < {NOW} - INTERVAL 1 DAY AND busy IS NULL) OR created_at < {NOW} - INTERVAL 690 HOUR")).select("session_id")


@query("join_semi_delete", _with(_FILES, _SESSIONS) + f"SELECT file_id FROM files WHERE user_id NOT IN (SELECT session_id FROM sessions WHERE last_heartbeat < {NOW} - INTERVAL 2 DAY)")
def join_semi_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Files that survive the removal of old sessions."""
    old = sessions(spark, sf).where(f"last_heartbeat < {NOW} - INTERVAL 2 DAY").select(F.col("session_id").alias("user_id"))
    return files(spark, sf).join(old, "user_id", "left_anti").select("file_id")


@query("agg_counts", _with(_FILES, _QUEUE) + "SELECT count(*) FILTER (status = 'waiting') AS waiting, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed FROM queue")
def agg_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Queue items by status in one row."""
    return queue(spark, sf).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("waiting", "processing", "completed")))


@query("agg_stats", _with(_USERS, _FILES, _QUEUE, _SESSIONS) + "SELECT (SELECT count(*) FROM users) AS n_users, (SELECT count(*) FROM sessions WHERE is_anonymous) AS n_anonymous, (SELECT count(*) FROM files) AS n_files, (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM files) AS total_bytes, (SELECT count(*) FROM queue WHERE status = 'waiting') AS n_waiting")
def agg_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Totals over the store in one row."""
    one = users(spark, sf).agg(F.count(F.lit(1)).alias("n_users"))
    one = one.crossJoin(sessions(spark, sf).agg(F.count_if("is_anonymous").alias("n_anonymous")))
    one = one.crossJoin(files(spark, sf).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")))
    return one.crossJoin(queue(spark, sf).agg(F.count_if(F.col("status") == "waiting").alias("n_waiting")))


@query("agg_storage", _with(_USERS, _FILES) + "SELECT u.user_id, CAST(coalesce(sum(f.size_bytes), 0) AS BIGINT) AS used_bytes FROM users u LEFT JOIN files f USING (user_id) GROUP BY u.user_id")
def agg_storage(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes used by each user, zero kept; files are summed before they are joined."""
    used = files(spark, sf).groupBy("user_id").agg(F.sum("size_bytes").alias("used"))
    return users(spark, sf).join(used, "user_id", "left").select("user_id", F.coalesce("used", F.lit(0)).alias("used_bytes"))


@query("agg_file_count", _with(_USERS, _FILES) + "SELECT u.user_id, u.username, u.is_active, count(f.file_id) AS n_files FROM users u LEFT JOIN files f USING (user_id) GROUP BY ALL")
def agg_file_count(spark: SparkSession, sf: str) -> DataFrame:
    """Files of each user, zero kept."""
    counts = files(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return users(spark, sf).join(counts, "user_id", "left").select("user_id", "username", "is_active", F.coalesce("n", F.lit(0)).alias("n_files"))


# What is counted, its trailing window in seconds, and the most that passes.
LIMITS = {"ip": (300, 5), "session": (60, 10), "user": (900, 10)}
#: Stand-ins for addresses and sessions, and real microseconds to a second of the limits.
_KEYS = {"ip": "user_id - user_id % 4", "session": "user_id * 8 + event_id % 8", "user": "user_id"}
_SECOND = 288_000_000


@query(
    "agg_rate_limit",
    " UNION ALL ".join(
        f"""SELECT '{kind}' AS kind, event_id, CAST(count(*) OVER w{kind} AS BIGINT) AS n_recent, count(*) OVER w{kind} > {most} AS limited, {window * _SECOND} - (epoch_us(ts) - min(epoch_us(ts)) OVER w{kind}) AS unlock_us
    FROM events WINDOW w{kind} AS (PARTITION BY {_KEYS[kind]} ORDER BY epoch_us(ts) RANGE BETWEEN {window * _SECOND - 1} PRECEDING AND CURRENT ROW)"""
        for kind, (window, most) in LIMITS.items()
    ),
)
def agg_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing-window counts by address, session and user, which are over their limit, and when the oldest counted event leaves the window."""
    events = table(spark, sf, "events").withColumn("at", F.expr("unix_micros(cast(ts as timestamp))"))

    def one(kind: str) -> DataFrame:
        window, most = LIMITS[kind][0] * _SECOND, LIMITS[kind][1]
        w = Window.partitionBy(F.expr(_KEYS[kind])).orderBy("at").rangeBetween(-(window - 1), 0)
        n = F.count(F.lit(1)).over(w)
        return events.select(F.lit(kind).alias("kind"), "event_id", n.alias("n_recent"), (n > most).alias("limited"), (window - (F.col("at") - F.min("at").over(w))).alias("unlock_us"))

    return one("ip").unionByName(one("session")).unionByName(one("user"))


@query("top_oldest_idle", _with(_SESSIONS) + "SELECT session_id, last_heartbeat FROM sessions WHERE is_anonymous ORDER BY last_heartbeat, session_id LIMIT 1")
def top_oldest_idle(spark: SparkSession, sf: str) -> DataFrame:
    """The anonymous session that has idled longest."""
    return sessions(spark, sf).where("is_anonymous").orderBy("last_heartbeat", "session_id").limit(1).select("session_id", "last_heartbeat")


@query("top_latest_file", _with(_FILES) + "SELECT user_id, file_id, file_status = 'completed' AS has_result FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, file_id DESC) AS r FROM files) WHERE r = 1")
def top_latest_file(spark: SparkSession, sf: str) -> DataFrame:
    """Newest file of each user, by one aggregation with map-side combine."""
    best = files(spark, sf).groupBy("user_id").agg(F.max(F.struct("created_at", "file_id", "file_status")).alias("f"))
    return best.select("user_id", "f.file_id", (F.col("f.file_status") == "completed").alias("has_result"))


@query("top_next_queue", _with(_QUEUE) + "SELECT file_id, priority FROM queue WHERE status = 'waiting' ORDER BY priority, file_id LIMIT 1")
def top_next_queue(spark: SparkSession, sf: str) -> DataFrame:
    """First waiting item."""
    return queue(spark, sf).where("status = 'waiting'").orderBy("priority", "file_id").limit(1).select("file_id", "priority")


@query("srt_lists", _with(_FILES) + "SELECT user_id, file_id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, file_id DESC) AS list_no FROM files")
def srt_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's files, newest first, with their place in the list."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("file_id"))
    return files(spark, sf).select("user_id", "file_id", "created_at", F.row_number().over(w).cast("bigint").alias("list_no"))


@query(
    "pag_meetings",
    """WITH o AS (SELECT p_partkey AS id, p_name AS name, row_number() OVER (ORDER BY p_name, p_partkey) AS r, count(*) OVER () AS n FROM part WHERE p_size = 15)
    SELECT id, name, CAST(least(3, greatest(1, ceil(n / 20.0))) AS BIGINT) AS page FROM o
    WHERE r > 20 * (least(3, greatest(1, ceil(n / 20.0))) - 1) AND r <= 20 * least(3, greatest(1, ceil(n / 20.0)))""",
)
def pag_meetings(spark: SparkSession, sf: str, page: int = 3, size: int = 20) -> DataFrame:
    """One page of a sorted list, clamped to the last; the sort keeps only the pages up to it."""
    rows = table(spark, sf, "part").where("p_size = 15").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    last = max(1, -(-rows.count() // size))
    page = min(page, last)
    return rows.orderBy("name", "id").offset(size * (page - 1)).limit(size).withColumn("page", F.lit(page).cast("bigint"))


@query(
    "smp_even",
    """WITH o AS (SELECT o_orderkey AS file_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
    SELECT file_id, i AS place FROM o WHERE EXISTS (SELECT 1 FROM range(50) t(k) WHERE i = (k * n) // 50)""",
)
def smp_even(spark: SparkSession, sf: str, k: int = 50) -> DataFrame:
    """Evenly spaced ``k`` of ``n`` rows by key: places come from per-partition counts, not from one sorted task."""
    rows = table(spark, sf, "orders").select("o_orderkey").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    part = rows.withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id())
    sizes = part.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("p")
    starts = sizes.select("p", (F.sum("c").over(w) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    placed = part.join(starts, "p").withColumn("place", F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    wanted = F.array(*((F.lit(j) * F.col("n") / k).cast("bigint") for j in range(k)))
    return placed.where(F.array_contains(wanted, F.col("place"))).select(F.col("o_orderkey").alias("file_id"), "place")


@query("win_queue_pos", _with(_QUEUE) + "SELECT file_id, CASE status WHEN 'waiting' THEN rank() OVER (PARTITION BY status ORDER BY priority) WHEN 'processing' THEN 0 ELSE -1 END AS place FROM queue")
def win_queue_pos(spark: SparkSession, sf: str) -> DataFrame:
    """Place in the queue: one more than the waiting items of smaller priority; 0 in process; -1 otherwise.

    Ranks come from counts per distinct priority, so only those, not the items, are ordered in one place.
    """
    items = queue(spark, sf)
    levels = items.where("status = 'waiting'").groupBy("priority").agg(F.count(F.lit(1)).alias("c"))
    ranked = levels.select("priority", (F.sum("c").over(Window.orderBy("priority")) - F.col("c") + 1).alias("rank"))
    joined = items.join(ranked, "priority", "left")
    return joined.select("file_id", F.when(F.col("status") == "waiting", F.col("rank")).when(F.col("status") == "processing", 0).otherwise(-1).cast("bigint").alias("place"))


@query("flt_like", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name ILIKE '%a\\_%' ESCAPE '\\' OR p_type ILIKE '%PROM%'")
def flt_like(spark: SparkSession, sf: str) -> DataFrame:
    """Case-blind substring search over two columns, wildcards taken literally."""
    return table(spark, sf, "part").where(F.lower("p_name").contains("a_") | F.lower("p_type").contains("prom")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("flt_access", _with(_FILES) + "SELECT file_id FROM files WHERE user_id = 7 OR (user_id IS NOT NULL AND user_id = 11)")
def flt_access(spark: SparkSession, sf: str) -> DataFrame:
    """Files that a session or a user may open."""
    return files(spark, sf).where("user_id = 7 or (user_id is not null and user_id = 11)").select("file_id")


@query("prj_update", _with(_FILES) + "SELECT file_id, CASE WHEN file_status = 'processing' THEN 'error' ELSE file_status END AS file_status, CASE WHEN file_status = 'processing' THEN 0 ELSE size_bytes END AS size_bytes FROM files")
def prj_update(spark: SparkSession, sf: str) -> DataFrame:
    """An update of allowed columns where a predicate holds, as a projection."""
    stale = F.col("file_status") == "processing"
    return files(spark, sf).select("file_id", F.when(stale, "error").otherwise(F.col("file_status")).alias("file_status"), F.when(stale, 0).otherwise(F.col("size_bytes")).alias("size_bytes"))


_CONF, _MOS = "(l_discount * 10)", "(1 + l_tax * 50)"


@query(
    "prj_quality_label",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN {_MOS} >= 4 THEN 'excellent' WHEN {_MOS} >= 3 THEN 'good' WHEN {_MOS} >= 2 THEN 'fair' ELSE 'poor' END AS mos_label,
    CASE WHEN {_CONF} >= 0.85 THEN 'excellent' WHEN {_CONF} >= 0.75 THEN 'good' WHEN {_CONF} >= 0.6 THEN 'fair' ELSE 'poor' END AS conf_label,
    {_CONF} >= 0.6 AND {_MOS} >= 2.5 AS ready FROM lineitem""",
)
def prj_quality_label(spark: SparkSession, sf: str) -> DataFrame:
    """Labels by thresholds on quality and confidence, and readiness."""
    conf, mos = F.expr(_CONF), F.expr(_MOS)
    label = lambda x, a, b, c: F.when(x >= a, "excellent").when(x >= b, "good").when(x >= c, "fair").otherwise("poor")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", label(mos, 4, 3, 2).alias("mos_label"), label(conf, 0.85, 0.75, 0.6).alias("conf_label"), ((conf >= 0.6) & (mos >= 2.5)).alias("ready"))


@query("prj_slider", "SELECT p_partkey, round(0.5 - (s - 1) * 1.3 / 9, 6) AS keep_conf, round(-1.5 + (s - 1) * 2.0 / 9, 6) AS case_conf, s <= 1 AS bypass FROM (SELECT p_partkey, CAST(1 + p_size % 10 AS DOUBLE) AS s FROM part)")
def prj_slider(spark: SparkSession, sf: str) -> DataFrame:
    """A slider of 1 to 10 as confidences."""
    s = (1 + F.col("p_size") % 10).cast("double")
    return table(spark, sf, "part").select("p_partkey", F.round(0.5 - (s - 1) * 1.3 / 9, 6).alias("keep_conf"), F.round(-1.5 + (s - 1) * 2.0 / 9, 6).alias("case_conf"), (s <= 1).alias("bypass"))


@query(
    "flt_config",
    """SELECT event_id, lower(event_type) IN ('signup', 'view') AS flag, least(greatest(coalesce(TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT), 1), 2), 40) AS threads,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'view' END AS mode, regexp_full_match(event_type || '.' || event_id, '[A-Za-z0-9_.-]{1,160}') AS id_ok FROM events""",
)
def flt_config(spark: SparkSession, sf: str) -> DataFrame:
    """Coerced flags, clamped integers, enumerations with a default, and an id pattern."""
    k = F.expr("try_cast(regexp_extract(props, '\"k\": *([0-9]+)', 1) as bigint)")
    mode = F.when(F.col("event_type").isin("view", "click", "purchase"), F.col("event_type")).otherwise("view")
    return table(spark, sf, "events").select(
        "event_id", F.lower("event_type").isin("signup", "view").alias("flag"), F.least(F.greatest(F.coalesce(k, F.lit(1)), F.lit(2)), F.lit(40)).alias("threads"),
        mode.alias("mode"), F.concat_ws(".", "event_type", "event_id").rlike("^[A-Za-z0-9_.-]{1,160}$").alias("id_ok"),
    )


@query(
    "fn_time_fmt",
    """SELECT l_orderkey, l_linenumber, lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') AS clock,
    CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN (b // 1024) || ' KB' ELSE (b // 1048576) || ' MB' END AS size_label
    FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) * 100 AS ms, CAST(floor(l_extendedprice) AS BIGINT) * 40 AS b FROM lineitem)""",
)
def fn_time_fmt(spark: SparkSession, sf: str) -> DataFrame:
    """Clock and size labels."""
    base = F.floor("l_extendedprice").cast("bigint")
    ms, b = base * 100, base * 40
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(ms / 3600000)), two(F.floor(ms / 60000) % 60), two(F.floor(ms / 1000) % 60))
    whole = lambda d: F.floor(b / d).cast("bigint").cast("string")
    label = F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1048576, F.concat(whole(1024), F.lit(" KB"))).otherwise(F.concat(whole(1048576), F.lit(" MB")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", clock.alias("clock"), label.alias("size_label"))


_PROGRESS = "CASE WHEN event_id % 7 = 0 THEN event_type ELSE 'PHASE:' || event_type || '|' || props || '|' || CAST(event_id % 101 AS STRING) END"


@query("fn_progress_parse", f"SELECT event_id, CASE WHEN starts_with(p, 'PHASE:') THEN split_part(substr(p, 7), '|', 1) END AS phase, CASE WHEN starts_with(p, 'PHASE:') THEN split_part(p, '|', 2) ELSE p END AS message, TRY_CAST(split_part(p, '|', 3) AS BIGINT) AS percent FROM (SELECT event_id, {_PROGRESS} AS p FROM events)")
def fn_progress_parse(spark: SparkSession, sf: str) -> DataFrame:
    """``PHASE:name|message|percent`` strings as columns; others are a message alone."""
    p = table(spark, sf, "events").select("event_id", F.expr(_PROGRESS).alias("p"))
    phased = F.startswith("p", F.lit("PHASE:"))
    part = lambda x, k: F.split_part(x, F.lit("|"), F.lit(k))
    return p.select("event_id", F.when(phased, part(F.substring("p", 7, 1 << 30), 1)).alias("phase"), F.when(phased, part(F.col("p"), 2)).otherwise(F.col("p")).alias("message"), F.expr("try_cast(split_part(p, '|', 3) as bigint)").alias("percent"))


@query(
    "agg_run_compare",
    """WITH a AS (SELECT l_linenumber AS stage, sum(l_quantity) AS base_s, sum(l_quantity * (1 - l_discount)) AS new_s FROM lineitem GROUP BY l_linenumber)
    SELECT CAST(stage AS BIGINT) AS stage, round(base_s / new_s, 6) AS speedup, round(abs(base_s - new_s) / base_s, 6) AS drift, base_s / new_s >= 1.05 AND abs(base_s - new_s) / base_s < 0.2 AS accepted FROM a""",
)
def agg_run_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Speed ratio and drift of two runs by stage, and whether the change is accepted."""
    a = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("bigint").alias("stage")).agg(F.sum("l_quantity").alias("base_s"), F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("new_s"))
    speed, drift = F.col("base_s") / F.col("new_s"), F.abs(F.col("base_s") - F.col("new_s")) / F.col("base_s")
    return a.select("stage", F.round(speed, 6).alias("speedup"), F.round(drift, 6).alias("drift"), ((speed >= 1.05) & (drift < 0.2)).alias("accepted"))


@query(
    "str_session_gap",
    """WITH f AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS s FROM events),
    i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
    SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 120 MINUTE AS ended, count(*) AS n FROM i GROUP BY user_id, k""",
)
def str_session_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that end after two idle hours, by the built-in session window."""
    s = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "120 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


@query("fn_timestamps", f"SELECT event_id, epoch_us(ts) - epoch_us({NOW} - INTERVAL 120 MINUTE) AS since_cutoff_us, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events WHERE ts < {NOW} - INTERVAL 120 MINUTE")
def fn_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """Times before a cutoff, their distance to it, and their text."""
    e = table(spark, sf, "events").where(F.expr(f"ts < {NOW} - INTERVAL 120 MINUTE"))
    micros = lambda x: f"unix_micros(cast({x} as timestamp))"
    return e.select("event_id", F.expr(f"{micros('ts')} - {micros(f'{NOW} - INTERVAL 120 MINUTE')}").alias("since_cutoff_us"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


_BUSY = "busy AS (SELECT DISTINCT user_id AS b FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-29 00:00:00')"
_EXPIRY = """CASE WHEN last_heartbeat < {now} - INTERVAL 7 DAY THEN 'purged' WHEN session_id % 7 = 0 THEN 'connected' WHEN is_anonymous THEN CASE WHEN last_heartbeat < {now} - INTERVAL 2 HOUR THEN 'expired' ELSE 'live' END
  WHEN created_at < {now} - INTERVAL 24 HOUR AND last_heartbeat < {now} - INTERVAL 24 HOUR THEN 'killed' WHEN last_heartbeat < {now} - INTERVAL 1 HOUR AND b IS NULL THEN 'expired' ELSE 'live' END"""


@query("flt_expired_sessions", _with(_SESSIONS, _BUSY) + f"SELECT session_id, {_EXPIRY.format(now=NOW)} AS state FROM sessions LEFT JOIN busy ON session_id = b")
def flt_expired_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """State of each session by its last heartbeat: what is connected stays, anonymous ones expire by timeout, logged-in ones
    when idle without queued work or, past a day, whatever they run; a week later the row goes."""
    busy = table(spark, sf, "events").where("event_type = 'purchase' and ts >= TIMESTAMP_NTZ '2024-01-29 00:00:00'").select(F.col("user_id").alias("b")).distinct()
    rows = sessions(spark, sf).join(busy, F.col("session_id") == F.col("b"), "left")
    return rows.select("session_id", F.expr(_EXPIRY.format(now=NOW)).alias("state"))


_ACTIONS = {"signup": "enqueue", "view": "start", "purchase": "complete", "error": "fail", "click": "cancel"}


@query(
    "str_queue",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
    s AS (SELECT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, 'none' AS status, false AS changed FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT e.user_id, e.r, e.event_id, CASE WHEN n.status IS NULL THEN s.status ELSE n.status END, n.status IS NOT NULL FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1,
      LATERAL (SELECT CASE WHEN e.t = 'signup' AND s.status NOT IN ('waiting', 'processing') THEN 'waiting' WHEN e.t = 'view' AND s.status = 'waiting' THEN 'processing' WHEN e.t = 'purchase' AND s.status = 'processing' THEN 'completed'
        WHEN e.t = 'error' AND s.status = 'processing' THEN 'error' WHEN e.t = 'click' AND s.status IN ('waiting', 'processing') THEN 'cancelled' END AS status) n)
    SELECT user_id AS stream_id, event_id, status FROM s WHERE changed""",
)
def str_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Status changes of each session's queue item, from the live stream of its actions; what its status does not allow is refused."""
    action = F.create_map(*(F.lit(x) for pair in _ACTIONS.items() for x in pair))[F.col("event_type")]
    e = read_stream(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame"), action.alias("action"))
    return drain(queue_changes(e))


@query("str_eviction", _with(_SESSIONS) + "SELECT session_id FROM (SELECT session_id, row_number() OVER (ORDER BY last_heartbeat, session_id) AS r, count(*) OVER () AS n FROM sessions WHERE is_anonymous) WHERE r = 1 AND n >= 5")
def str_eviction(spark: SparkSession, sf: str, capacity: int = 5) -> DataFrame:
    """The session that leaves when the anonymous ones have reached capacity: none below it."""
    idle = sessions(spark, sf).where("is_anonymous")
    first = idle.orderBy("last_heartbeat", "session_id").limit(1)
    return first.crossJoin(idle.agg(F.count(F.lit(1)).alias("n"))).where(F.col("n") >= capacity).select("session_id")


@query(
    "str_resource",
    """SELECT event_id, user_id, round(value - lag(value) OVER w, 6) AS delta, round((value - lag(value) OVER w) / nullif(epoch(ts) - epoch(lag(ts) OVER w), 0), 9) AS rate
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def str_resource(spark: SparkSession, sf: str) -> DataFrame:
    """Deltas and rates of a counter between samples."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.expr("unix_micros(cast(ts as timestamp)) / 1e6")
    e = table(spark, sf, "events").withColumn("at", at).withColumns({"d": F.col("value") - F.lag("value").over(w), "dt": F.col("at") - F.lag("at").over(w)})
    return e.select("event_id", "user_id", F.round("d", 6).alias("delta"), F.round(F.col("d") / F.nullif(F.col("dt"), F.lit(0.0)), 9).alias("rate"))


@query(
    "str_tumbling",
    "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS began, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def str_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and sums in fixed windows."""
    got = table(spark, sf, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("w.start").alias("began"), "event_type", "n", "total")


@query(
    "str_sliding",
    """SELECT began, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS began FROM events) GROUP BY began""",
)
def str_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Counts in windows of twelve hours that start every six."""
    got = table(spark, sf, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("began"), "n")
