"""Queries over a stored log that jobs maintain, look-ups in it, text with escapes, and alert periods."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from changelake.operators import periods
from changelake.operators.versions import active, latest
from changelake.plans import fixtures as fx
from changelake.plans.registry import Tables, register
from changelake.plans.versioned import LINE_KEYS, LINE_OUT, LINE_SQL
from changelake.sources import changelog, maintenance, tsv
from changelake.specs import table

DOCUMENTS = table("documents", "doc_id:int64 text:string lang:string source:string n_chars:int64", keys="doc_id")
TURNS = table("conversations", "conv_id:int64 turn:int64 role:string text:string", keys="conv_id turn")


# --- text with tabs and line feeds -----------------------------------------------------------


@register("tsv_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def tsv_documents(t: Tables) -> DataFrame:
    """Whole texts through an export whose line feeds stay behind backslashes: records run over lines and splits."""
    path = t.scratch("documents-tsv")
    tsv.write_tsv(t.documents.select(*DOCUMENTS.names), path, escape="marks")
    return tsv.read_tsv(t.spark, path, DOCUMENTS, header=False, records=True)


@register("tsv_conversations", "SELECT conv_id, turn, role, text FROM conversations")
def tsv_conversations(t: Tables) -> DataFrame:
    """Whole texts through an export with escapes in letters and a header in every file."""
    path = t.scratch("conversations-tsv")
    tsv.write_tsv(t.conversations.select(*TURNS.names), path, escape="letters", rows_per_file=10_000)
    return tsv.read_tsv(t.spark, path, TURNS, records=True)


# --- the stored log ------------------------------------------------------------------------------


def two_parts(t: Tables, bloom: tuple[str, ...] = ()) -> str:
    """The log in two appends, deletes apart."""
    path = t.scratch("kept-log")
    log = fx.lineitem_log(t)
    for condition in ("is_deleted = 1", "is_deleted = 0"):
        changelog.append_log(log.where(condition), path, fx.LINEITEM, layout="month", bloom=bloom)
    return path


@register(
    "stored_point_lookup",
    fx.LINEITEM_CL + "SELECT l_orderkey, l_linenumber, l_quantity FROM latest WHERE is_deleted = 0 AND l_orderkey = 8 AND l_linenumber = 2",
)
def stored_point_lookup(t: Tables) -> DataFrame:
    """One key of the stored log; Bloom filters of the key column say which row groups may hold it."""
    log = changelog.read_log(t.spark, two_parts(t, ("l_orderkey",)), fx.LINEITEM)
    return active(log, LINE_KEYS).filter("l_orderkey = 8 AND l_linenumber = 2").select("l_orderkey", "l_linenumber", "l_quantity")


@register("stored_filtered_count", fx.LINEITEM_CL + "SELECT count(*) AS n FROM latest WHERE is_deleted = 0 AND l_quantity > 45")
def stored_filtered_count(t: Tables) -> DataFrame:
    log = changelog.read_log(t.spark, two_parts(t), fx.LINEITEM)
    return active(log, LINE_KEYS).filter("l_quantity > 45").agg(F.count("*").alias("n"))


@register("maintain_compact", fx.LINEITEM_CL + f"SELECT yyyymm, {LINE_SQL} FROM latest")
def maintain_compact(t: Tables) -> DataFrame:
    """The store after its superseded versions were dropped: all rows it still holds."""
    path = two_parts(t)
    maintenance.compact_log(t.spark, path, fx.LINEITEM)
    return changelog.read_log(t.spark, path, fx.LINEITEM).select("yyyymm", *LINE_OUT)


EXPIRED = """SELECT 1 FROM latest e WHERE e.is_deleted = 1 AND e.cdc_timestamp < TIMESTAMP '1999-01-01' - INTERVAL 90 DAY
    AND e.l_orderkey = x.l_orderkey AND e.l_linenumber = x.l_linenumber"""


@register("maintain_expire", fx.LINEITEM_CL + f"SELECT {LINE_SQL} FROM cl x WHERE NOT EXISTS ({EXPIRED})")
def maintain_expire(t: Tables) -> DataFrame:
    """The store after keys deleted long ago were dropped from it."""
    path = two_parts(t)
    maintenance.expire_log(t.spark, path, fx.LINEITEM, datetime(1999, 1, 1))
    return changelog.read_log(t.spark, path, fx.LINEITEM).select(*LINE_OUT)


@register("maintain_both", fx.LINEITEM_CL + f"SELECT {LINE_SQL} FROM latest x WHERE NOT EXISTS ({EXPIRED})")
def maintain_both(t: Tables) -> DataFrame:
    """Compacted after half of the log, then the rest appended, then compacted and expired again: the current rows."""
    path = t.scratch("kept-log")
    log = fx.lineitem_log(t)
    changelog.append_log(log.where("offset % 2 = 0"), path, fx.LINEITEM)
    maintenance.compact_log(t.spark, path, fx.LINEITEM)
    changelog.append_log(log.where("offset % 2 = 1"), path, fx.LINEITEM)
    maintenance.compact_log(t.spark, path, fx.LINEITEM)
    maintenance.expire_log(t.spark, path, fx.LINEITEM, datetime(1999, 1, 1))
    return latest(changelog.read_log(t.spark, path, fx.LINEITEM), LINE_KEYS).select(*LINE_OUT)


# --- periods of alert and growth -----------------------------------------------------------------

RULES = (("busy", "changes", 1.0), ("very busy", "changes", 2.0))


def hourly_changes(t: Tables) -> DataFrame:
    topic = F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("topic")
    counts = t.events.groupBy(topic, F.date_trunc("hour", "ts").alias("sampled_at")).agg(F.count("*").cast("double").alias("value"))
    return counts.withColumn("metric", F.lit("changes"))


@register(
    "alert_periods",
    """WITH h AS (SELECT 't' || CAST(user_id % 3 AS VARCHAR) AS topic, date_trunc('hour', ts) AS sampled_at, CAST(count(*) AS DOUBLE) AS value
      FROM events GROUP BY ALL),
    b AS (SELECT h.*, rule, threshold, value > threshold AS broken FROM h CROSS JOIN (VALUES ('busy', 1.0::DOUBLE), ('very busy', 2.0::DOUBLE)) r(rule, threshold)),
    o AS (SELECT *, CASE WHEN broken AND NOT coalesce(lag(broken) OVER w, false) THEN 1 ELSE 0 END AS opens FROM b
      WINDOW w AS (PARTITION BY topic, rule ORDER BY sampled_at)),
    p AS (SELECT *, sum(opens) OVER (PARTITION BY topic, rule ORDER BY sampled_at) AS period FROM o)
    SELECT topic, 'changes' AS metric, rule, threshold, min(sampled_at) AS started_at, max(sampled_at) AS ended_at, max(value) AS peak,
      count(*) AS samples FROM p WHERE broken GROUP BY topic, rule, threshold, period""",
)
def alert_periods(t: Tables) -> DataFrame:
    """Hours in a row with more changes than a rule allows, over the edges of days."""
    return periods.alert_periods(hourly_changes(t), RULES)


@register(
    "growth_per_day",
    """WITH s AS (SELECT 't' || CAST(user_id % 3 AS VARCHAR) AS topic, ts, event_id FROM events),
    d AS (SELECT topic, CAST(ts AS DATE) AS "day", arg_max(event_id, (ts, event_id)) AS event_id FROM s GROUP BY ALL)
    SELECT topic, CAST("day" AS VARCHAR) AS "day", event_id, CAST(event_id - lag(event_id) OVER w AS DOUBLE) / ("day" - lag("day") OVER w) AS per_day
    FROM d WINDOW w AS (PARTITION BY topic ORDER BY "day")""",
)
def growth_per_day(t: Tables) -> DataFrame:
    topic = F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("topic")
    rows = periods.growth_per_day(t.events.select(topic, "ts", "event_id"), at="ts", value="event_id")
    return rows.withColumn("day", F.col("day").cast("string"))
