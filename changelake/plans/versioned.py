"""Queries on the versioned log: latest, active, deleted, lifecycle, as-of, compaction, expiry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from changelake.operators import versions as v
from changelake.operators.audit import union_all
from changelake.operators.envelope import decode
from changelake.plans import fixtures as fx
from changelake.plans.registry import Tables, register
from changelake.sources.changelog import migrate, retain

LINE_KEYS = fx.LINEITEM.keys
LINE_OUT = [*fx.LINEITEM.names, "cdc_operation", "cdc_timestamp", "is_deleted"]
LINE_SQL = f"{fx.LINEITEM_COLUMNS}, op AS cdc_operation, cdc_timestamp, is_deleted"


@register(
    "active_by_type",
    fx.EVENTS_CL
    + """SELECT event_type, count(*) AS n, round(sum(amount), 2) AS amount FROM latest WHERE is_deleted = 0 GROUP BY event_type""",
)
def active_by_type(t: Tables) -> DataFrame:
    """Flagship: messages, decoded, resolved to active rows, aggregated."""
    return (
        v.active(fx.events_log(t), ["user_id"])
        .groupBy("event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))
    )


@register(
    "latest_events",
    fx.EVENTS_CL
    + 'SELECT user_id, event_type, amount, op AS cdc_operation, cdc_timestamp, is_deleted, seq AS "offset" FROM latest',
)
def latest_events(t: Tables) -> DataFrame:
    rows = v.latest(fx.events_log(t), ["user_id"])
    return rows.select(*fx.EVENTS.names, "cdc_operation", "cdc_timestamp", "is_deleted", "offset")


@register("latest_lineitem", fx.LINEITEM_CL + f"SELECT {LINE_SQL} FROM latest")
def latest_lineitem(t: Tables) -> DataFrame:
    return v.latest(decode(fx.lineitem_messages(t.lineitem), fx.LINEITEM), LINE_KEYS).select(*LINE_OUT)


@register(
    "active_lineitem",
    fx.LINEITEM_CL + f"SELECT {fx.LINEITEM_COLUMNS}, op AS cdc_operation, cdc_timestamp FROM latest WHERE is_deleted = 0",
)
def active_lineitem(t: Tables) -> DataFrame:
    return v.active_view(fx.lineitem_log(t), fx.LINEITEM)


@register(
    "deleted_lineitem",
    fx.LINEITEM_CL
    + "SELECT l_orderkey, l_linenumber, cdc_timestamp FROM latest WHERE is_deleted = 1 ORDER BY cdc_timestamp DESC, l_orderkey, l_linenumber",
)
def deleted_lineitem(t: Tables) -> DataFrame:
    rows = v.deleted(fx.lineitem_log(t), LINE_KEYS)
    return v.newest_first(rows, LINE_KEYS).select(*LINE_KEYS, "cdc_timestamp")


@register(
    "all_with_deletes",
    fx.LINEITEM_CL
    + """SELECT l_orderkey, l_linenumber, l_quantity, is_deleted, op AS cdc_operation, cdc_timestamp
    FROM latest ORDER BY cdc_timestamp DESC, l_orderkey, l_linenumber""",
)
def all_with_deletes(t: Tables) -> DataFrame:
    rows = v.newest_first(v.latest(fx.lineitem_log(t), LINE_KEYS), LINE_KEYS)
    return rows.select(*LINE_KEYS, "l_quantity", "is_deleted", "cdc_operation", "cdc_timestamp")


@register(
    "audit_trail",
    fx.EVENTS_CL
    + """SELECT user_id, op AS cdc_operation, CASE op WHEN 'c' THEN 'Create' WHEN 'u' THEN 'Update'
    WHEN 'r' THEN 'Read (snapshot)' WHEN 'd' THEN 'Delete' END AS operation_type, is_deleted, cdc_timestamp
    FROM latest ORDER BY cdc_timestamp DESC, user_id LIMIT 100""",
)
def audit_trail(t: Tables) -> DataFrame:
    return v.audit_trail(fx.events_log(t), ["user_id"], 100)


@register(
    "lifecycle_key",
    fx.EVENTS_CL
    + """SELECT user_id, event_type, amount, op AS cdc_operation, is_deleted, cdc_timestamp FROM cl
    WHERE user_id = 7 ORDER BY cdc_timestamp, seq""",
)
def lifecycle_key(t: Tables) -> DataFrame:
    """One record's history; the key is the feature."""
    rows = v.lifecycle(fx.events_log(t), {"user_id": 7})
    return rows.select(*fx.EVENTS.names, "cdc_operation", "is_deleted", "cdc_timestamp")


@register(
    "raw_versions",
    fx.LINEITEM_CL
    + """SELECT l_orderkey, l_linenumber, count(*) AS versions, CAST(sum(is_deleted) AS BIGINT) AS deletes,
    min(cdc_timestamp) AS first_change, max(cdc_timestamp) AS last_change FROM cl GROUP BY l_orderkey, l_linenumber""",
)
def raw_versions(t: Tables) -> DataFrame:
    return fx.lineitem_log(t).groupBy(*LINE_KEYS).agg(
        F.count("*").alias("versions"),
        F.sum("is_deleted").alias("deletes"),
        F.min("cdc_timestamp").alias("first_change"),
        F.max("cdc_timestamp").alias("last_change"),
    )


@register(
    "as_of_state",
    fx.LINEITEM_CL
    + f"""SELECT {fx.LINEITEM_COLUMNS}, op AS cdc_operation, cdc_timestamp FROM (SELECT *, row_number() OVER
    (PARTITION BY l_orderkey, l_linenumber ORDER BY cdc_timestamp DESC, seq DESC) AS rn FROM cl
    WHERE cdc_timestamp <= TIMESTAMP '1998-01-01') WHERE rn = 1 AND is_deleted = 0""",
)
def as_of_state(t: Tables) -> DataFrame:
    rows = v.as_of(fx.lineitem_log(t), LINE_KEYS, datetime(1998, 1, 1)).filter("is_deleted = 0")
    return rows.select(*fx.LINEITEM.names, "cdc_operation", "cdc_timestamp")


@register(
    "as_of_many",
    fx.EVENTS_CL
    + """, asked AS (SELECT user_id, unnest([TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12 12:00:00', TIMESTAMP '2024-01-20', TIMESTAMP '1990-01-01']) AS "at" FROM (SELECT DISTINCT user_id FROM events)),
    v AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY user_id, cdc_timestamp ORDER BY seq DESC) = 1)
    SELECT a.user_id, a."at", v.event_type, v.amount, CAST(v.seq AS DOUBLE) AS "offset" FROM asked a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a."at" >= v.cdc_timestamp""",
)
def as_of_many(t: Tables) -> DataFrame:
    """Every user's state at four moments, in one pass over the log."""
    moments = F.array(*[v.moment(datetime(*m)) for m in ((2024, 1, 5), (2024, 1, 12, 12), (2024, 1, 20), (1990, 1, 1))])
    asked = t.events.select("user_id").distinct().select("user_id", F.explode(moments).alias("at"))
    found = v.as_of_many(fx.events_log(t), ["user_id"], asked)
    return found.select("user_id", "at", "version.event_type", "version.amount", F.col("version.offset").cast("double").alias("offset"))


@register(
    "changed_since",
    fx.LINEITEM_CL + f"SELECT {LINE_SQL} FROM latest WHERE cdc_timestamp >= TIMESTAMP '2000-01-01'",
)
def changed_since(t: Tables) -> DataFrame:
    rows = v.latest(fx.lineitem_log(t), LINE_KEYS).filter(F.col("cdc_timestamp") >= v.moment(datetime(2000, 1, 1)))
    return rows.select(*LINE_OUT)


@register(
    "compact_partition",
    fx.LINEITEM_CL
    + f"""SELECT yyyymm, {LINE_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY yyyymm, l_orderkey, l_linenumber
    ORDER BY cdc_timestamp DESC, seq DESC) AS rn FROM cl) WHERE rn = 1""",
)
def compact_partition(t: Tables) -> DataFrame:
    return v.compact(fx.lineitem_log(t), LINE_KEYS, "partition").select("yyyymm", *LINE_OUT)


@register("compact_global", fx.LINEITEM_CL + f"SELECT yyyymm, {LINE_SQL} FROM latest")
def compact_global(t: Tables) -> DataFrame:
    return v.compact(fx.lineitem_log(t), LINE_KEYS).select("yyyymm", *LINE_OUT)


@register(
    "compact_then_latest",
    fx.LINEITEM_CL + f"SELECT {LINE_SQL} FROM latest",
)
def compact_then_latest(t: Tables) -> DataFrame:
    shorter = v.compact(fx.lineitem_log(t), LINE_KEYS, "partition")
    return v.latest(shorter, LINE_KEYS).select(*LINE_OUT)


@register(
    "expire_deleted",
    fx.LINEITEM_CL
    + f"""SELECT {LINE_SQL} FROM cl WHERE NOT EXISTS (SELECT 1 FROM latest e WHERE e.is_deleted = 1
    AND e.cdc_timestamp < TIMESTAMP '1999-01-01' - INTERVAL 90 DAY
    AND e.l_orderkey = cl.l_orderkey AND e.l_linenumber = cl.l_linenumber)""",
)
def expire_deleted(t: Tables) -> DataFrame:
    return v.expire_deleted(fx.lineitem_log(t), LINE_KEYS, datetime(1999, 1, 1)).select(*LINE_OUT)


@register(
    "retain_log",
    """SELECT event_id AS "offset", ts AS "timestamp" FROM events
    WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 168 HOUR""",
)
def retain_log(t: Tables) -> DataFrame:
    messages = fx.event_messages(t.events)
    end = t.events.agg(F.max("ts").cast("timestamp")).scalar()
    return retain(messages, 168 * 3_600_000, end).select("offset", "timestamp")


@register(
    "retain_by_topic",
    """SELECT user_id % 3 AS topic_no, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events)
    - CASE user_id % 3 WHEN 0 THEN INTERVAL 24 HOUR WHEN 1 THEN INTERVAL 168 HOUR ELSE INTERVAL 100 YEAR END GROUP BY 1""",
)
def retain_by_topic(t: Tables) -> DataFrame:
    messages = fx.event_messages(t.events).withColumn("topic", F.concat(F.lit("t"), F.col("partition").cast("string")))
    end = t.events.agg(F.max("ts").cast("timestamp")).scalar()
    kept = retain(messages, {"t0": 24 * 3_600_000, "t1": 168 * 3_600_000}, end)
    return kept.groupBy(F.col("partition").cast("bigint").alias("topic_no")).agg(F.count("*").alias("n"))


@register(
    "migrate_add_column",
    fx.LINEITEM_CL
    + f"SELECT {fx.LINEITEM_COLUMNS}, op AS cdc_operation, cdc_timestamp, 0 AS is_deleted FROM cl WHERE op IN ('c', 'u')",
)
def migrate_add_column(t: Tables) -> DataFrame:
    old = decode(fx.lineitem_messages(t.lineitem), fx.LINEITEM, deletes=False).drop("topic", "partition", "offset")
    return migrate(old, fx.LINEITEM).select(*LINE_OUT)


@register("replay_idempotent", fx.EVENTS_CL + "SELECT user_id, event_type, amount, is_deleted FROM latest")
def replay_idempotent(t: Tables) -> DataFrame:
    """The whole topic delivered twice, then resolved."""
    log = fx.events_log(t)
    return v.latest(union_all([log, log]), ["user_id"]).select(*fx.EVENTS.names, "is_deleted")


_PRINCIPALS_KEYS = {"log_key": "tconst, ordering, nconst", "source_key": "tconst, ordering"}


def _register_principals(label: str, keys: str) -> None:
    @register(
        f"principals_by_{label}",
        fx.title_log_sql("title_principals")
        + f""" SELECT tconst, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
        ORDER BY cdc_timestamp DESC, seq DESC) AS rn FROM cl) WHERE rn = 1 AND is_deleted = 0 GROUP BY tconst""",
    )
    def principals(t: Tables) -> DataFrame:
        spec = fx.TITLE_TABLES["title_principals"]
        log = decode(fx.title_messages(t, spec.name), spec)
        by = spec.keys if label == "log_key" else spec.source_pk
        return v.active(log, by).groupBy("tconst").agg(F.count("*").alias("n"))


for _label, _keys in _PRINCIPALS_KEYS.items():
    _register_principals(_label, _keys)
