"""Changelogs derived from the given tables, and their SQL twins.

``events`` becomes a well-ordered stream keyed by user. ``lineitem`` becomes a log with a
two-column key, whole-day versions (so versions tie) and months far apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changelake.functions import yyyymm
from changelake.operators.envelope import decode, encode
from changelake.plans.registry import Tables, spread
from changelake.specs import TITLE_TABLES, TableSpec, table

EVENTS = table("events", "user_id:int64 event_type:string amount:float64", keys="user_id")
LINEITEM = table(
    "lineitem",
    "l_orderkey:int64 l_linenumber:int64 l_partkey:int64 l_quantity:float64 l_linestatus:string",
    keys="l_orderkey l_linenumber",
)
ORDERS = table(
    "orders",
    "o_orderkey:int64 o_custkey:int64 o_orderstatus:string o_totalprice:float64 o_orderpriority:string",
    keys="o_orderkey",
)
CUSTOMER = table(
    "customer",
    "c_custkey:int64 c_name:string c_nationkey:int64 c_acctbal:float64 c_mktsegment:string",
    keys="c_custkey",
)


def millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def _envelopes(rows: DataFrame, spec: TableSpec, op: Column, ts_ms: Column, *extra: Column) -> DataFrame:
    image = F.struct(*[F.col(c.name).cast(c.json_type).alias(c.name) for c in spec.columns])
    none = F.lit(None).cast(spec.row_schema)
    rows = rows.withColumn("_op", op).withColumn("_image", image)
    return rows.select(
        F.col("_op").alias("op"),
        F.when(F.col("_op") == "d", F.col("_image")).otherwise(none).alias("before"),
        F.when(F.col("_op") == "d", none).otherwise(F.col("_image")).alias("after"),
        ts_ms.alias("ts_ms"),
        *extra,
    )


# --- events ------------------------------------------------------------------------


def event_envelopes(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "signup", "r").when(kind == "view", "c").when(kind == "error", "d").otherwise("u")
    rows = events.withColumn("amount", F.col("value"))
    return _envelopes(
        rows,
        EVENTS,
        op,
        millis("ts"),
        F.lit("cdc.demo.events").alias("topic"),
        (F.col("user_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def event_messages(events: DataFrame) -> DataFrame:
    used = events.select("event_id", "ts", "user_id", "event_type", "value")
    return encode(event_envelopes(spread(used)), EVENTS)


def events_log(t: Tables) -> DataFrame:
    """Through JSON text, as the messages of a topic arrive."""
    return decode(event_messages(t.events), EVENTS)


EVENTS_CL = """
WITH cl AS (SELECT user_id, event_id AS seq, ts AS raw_ts,
  CASE event_type WHEN 'signup' THEN 'r' WHEN 'view' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
  CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS event_type,
  CASE WHEN event_type = 'error' THEN 0 ELSE value END AS amount,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_deleted,
  date_trunc('second', ts) AS cdc_timestamp FROM events),
latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY cdc_timestamp DESC, seq DESC) AS rn FROM cl) WHERE rn = 1)
"""


# --- lineitem ----------------------------------------------------------------------


def lineitem_envelopes(lineitem: DataFrame) -> DataFrame:
    flag = F.col("l_returnflag")
    op = F.when(flag == "N", "c").when(flag == "A", "u").otherwise("d")
    return _envelopes(
        lineitem,
        LINEITEM,
        op,
        millis("l_shipdate"),
        F.lit("cdc.demo.lineitem").alias("topic"),
        (F.col("l_orderkey") % 5).cast("int").alias("partition"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("offset"),
    )


def lineitem_messages(lineitem: DataFrame) -> DataFrame:
    used = lineitem.select(*LINEITEM.names, "l_suppkey", "l_returnflag", "l_shipdate")
    return encode(lineitem_envelopes(spread(used)), LINEITEM)


def lineitem_log(t: Tables) -> DataFrame:
    """The log as it is stored, made without the detour through messages: plain key columns,
    so filters on them can reach the scan."""
    flag = F.col("l_returnflag")
    op = F.when(flag == "N", "c").when(flag == "A", "u").otherwise("d")
    gone = flag == "R"
    version = F.date_trunc("second", F.col("l_shipdate").cast("timestamp"))
    return spread(t.lineitem, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.when(gone, 0).otherwise(F.col("l_partkey")).alias("l_partkey"),
        F.when(gone, 0.0).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(gone, "").otherwise(F.col("l_linestatus")).alias("l_linestatus"),
        op.alias("cdc_operation"),
        version.alias("cdc_timestamp"),
        gone.cast("smallint").alias("is_deleted"),
        F.current_timestamp().alias("processing_time"),
        F.lit("cdc.demo.lineitem").alias("topic"),
        (F.col("l_orderkey") % 5).cast("int").alias("partition"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("offset"),
        yyyymm(version).alias("yyyymm"),
    )


LINEITEM_CL = """
WITH cl AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  l_partkey * 1000000 + l_suppkey AS seq,
  CASE l_returnflag WHEN 'N' THEN 'c' WHEN 'A' THEN 'u' ELSE 'd' END AS op,
  CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_partkey END AS l_partkey,
  CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS l_quantity,
  CASE WHEN l_returnflag = 'R' THEN '' ELSE l_linestatus END AS l_linestatus,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_deleted,
  CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS yyyymm,
  date_trunc('second', l_shipdate) AS cdc_timestamp FROM lineitem),
latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY cdc_timestamp DESC, seq DESC) AS rn FROM cl) WHERE rn = 1)
"""
LINEITEM_COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_linestatus"


# --- the seven title and name tables -------------------------------------------------

# Source rows in SQL both engines read: operation, version time, offset and the row as the
# source holds it, with nulls, blanks and numbers too big for their unsigned type.
_LINE = (
    "CASE l_returnflag WHEN 'N' THEN 'c' WHEN 'A' THEN 'u' ELSE 'd' END AS op, l_shipdate AS ts,"
    " ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS seq"
)
_ORDER = (
    "CASE o_orderstatus WHEN 'O' THEN 'c' WHEN 'F' THEN 'u' ELSE 'd' END AS op, o_orderdate AS ts, o_orderkey AS seq"
)
_EVENT = (
    "CASE event_type WHEN 'signup' THEN 'r' WHEN 'view' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,"
    " ts, event_id AS seq"
)


def _id(prefix: str, column: str) -> str:
    return f"'{prefix}' || lpad(CAST({column} AS STRING), 9, '0')"


TITLE_SOURCES = {
    "title_ratings": (
        "lineitem",
        f"SELECT {_LINE}, {_id('tt', 'l_partkey')} AS tconst, l_quantity / 5 AS averageRating,"
        " CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey * 300000 END AS numVotes",
    ),
    "title_basics": (
        "orders",
        f"SELECT {_ORDER}, {_id('tt', 'o_custkey')} AS tconst, substring(o_orderpriority, 3) AS titleType,"
        " 'Title ' || CAST(o_orderkey AS STRING) AS primaryTitle,"
        " CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Spëcïål ' || o_orderpriority END AS originalTitle,"
        " o_orderkey % 700 AS isAdult, 1900 + o_orderkey * 7 AS startYear,"
        " CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS endYear, o_custkey % 240 AS runtimeMinutes,"
        " CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN NULL"
        " ELSE replace(o_orderpriority, '-', ',') END AS genres",
    ),
    "name_basics": (
        "events",
        f"SELECT {_EVENT}, {_id('nm', 'user_id')} AS nconst, event_type || ' person' AS primaryName,"
        " 1900 + event_id % 120 AS birthYear, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 2000 END AS deathYear,"
        " event_type || ',' || event_type AS primaryProfession,"
        f" CASE WHEN event_id % 3 = 0 THEN '' ELSE {_id('tt', 'event_id')} END AS knownForTitles",
    ),
    "title_crew": (
        "lineitem",
        f"SELECT {_LINE}, {_id('tt', 'l_orderkey')} AS tconst,"
        f" {_id('nm', 'l_partkey')} || ',' || {_id('nm', 'l_suppkey')} AS directors,"
        f" CASE WHEN l_linenumber = 1 THEN NULL ELSE {_id('nm', 'l_suppkey')} END AS writers",
    ),
    "title_episode": (
        "lineitem",
        f"SELECT {_LINE}, {_id('tt', 'l_partkey')} AS tconst, {_id('tt', 'l_orderkey')} AS parentTconst,"
        " CAST(l_linenumber AS BIGINT) AS seasonNumber, l_suppkey * 1000 AS episodeNumber",
    ),
    "title_akas": (
        "lineitem",
        f"SELECT {_LINE}, {_id('tt', 'l_orderkey')} AS titleId, CAST(l_linenumber AS BIGINT) AS ordering,"
        " 'aka ' || CAST(l_partkey AS STRING) AS title,"
        " CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_linestatus END AS region, l_linestatus AS language,"
        " 'alternative,' || l_returnflag AS types, '' AS attributes, CAST(l_linenumber % 2 AS BIGINT) AS isOriginalTitle",
    ),
    "title_principals": (
        "lineitem",
        f"SELECT {_LINE}, {_id('tt', 'l_orderkey')} AS tconst, CAST(l_linenumber AS BIGINT) AS ordering,"
        f" {_id('nm', 'l_suppkey')} AS nconst, 'category ' || l_linestatus AS category,"
        " CASE WHEN l_linenumber = 2 THEN NULL ELSE 'job' END AS job,"
        " 'a,b,' || CAST(l_partkey AS STRING) AS characters",
    ),
}


def title_messages(t: Tables, name: str, given_rows: DataFrame | None = None) -> DataFrame:
    spec = TITLE_TABLES[name]
    given, select = TITLE_SOURCES[name]
    rows = spread(t.spark.sql(select + " FROM {src}", src=t(given) if given_rows is None else given_rows))
    envelopes = _envelopes(
        rows,
        spec,
        F.col("op"),
        millis("ts"),
        F.lit(f"cdc.imdb.{name}").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("seq").alias("offset"),
    )
    return encode(envelopes, spec)


def title_log_sql(name: str, deletes: bool = True) -> str:
    """CTEs ``src`` and ``cl``: the decoded log of a title table."""
    spec = TITLE_TABLES[name]
    given, select = TITLE_SOURCES[name]
    out = []
    for c in spec.columns:
        x = f"src.{c.name}"
        if c.kind == "list":
            value = f"coalesce({x}, '')"
            size = f"len(string_split({value}, ','))"
            if deletes:
                value = f"CASE WHEN op = 'd' THEN '' ELSE {value} END"
                size = f"CASE WHEN op = 'd' THEN 0 ELSE {size} END"
            out += [f"{value} AS {c.name}", f"CAST({size} AS BIGINT) AS {c.name}_size"]
            continue
        default = "''" if c.kind == "string" else "0"
        if c.modulus:
            sql_type = {"uint8": "INTEGER", "uint16": "INTEGER", "uint32": "BIGINT"}[c.kind]
            value = f"CAST(coalesce({x} % {c.modulus}, 0) AS {sql_type})"
        elif c.kind == "float32":
            value = f"round(CAST(CAST(coalesce({x}, 0) AS FLOAT) AS DOUBLE), 4)"
        else:
            value = f"coalesce({x}, {default})"
        if deletes and c.name not in spec.keys:
            value = f"CASE WHEN op = 'd' THEN {default} ELSE {value} END"
        out.append(f"{value} AS {c.name}")
    flag = ", CASE WHEN op = 'd' THEN 1 ELSE 0 END AS is_deleted" if deletes else ""
    where = "" if deletes else " WHERE op IN ('c', 'u', 'r')"
    return (
        f"WITH src AS ({select} FROM {given}), cl AS (SELECT {', '.join(out)}, op AS cdc_operation,"
        f" date_trunc('second', ts) AS cdc_timestamp{flag}, seq FROM src{where})"
    )
