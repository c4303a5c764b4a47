"""Decode queries: envelopes to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from changelake.functions import join_list, narrow, split_list
from changelake.operators.envelope import decode, decode_legacy, rejects
from changelake.operators.versions import active_view
from changelake.plans import fixtures as fx
from changelake.plans.registry import Tables, as_doubles, register
from changelake.specs import TITLE_TABLES
from pyspark.sql import types as T

EVENT_OUT = ["user_id", "event_type", "amount", "cdc_operation", "cdc_timestamp", "is_deleted", "offset"]


@register(
    "decode_full",
    fx.EVENTS_CL
    + 'SELECT user_id, event_type, amount, op AS cdc_operation, cdc_timestamp, is_deleted, seq AS "offset" FROM cl',
)
def decode_full(t: Tables) -> DataFrame:
    return fx.events_log(t).select(*EVENT_OUT)


@register(
    "decode_legacy",
    fx.EVENTS_CL
    + """SELECT user_id, event_type, amount, op AS cdc_operation, cdc_timestamp, seq AS "offset"
    FROM cl WHERE op IN ('c', 'u', 'r')""",
)
def decode_legacy_events(t: Tables) -> DataFrame:
    log = decode_legacy(fx.event_messages(t.events), fx.EVENTS)
    return log.select(*[c for c in EVENT_OUT if c != "is_deleted"])


@register(
    "decode_lineitem",
    fx.LINEITEM_CL
    + f'SELECT {fx.LINEITEM_COLUMNS}, op AS cdc_operation, cdc_timestamp, is_deleted, yyyymm, seq AS "offset" FROM cl',
)
def decode_lineitem(t: Tables) -> DataFrame:
    log = decode(fx.lineitem_messages(t.lineitem), fx.LINEITEM)
    return log.drop("processing_time", "topic", "partition")


def damaged(messages: DataFrame) -> DataFrame:
    """All messages, some spoiled: null text, broken JSON, unknown operation, missing key."""
    spoil = F.col("offset") % 100
    text = F.col("value")
    value = (
        F.when(spoil == 0, F.lit(None).cast("string"))
        .when(spoil == 25, F.concat(F.lit("{oops "), text))
        .when(spoil == 50, F.regexp_replace(text, '"op":"."', '"op":"x"'))
        .when(spoil == 75, F.regexp_replace(text, '"user_id":[0-9]+', '"user_id":null'))
        .otherwise(text)
    )
    return messages.withColumn("value", value)


@register(
    "decode_rejects",
    """SELECT event_id AS "offset", CAST(user_id % 3 AS INTEGER) AS "partition",
    CASE event_id % 100 WHEN 0 THEN 'null message' WHEN 25 THEN 'malformed'
      WHEN 50 THEN 'unknown operation' ELSE 'blank key' END AS reason
    FROM events WHERE event_id % 100 IN (0, 25, 50, 75)""",
)
def decode_rejects(t: Tables) -> DataFrame:
    return rejects(damaged(fx.event_messages(t.events)), fx.EVENTS).select("offset", "partition", "reason")


@register(
    "decode_accepts",
    fx.EVENTS_CL + "SELECT op AS cdc_operation, count(*) AS n FROM cl WHERE seq % 100 NOT IN (0, 25, 50, 75) GROUP BY op",
)
def decode_accepts(t: Tables) -> DataFrame:
    return decode(damaged(fx.event_messages(t.events)), fx.EVENTS).groupBy("cdc_operation").agg(F.count("*").alias("n"))


# --- lists and narrowing -------------------------------------------------------------


def names_as_lists(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", split_list(F.translate("p_name", " ", ",")).alias("names"))


@register(
    "decode_lists",
    "SELECT p_partkey, replace(p_name, ' ', ',') AS names, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS names_size FROM part",
)
def decode_lists(t: Tables) -> DataFrame:
    return names_as_lists(t)


@register("list_join", "SELECT p_partkey, replace(p_name, ' ', ',') AS joined FROM part")
def list_join(t: Tables) -> DataFrame:
    return names_as_lists(t).select("p_partkey", join_list("names").alias("joined"))


@register(
    "list_size",
    "SELECT CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n_names, count(*) AS n FROM part GROUP BY 1",
)
def list_size(t: Tables) -> DataFrame:
    size = F.size("names").cast("bigint").alias("n_names")
    return names_as_lists(t).groupBy(size).agg(F.count("*").alias("n"))


@register(
    "list_explode_counts",
    "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word",
)
def list_explode_counts(t: Tables) -> DataFrame:
    words = names_as_lists(t).select(F.explode("names").alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


@register(
    "list_empty_policies",
    """SELECT lang, CAST(sum(len(string_split(text, ','))) AS BIGINT) AS blank_kept,
    CAST(sum(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ',')) END) AS BIGINT) AS blank_empty
    FROM (SELECT lang, text FROM documents UNION ALL SELECT lang, '' AS text FROM documents) GROUP BY lang""",
)
def list_empty_policies(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", F.explode(F.array("text", F.lit(""))).alias("text"))
    return rows.groupBy("lang").agg(
        F.sum(F.size(split_list("text"))).alias("blank_kept"),
        F.sum(F.size(split_list("text", "empty"))).alias("blank_empty"),
    )


@register(
    "narrow_wrap",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(l_partkey % 256 AS INTEGER) AS as_uint8,
    CAST((l_orderkey * 1000) % 65536 AS INTEGER) AS as_uint16 FROM lineitem""",
)
def narrow_wrap(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_partkey",
        narrow("l_partkey", 2**8, T.ShortType()).alias("as_uint8"),
        narrow(F.col("l_orderkey") * 1000, 2**16, T.IntegerType()).alias("as_uint16"),
    )


@register(
    "narrow_null",
    """SELECT CAST(CASE WHEN l_partkey < 256 THEN l_partkey END AS DOUBLE) AS as_uint8, count(*) AS n
    FROM lineitem GROUP BY 1""",
)
def narrow_null(t: Tables) -> DataFrame:
    fitted = narrow("l_partkey", 2**8, T.ShortType(), "null").alias("as_uint8")
    return as_doubles(t.lineitem.groupBy(fitted).agg(F.count("*").alias("n")), "as_uint8")


# --- the seven title and name tables ---------------------------------------------------


def _register_title(name: str) -> None:
    spec = TITLE_TABLES[name]
    own = ", ".join([c.name + (f", {c.name}_size" if c.kind == "list" else "") for c in spec.columns])
    keys = ", ".join(spec.keys)

    @register(
        f"decode_{name}",
        fx.title_log_sql(name) + f' SELECT {own}, cdc_operation, cdc_timestamp, is_deleted, seq AS "offset" FROM cl',
    )
    def decoded(t: Tables) -> DataFrame:
        log = decode(fx.title_messages(t, name), spec)
        return log.select(*spec.names, "cdc_operation", "cdc_timestamp", "is_deleted", "offset")

    @register(
        f"legacy_{name}",
        fx.title_log_sql(name, deletes=False) + f' SELECT {own}, cdc_operation, cdc_timestamp, seq AS "offset" FROM cl',
    )
    def legacy(t: Tables) -> DataFrame:
        log = decode_legacy(fx.title_messages(t, name), spec)
        return log.select(*spec.names, "cdc_operation", "cdc_timestamp", "offset")

    @register(
        f"active_{name}",
        fx.title_log_sql(name)
        + f""" SELECT {own}, cdc_operation, cdc_timestamp FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
        ORDER BY cdc_timestamp DESC, seq DESC) AS rn FROM cl) WHERE rn = 1 AND is_deleted = 0""",
    )
    def current(t: Tables) -> DataFrame:
        return active_view(decode(fx.title_messages(t, name), spec), spec)


for _name in TITLE_TABLES:
    _register_title(_name)
