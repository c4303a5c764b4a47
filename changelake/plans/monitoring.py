"""Audit, aggregate, top-k and lag queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from changelake.functions import has_prefix
from changelake.operators import audit
from changelake.operators.ranks import ranked
from changelake.operators.reconcile import alerts, random_keys
from changelake.operators.versions import active, latest, of_keys
from changelake.plans import fixtures as fx
from changelake.plans.registry import Tables, as_doubles, register
from changelake.streaming import lag

SEVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def last_change(t: Tables):
    return t.events.agg(F.date_trunc("second", F.max("ts").cast("timestamp"))).scalar()


@register(
    "op_counts_recent",
    fx.EVENTS_CL
    + """SELECT op AS cdc_operation, count(*) AS "count" FROM latest
    WHERE cdc_timestamp >= (SELECT max(cdc_timestamp) FROM cl) - INTERVAL 7 DAY GROUP BY op""",
)
def op_counts_recent(t: Tables) -> DataFrame:
    return audit.op_counts(fx.events_log(t), ["user_id"], "7 days", last_change(t))


@register(
    "today_only",
    fx.EVENTS_CL
    + """SELECT op AS cdc_operation, count(*) AS n FROM cl
    WHERE CAST(cdc_timestamp AS DATE) = (SELECT CAST(max(cdc_timestamp) AS DATE) FROM cl) GROUP BY op""",
)
def today_only(t: Tables) -> DataFrame:
    rows = audit.on_day(fx.events_log(t), last_change(t))
    return rows.groupBy("cdc_operation").agg(F.count("*").alias("n"))


@register(
    "op_rates_minute",
    fx.EVENTS_CL
    + """SELECT date_trunc('minute', cdc_timestamp) AS "minute", count(*) FILTER (op = 'd') AS deletes,
    count(*) FILTER (op = 'c') AS inserts, count(*) FILTER (op = 'u') AS updates FROM cl GROUP BY 1 ORDER BY 1 DESC""",
)
def op_rates_minute(t: Tables) -> DataFrame:
    return audit.op_rates(fx.events_log(t)).orderBy(F.col("minute").desc())


@register(
    "summary_lineitem",
    fx.LINEITEM_CL
    + """SELECT 'Total Records' AS category, count(*) AS "count" FROM latest
    UNION ALL SELECT 'Active Records', count(*) FROM latest WHERE is_deleted = 0
    UNION ALL SELECT 'Deleted Records', count(*) FROM latest WHERE is_deleted = 1""",
)
def summary_lineitem(t: Tables) -> DataFrame:
    return audit.summary(fx.lineitem_log(t), fx.LINEITEM.keys)


@register(
    "agg_global",
    fx.LINEITEM_CL
    + """SELECT count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean,
    max(l_quantity) AS highest, min(l_quantity) AS lowest FROM latest WHERE is_deleted = 0""",
)
def agg_global(t: Tables) -> DataFrame:
    return active(fx.lineitem_log(t), fx.LINEITEM.keys).agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("total"),
        F.round(F.avg("l_quantity"), 6).alias("mean"),
        F.max("l_quantity").alias("highest"),
        F.min("l_quantity").alias("lowest"),
    )


@register(
    "agg_by_type",
    fx.LINEITEM_CL + "SELECT l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total FROM latest WHERE is_deleted = 0 GROUP BY 1",
)
def agg_by_type(t: Tables) -> DataFrame:
    rows = active(fx.lineitem_log(t), fx.LINEITEM.keys)
    return rows.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@register(
    "agg_having",
    fx.LINEITEM_CL
    + """SELECT l_partkey, count(*) AS n, max(l_quantity) AS highest FROM latest WHERE is_deleted = 0
    GROUP BY l_partkey HAVING count(*) > 15""",
)
def agg_having(t: Tables) -> DataFrame:
    rows = active(fx.lineitem_log(t), fx.LINEITEM.keys)
    grouped = rows.groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("highest"))
    return grouped.filter("n > 15")


_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in SEVEN)


@register(
    "table_counts",
    f"WITH c AS ({_COUNTS}) SELECT * FROM c UNION ALL SELECT 'TOTAL', CAST(sum(row_count) AS BIGINT) FROM c",
)
def table_counts(t: Tables) -> DataFrame:
    return audit.table_counts({n: t(n) for n in SEVEN})


@register(
    "partition_plan",
    f"SELECT table_name, row_count, greatest(CAST(ceil(row_count / 10000.0) AS BIGINT), 1) AS partitions FROM ({_COUNTS})",
)
def partition_plan(t: Tables) -> DataFrame:
    return audit.partition_plan(audit.table_counts({n: t(n) for n in SEVEN}, total=None), per=10_000)


@register(
    "p95_by_type",
    "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS percentile FROM events GROUP BY event_type",
)
def p95_by_type(t: Tables) -> DataFrame:
    rows = audit.exact_percentile(t.events, "value", 0.95, ["event_type"])
    return rows.select("event_type", F.round("percentile", 6).alias("percentile"))


@register("p95_overall", "SELECT round(quantile_cont(l_extendedprice, 0.95), 6) AS percentile FROM lineitem")
def p95_overall(t: Tables) -> DataFrame:
    rows = audit.exact_percentile(t.lineitem, "l_extendedprice", 0.95)
    return rows.select(F.round("percentile", 6).alias("percentile"))


@register("p95_approximate")
def p95_approximate(t: Tables) -> DataFrame:
    """Sketch answer: no SQL twin, tested against its error bound."""
    return audit.percentile(t.events, "value", 0.95, ["event_type"])


@register("prefix_match", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%'")
def prefix_match(t: Tables) -> DataFrame:
    return t.part.filter(has_prefix("p_name", "small")).select("p_partkey", "p_name")


@register("prefix_match_ignoring_case", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'SMALL%'")
def prefix_match_ignoring_case(t: Tables) -> DataFrame:
    return t.part.filter(has_prefix("p_name", "SMALL", ignore_case=True)).select("p_partkey", "p_name")


@register("key_list", fx.LINEITEM_CL + "SELECT l_orderkey, l_linenumber, is_deleted FROM latest WHERE l_orderkey IN (1, 5, 77, 140)")
def key_list(t: Tables) -> DataFrame:
    """Current state of listed keys; the list is the feature and reaches the file scan."""
    rows = current_lines(t).filter(F.col("l_orderkey").isin(1, 5, 77, 140))
    return rows.select("l_orderkey", "l_linenumber", "is_deleted")


@register(
    "key_list_long",
    fx.LINEITEM_CL
    + """SELECT l_orderkey, l_linenumber, is_deleted FROM latest
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def key_list_long(t: Tables) -> DataFrame:
    """A key list too long for literals: the log is cut to it before it is resolved."""
    wanted = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = latest(of_keys(fx.lineitem_log(t), wanted, ["l_orderkey"]), fx.LINEITEM.keys)
    return rows.select("l_orderkey", "l_linenumber", "is_deleted")


def current_lines(t: Tables) -> DataFrame:
    return latest(fx.lineitem_log(t), fx.LINEITEM.keys)


@register(
    "point_lookup",
    fx.LINEITEM_CL + "SELECT l_orderkey, l_linenumber, l_quantity FROM latest WHERE is_deleted = 0 AND l_orderkey = 8 AND l_linenumber = 2",
)
def point_lookup(t: Tables) -> DataFrame:
    """One key; the filter reaches the file scan."""
    rows = active(fx.lineitem_log(t), fx.LINEITEM.keys).filter("l_orderkey = 8 AND l_linenumber = 2")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@register("best_of_key", "SELECT l_partkey, max(l_quantity) AS best FROM lineitem GROUP BY l_partkey")
def best_of_key(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.max("l_quantity").alias("best"))


@register(
    "top_versions",
    fx.LINEITEM_CL
    + """SELECT l_orderkey, l_linenumber, op AS cdc_operation, cdc_timestamp FROM latest
    ORDER BY cdc_timestamp DESC, l_orderkey, l_linenumber LIMIT 10""",
)
def top_versions(t: Tables) -> DataFrame:
    rows = current_lines(t).select("l_orderkey", "l_linenumber", "cdc_operation", "cdc_timestamp")
    return rows.orderBy(F.col("cdc_timestamp").desc(), "l_orderkey", "l_linenumber").limit(10)


@register("any_rows", "SELECT CAST(3 AS BIGINT) AS n")
def any_rows(t: Tables) -> DataFrame:
    """Any three current rows; only their number is defined."""
    return current_lines(t).limit(3).agg(F.count("*").alias("n"))


@register("random_keys_stable", "SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)) LIMIT 5")
def random_keys_stable(t: Tables) -> DataFrame:
    """Five pseudo-random keys: those of smallest MD5."""
    return random_keys(t.orders, ["o_orderkey"], 5)


@register(
    "random_keys_half",
    """WITH n AS (SELECT count(*) // 2 AS n FROM events) SELECT user_id, event_id FROM (SELECT *, row_number() OVER
    (ORDER BY md5(CAST(user_id AS VARCHAR) || chr(31) || CAST(event_id AS VARCHAR))) AS rn FROM events) WHERE rn <= (SELECT n FROM n)""",
)
def random_keys_half(t: Tables) -> DataFrame:
    """Half of a table as a sample: its rows meet in no task."""
    return random_keys(t.events, ["user_id", "event_id"], t.events.count() // 2)


@register(
    "global_ranks",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS "rank"
    FROM lineitem""",
)
def global_ranks(t: Tables) -> DataFrame:
    """Rank of every row among those of its flag, of which there are three: no window runs over a group."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return ranked(t.lineitem.select("l_returnflag", *order), order, by=["l_returnflag"]).drop("l_shipdate")


# --- alerts ----------------------------------------------------------------------------

DAY_RULES = (("many errors", "error", 60.0), ("many errors, urgent", "error", 75.0), ("busy", "click", 70.0))


@register(
    "alerts",
    """WITH m AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_day, event_type AS metric, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL)
    SELECT event_day, metric, value, rule, threshold FROM m JOIN (VALUES ('many errors', 'error', 60.0::DOUBLE),
    ('many errors, urgent', 'error', 75.0::DOUBLE), ('busy', 'click', 70.0::DOUBLE)) r(rule, of_metric, threshold)
    ON metric = of_metric AND value > threshold""",
)
def alerts_per_day(t: Tables) -> DataFrame:
    day = F.to_date("ts").cast("string").alias("event_day")
    counts = t.events.groupBy(day, F.col("event_type").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return alerts(counts, DAY_RULES)


# --- lag ---------------------------------------------------------------------------------


@register(
    "lag_by_topic",
    """WITH p AS (SELECT event_type AS topic, user_id % 3 AS part, max(event_id) AS last_offset,
      max(event_id) FILTER (ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS done FROM events GROUP BY ALL),
    l AS (SELECT topic, CAST(sum(last_offset - coalesce(done, 0)) AS BIGINT) AS lag FROM p GROUP BY topic)
    SELECT * FROM l UNION ALL SELECT 'TOTAL', CAST(sum(lag) AS BIGINT) FROM l""",
)
def lag_by_topic(t: Tables) -> DataFrame:
    """End offsets against a consumer that stopped a week before the end."""
    end_time = t.events.agg(F.max("ts")).scalar()
    where = [F.col("event_type").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition")]

    def offsets(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*where).agg(F.max("event_id").alias("offset"))

    done = t.events.filter(F.col("ts") < end_time - F.expr("INTERVAL 7 DAYS"))
    return lag.lag_by_topic(offsets(t.events), offsets(done))


_SAMPLES = """s AS (SELECT 't' || CAST(user_id % 3 AS VARCHAR) AS topic, date_trunc('hour', ts) AS sampled_at,
  max(event_id) - min(event_id) AS lag, max(event_id) * 100000 AS records FROM events GROUP BY ALL),
series AS (SELECT topic, sampled_at, lag, records, CAST(lag - lag(lag) OVER w AS DOUBLE) AS lag_change,
  CAST(records - lag(records) OVER w AS DOUBLE) AS record_change,
  trunc((records - lag(records) OVER w) / (epoch(sampled_at) - epoch(lag(sampled_at) OVER w))) AS records_per_second,
  lag < 5 AS caught_up FROM s WINDOW w AS (PARTITION BY topic ORDER BY sampled_at))"""


CHANGES = ("lag_change", "record_change", "records_per_second")


def hourly_samples(t: Tables) -> DataFrame:
    topic = F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("topic")
    last, first = F.max("event_id"), F.min("event_id")
    return t.events.groupBy(topic, F.date_trunc("hour", "ts").alias("sampled_at")).agg(
        (last - first).alias("lag"), (last * 100000).alias("records")
    )


@register("throughput_series", f"WITH {_SAMPLES} SELECT * FROM series")
def throughput_series(t: Tables) -> DataFrame:
    return as_doubles(lag.throughput_series(hourly_samples(t), threshold=5), *CHANGES)


@register(
    "until_caught_up",
    f"""WITH {_SAMPLES} SELECT * FROM series WHERE sampled_at <= coalesce((SELECT min(sampled_at) FROM series x
    WHERE x.topic = series.topic AND x.caught_up), TIMESTAMP '9999-01-01')""",
)
def until_caught_up(t: Tables) -> DataFrame:
    return as_doubles(lag.until_caught_up(lag.throughput_series(hourly_samples(t), threshold=5)), *CHANGES)
