"""Source against replica: the orders table against an edited copy of it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from changelake.functions import split_list
from changelake.operators import checksums, reconcile as rc
from changelake.operators.changes import snapshot_to_changes
from changelake.operators.envelope import resolve
from changelake.operators.versions import active
from changelake.plans import fixtures as fx
from changelake.plans.registry import Tables, register
from changelake.specs import table

FIELDS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]

# The replica misses some rows and holds some wrong or slightly different values.
REPLICA = """
replica AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 19 = 0 THEN o_totalprice + 0.5 WHEN o_orderkey % 23 = 0 THEN o_totalprice + 0.01
    ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 31 <> 0)
"""
_CENTS = "abs(CAST(trunc(s.o_totalprice * 100) AS BIGINT) - CAST(trunc(t.o_totalprice * 100) AS BIGINT)) < 2"


def replica(t: Tables) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return (
        t.orders.select(*fx.ORDERS.names)
        .filter(key % 31 != 0)
        .withColumns(
            {
                "o_orderstatus": F.when(key % 17 == 0, "X").otherwise(F.col("o_orderstatus")),
                "o_totalprice": F.when(key % 19 == 0, price + 0.5).when(key % 23 == 0, price + 0.01).otherwise(price),
                "o_orderpriority": F.when(key % 29 != 0, F.col("o_orderpriority")),
            }
        )
    )


def _cells(fields: list[str]) -> str:
    parts = []
    for f in fields:
        same = _CENTS if f == "o_totalprice" else f"s.{f} IS NOT DISTINCT FROM t.{f}"
        parts.append(
            f"SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, '{f}' AS field,"
            f" s.o_orderkey IS NOT NULL AND t.o_orderkey IS NOT NULL AND coalesce({same}, false) AS ok"
            " FROM orders s FULL JOIN replica t ON s.o_orderkey = t.o_orderkey"
        )
    return " UNION ALL ".join(parts)


@register("field_check", f"WITH {REPLICA} {_cells(FIELDS)}")
def field_check(t: Tables) -> DataFrame:
    return rc.field_check(t.orders, replica(t), fx.ORDERS, FIELDS).select("o_orderkey", "field", "ok")


@register(
    "field_failures",
    f"WITH {REPLICA}, c AS ({_cells(['o_orderstatus'])}) SELECT c.o_orderkey, c.field, s.o_orderstatus AS source_value,"
    " t.o_orderstatus AS target_value, c.ok FROM c LEFT JOIN orders s ON s.o_orderkey = c.o_orderkey"
    " LEFT JOIN replica t ON t.o_orderkey = c.o_orderkey WHERE NOT ok",
)
def field_failures(t: Tables) -> DataFrame:
    return rc.field_check(t.orders, replica(t), fx.ORDERS, ["o_orderstatus"], only_failures=True)


@register(
    "field_summary",
    f"WITH {REPLICA}, c AS ({_cells(FIELDS)}) SELECT field, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM c GROUP BY field",
)
def field_summary(t: Tables) -> DataFrame:
    return rc.field_summary(t.orders, replica(t), fx.ORDERS, FIELDS)


@register(
    "pass_fail",
    f"WITH {REPLICA}, c AS ({_cells(FIELDS)}) SELECT count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, bool_and(ok) AS all_passed FROM c",
)
def pass_fail(t: Tables) -> DataFrame:
    return rc.pass_fail(rc.field_check(t.orders, replica(t), fx.ORDERS, FIELDS))


@register(
    "count_check",
    f"""WITH {REPLICA} SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_count,
    (SELECT count(*) FROM replica) AS target_count, 'FAIL' AS result
    UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer), 'PASS'""",
)
def count_check(t: Tables) -> DataFrame:
    copied = active(resolve(snapshot(t), fx.CUSTOMER).withColumn("offset", F.lit(0)), fx.CUSTOMER.keys)
    return rc.count_check({"orders": t.orders, "customer": t.customer}, {"orders": replica(t), "customer": copied})


def snapshot(t: Tables) -> DataFrame:
    return snapshot_to_changes(t.customer, fx.CUSTOMER, datetime(2002, 1, 1))


@register(
    "count_check_prefix",
    f"""WITH {REPLICA} SELECT 'orders' AS table_name, (SELECT count(*) FROM orders WHERE o_orderpriority LIKE '1%') AS source_count,
    (SELECT count(*) FROM replica WHERE o_orderpriority LIKE '1%') AS target_count, 'FAIL' AS result
    UNION ALL SELECT 'customer', count(*), count(*), 'PASS' FROM customer WHERE c_mktsegment LIKE 'B%'""",
)
def count_check_prefix(t: Tables) -> DataFrame:
    """Each table with a predicate of its own."""
    sources, targets = {"orders": t.orders, "customer": t.customer}, {"orders": replica(t), "customer": t.customer}
    return rc.count_check(sources, targets, {"orders": "o_orderpriority LIKE '1%'", "customer": "c_mktsegment LIKE 'B%'"})


@register(
    "progress",
    f"""WITH {REPLICA}, c AS (SELECT (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM replica) AS t)
    SELECT 'orders' AS table_name, s AS source_count, t AS target_count, CAST(t * 100 // s AS BIGINT) AS percent, t >= s AS done FROM c""",
)
def progress(t: Tables) -> DataFrame:
    return rc.progress({"orders": t.orders}, {"orders": replica(t)})


@register("list_match", "SELECT 'names' AS field, count(*) AS passed, CAST(0 AS BIGINT) AS failed FROM part")
def list_match(t: Tables) -> DataFrame:
    """A list column of the replica against its joined text at the source."""
    spec = table("part", "p_partkey:int64 names:list", keys="p_partkey")
    source = t.part.select("p_partkey", F.translate("p_name", " ", ",").alias("names"))
    target = source.select("p_partkey", split_list("names").alias("names"))
    return rc.field_summary(source, target, spec)


_FAILURES = (
    f"WITH {REPLICA}, c AS ({_cells(FIELDS)}) SELECT c.o_orderkey, c.field, c.ok FROM c WHERE NOT ok"
)


@register("field_failures_by_checksum", _FAILURES)
def field_failures_by_checksum(t: Tables) -> DataFrame:
    """Only rows of ranges whose checksums differ are joined."""
    return checksums.field_failures(t.orders, replica(t), fx.ORDERS, FIELDS).select("o_orderkey", "field", "ok")


LOCAL = "local_replica AS (SELECT * REPLACE (CASE WHEN o_orderkey BETWEEN 100 AND 120 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_orderkey <> 777)"


@register(
    "field_summary_by_checksum",
    f"WITH {LOCAL}, j AS (SELECT s.o_orderkey AS a, t.o_orderkey AS b, s.o_orderstatus AS x, t.o_orderstatus AS y FROM orders s FULL JOIN local_replica t USING (o_orderkey))"
    " SELECT f AS field, count(*) FILTER (b IS NOT NULL AND (f <> 'o_orderstatus' OR x = y)) AS passed,"
    " count(*) FILTER (NOT (b IS NOT NULL AND (f <> 'o_orderstatus' OR x = y))) AS failed FROM j,"
    " (VALUES ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderpriority')) v(f) GROUP BY f",
)
def field_summary_by_checksum(t: Tables) -> DataFrame:
    """A replica with a few neighbouring edits and a missing row: of the table, their ranges are joined."""
    return checksums.summary(t.orders, local_replica(t), fx.ORDERS, FIELDS)


def local_replica(t: Tables) -> DataFrame:
    edited = F.when(F.col("o_orderkey").between(100, 120), "X").otherwise(F.col("o_orderstatus"))
    return t.orders.select(*fx.ORDERS.names).filter("o_orderkey <> 777").withColumn("o_orderstatus", edited)


@register(
    "differing_ranges",
    f"""WITH {LOCAL}, s AS (SELECT o_orderkey >> 12 AS range, count(*) AS n FROM orders GROUP BY 1),
    d AS (SELECT DISTINCT o_orderkey >> 12 AS range FROM orders WHERE o_orderkey BETWEEN 100 AND 120 AND o_orderstatus <> 'X' OR o_orderkey = 777)
    SELECT CAST(range AS BIGINT) AS range, n AS source_rows, (SELECT count(*) FROM local_replica WHERE o_orderkey >> 12 = range) AS target_rows FROM s JOIN d USING (range)""",
)
def differing_ranges(t: Tables) -> DataFrame:
    trees = [checksums.checksum_tree(side, fx.ORDERS, FIELDS) for side in (t.orders, local_replica(t))]
    found = checksums.differing_ranges(*trees)
    return found.where(F.col("depth") == checksums.DEPTHS).drop("depth")


@register(
    "sample_check",
    f"WITH {REPLICA}, c AS ({_cells(FIELDS)}) SELECT * FROM c WHERE o_orderkey IN"
    " (SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)) LIMIT 200)",
)
def sample_check(t: Tables) -> DataFrame:
    """Field check of random keys; the pick is a hash both engines have."""
    return rc.sample_check(t.orders, replica(t), fx.ORDERS, 200, FIELDS).select("o_orderkey", "field", "ok")
