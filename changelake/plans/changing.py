"""Queries that produce changes: snapshots, diffs and row statements."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from changelake.operators import changes as ch
from changelake.operators.audit import union_all
from changelake.operators.envelope import decode, encode, resolve
from changelake.operators.versions import active, latest
from changelake.plans import fixtures as fx
from changelake.plans.registry import Tables, register

AT = datetime(2002, 1, 1, 12, 0, 0)

# The orders table as it looks later: some rows gone, some changed, some new.
ORDERS_LATER = """
new_orders AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 1 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 11 = 3 THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice, o_orderpriority
  FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT o_orderkey + 10000000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
  FROM orders WHERE o_orderkey % 13 = 0)
"""


def orders_later(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    rows = t.orders.select(*fx.ORDERS.names)
    edited = rows.filter(key % 7 != 0).withColumns(
        {
            "o_orderstatus": F.when(key % 5 == 1, "F").otherwise(F.col("o_orderstatus")),
            "o_totalprice": F.when(key % 11 == 3, F.col("o_totalprice") + 10).otherwise(F.col("o_totalprice")),
        }
    )
    added = rows.filter(key % 13 == 0).withColumn("o_orderkey", key + 10000000000)
    return union_all([edited, added])


@register(
    "diff_snapshots",
    f"""WITH {ORDERS_LATER} SELECT
    CASE WHEN o.o_orderkey IS NULL THEN 'c' WHEN n.o_orderkey IS NULL THEN 'd' ELSE 'u' END AS op,
    coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_orderstatus AS old_status, n.o_orderstatus AS new_status,
    o.o_totalprice AS old_price, n.o_totalprice AS new_price, CAST(1009886400000 AS BIGINT) AS ts_ms
    FROM orders o FULL JOIN new_orders n ON o.o_orderkey = n.o_orderkey
    WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus <> n.o_orderstatus OR o.o_totalprice <> n.o_totalprice""",
)
def diff_snapshots(t: Tables) -> DataFrame:
    found = ch.diff_snapshots(t.orders, orders_later(t), fx.ORDERS, AT)
    return found.select(
        "op",
        F.coalesce("before.o_orderkey", "after.o_orderkey").alias("o_orderkey"),
        F.col("before.o_orderstatus").alias("old_status"),
        F.col("after.o_orderstatus").alias("new_status"),
        F.col("before.o_totalprice").alias("old_price"),
        F.col("after.o_totalprice").alias("new_price"),
        "ts_ms",
    )


@register(
    "diff_applied",
    f"WITH {ORDERS_LATER} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM new_orders",
)
def diff_applied(t: Tables) -> DataFrame:
    """Snapshot plus diff, through messages and back, gives the later table."""
    start = ch.snapshot_to_changes(t.orders, fx.ORDERS, datetime(2002, 1, 1)).withColumn("offset", F.lit(0))
    diff = ch.diff_snapshots(t.orders, orders_later(t), fx.ORDERS, AT).withColumn("offset", F.lit(1))
    log = decode(encode(union_all([start, diff]), fx.ORDERS), fx.ORDERS)
    return active(log, fx.ORDERS.keys).select(*fx.ORDERS.names)


@register(
    "snapshot_bootstrap",
    """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, 'r' AS cdc_operation,
    TIMESTAMP '2002-01-01 12:00:00' AS cdc_timestamp, 0 AS is_deleted FROM customer""",
)
def snapshot_bootstrap(t: Tables) -> DataFrame:
    log = resolve(ch.snapshot_to_changes(t.customer, fx.CUSTOMER, AT), fx.CUSTOMER)
    return log.select(*fx.CUSTOMER.names, "cdc_operation", "cdc_timestamp", "is_deleted")


@register(
    "decimal_as_double",
    "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS o_totalprice FROM orders",
)
def decimal_as_double(t: Tables) -> DataFrame:
    """A decimal source column travels as a JSON number and comes back as a double."""
    rows = t.orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(12,2)"))
    log = decode(encode(ch.snapshot_to_changes(rows, fx.ORDERS, AT), fx.ORDERS), fx.ORDERS)
    return log.select("o_orderkey", "o_totalprice")


@register(
    "soft_delete",
    fx.LINEITEM_CL
    + """SELECT l_orderkey, l_linenumber,
    CASE WHEN is_deleted = 0 AND l_quantity < 10 THEN 0 ELSE l_partkey END AS l_partkey,
    CASE WHEN is_deleted = 0 AND l_quantity < 10 THEN 0 ELSE l_quantity END AS l_quantity,
    CASE WHEN is_deleted = 0 AND l_quantity < 10 THEN '' ELSE l_linestatus END AS l_linestatus,
    CASE WHEN is_deleted = 0 AND l_quantity < 10 THEN 1 ELSE is_deleted END AS is_deleted,
    CASE WHEN is_deleted = 0 AND l_quantity < 10 THEN TIMESTAMP '2002-01-01 12:00:00' ELSE cdc_timestamp END AS cdc_timestamp
    FROM latest""",
)
def soft_delete(t: Tables) -> DataFrame:
    log = fx.lineitem_log(t)
    gone = resolve(ch.delete_where(log, fx.LINEITEM, "l_quantity < 10", AT), fx.LINEITEM)
    rows = latest(log.unionByName(gone), fx.LINEITEM.keys)
    return rows.select(*fx.LINEITEM.names, "is_deleted", "cdc_timestamp")


@register(
    "update_rows",
    fx.LINEITEM_CL
    + """SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN is_deleted = 0 AND l_linestatus = 'O' THEN l_quantity * 2 ELSE l_quantity END AS l_quantity,
    CASE WHEN is_deleted = 0 AND l_linestatus = 'O' THEN 'X' ELSE l_linestatus END AS l_linestatus,
    CASE WHEN is_deleted = 0 AND l_linestatus = 'O' THEN 'u' ELSE op END AS cdc_operation FROM latest""",
)
def update_rows(t: Tables) -> DataFrame:
    log = fx.lineitem_log(t)
    new = {"l_quantity": F.col("l_quantity") * 2, "l_linestatus": F.lit("X")}
    changed = resolve(ch.update_where(log, fx.LINEITEM, "l_linestatus = 'O'", new, AT), fx.LINEITEM)
    return latest(log.unionByName(changed), fx.LINEITEM.keys).select(*fx.LINEITEM.names, "cdc_operation")


@register(
    "move_keys",
    fx.LINEITEM_CL
    + """SELECT l_orderkey, CASE WHEN l_linestatus = 'O' THEN l_linenumber + 1000 ELSE l_linenumber END AS l_linenumber,
    l_partkey, l_quantity, l_linestatus FROM latest WHERE is_deleted = 0""",
)
def move_keys(t: Tables) -> DataFrame:
    """An update of a key column deletes the old row and creates the new one."""
    log = fx.lineitem_log(t)
    moved = ch.update_where(log, fx.LINEITEM, "l_linestatus = 'O'", {"l_linenumber": F.col("l_linenumber") + 1000}, AT)
    return active(log.unionByName(resolve(moved, fx.LINEITEM)), fx.LINEITEM.keys).select(*fx.LINEITEM.names)


@register(
    "insert_rows",
    """SELECT o_orderkey, o_totalprice, 'c' AS cdc_operation FROM orders
    UNION ALL SELECT o_orderkey + 10000000000, o_totalprice, 'c' FROM orders""",
)
def insert_rows(t: Tables) -> DataFrame:
    more = t.orders.withColumn("o_orderkey", F.col("o_orderkey") + 10000000000)
    log = union_all([resolve(ch.insert_rows(r, fx.ORDERS, AT), fx.ORDERS) for r in (t.orders, more)])
    return active(log.withColumn("offset", F.lit(0)), fx.ORDERS.keys).select("o_orderkey", "o_totalprice", "cdc_operation")
