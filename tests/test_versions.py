"""Version resolution on literal rows, and its invariants."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from changelake.operators import versions as v
from changelake.operators.changes import delete_where, diff_snapshots, insert_rows, snapshot_to_changes, update_where
from changelake.operators.envelope import resolve
from changelake.plans import fixtures as fx
from changelake.plans.registry import Tables
from changelake.specs import TITLE_TABLES, table

RATINGS, PRINCIPALS = TITLE_TABLES["title_ratings"], TITLE_TABLES["title_principals"]
SMALL = "/root/testdata/sf0.001"


def log_of(spark, *rows):
    """rows: (key, value, op, time text, offset)"""
    frame = spark.createDataFrame(rows, "k string, x double, cdc_operation string, ts string, offset bigint")
    ts = F.col("ts").cast("timestamp")
    return frame.select(
        "k", "x", "cdc_operation", ts.alias("cdc_timestamp"), (F.col("cdc_operation") == "d").cast("smallint").alias("is_deleted"),
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), "offset", (F.year(ts) * 100 + F.month(ts)).alias("yyyymm"),
    )


def state(frame):
    return {r.k: (r.x, r.cdc_operation) for r in frame.collect()}


def test_lifecycle(spark):
    log = log_of(
        spark, ("a", 8.5, "c", "2024-01-01 00:00:00", 0), ("a", 9.0, "u", "2024-01-01 00:01:00", 1), ("a", 0.0, "d", "2024-01-01 00:02:00", 2)
    )
    assert [r.cdc_operation for r in v.lifecycle(log, {"k": "a"}).collect()] == ["c", "u", "d"]
    assert state(v.latest(log, ["k"])) == {"a": (0.0, "d")}
    assert v.active(log, ["k"]).count() == 0 and v.deleted(log, ["k"]).count() == 1
    assert state(v.as_of(log, ["k"], datetime(2024, 1, 1, 0, 1, 30))) == {"a": (9.0, "u")}
    trail = v.audit_trail(log, ["k"]).collect()
    assert [(r.operation_type, r.is_deleted) for r in trail] == [("Delete", 1)]


def test_ties_late_events_and_replays(spark):
    tie = log_of(spark, ("a", 1.0, "u", "2024-01-01 00:00:00", 5), ("a", 2.0, "u", "2024-01-01 00:00:00", 6))
    assert state(v.latest(tie, ["k"])) == {"a": (2.0, "u")}
    late = log_of(spark, ("a", 1.0, "u", "2024-01-02 00:00:00", 5), ("a", 2.0, "u", "2024-01-01 00:00:00", 6))
    assert state(v.latest(late, ["k"])) == {"a": (1.0, "u")}
    assert state(v.latest(late.unionByName(late), ["k"])) == {"a": (1.0, "u")}
    assert state(v.latest(late.repartition(3, F.rand()), ["k"])) == {"a": (1.0, "u")}


def test_epoch_orders_restarted_offsets(spark):
    first = log_of(spark, ("a", 1.0, "u", "2024-01-01 00:00:00", 900)).withColumn("ingest_epoch", F.lit(1))
    again = log_of(spark, ("a", 2.0, "u", "2024-01-01 00:00:00", 3)).withColumn("ingest_epoch", F.lit(2))
    rows = v.latest(first.unionByName(again), ["k"], ("cdc_timestamp", "ingest_epoch", "offset"))
    assert state(rows) == {"a": (2.0, "u")}


def test_filter_before_dedup_would_be_wrong(spark):
    log = fx.lineitem_log(Tables(spark, SMALL))
    assert v.active(log, fx.LINEITEM.keys).count() == 3083
    assert v.latest(log.filter("is_deleted = 0"), fx.LINEITEM.keys).count() == 3334


def test_known_counts(spark):
    log = fx.lineitem_log(Tables(spark, SMALL))
    rows = v.latest(log, fx.LINEITEM.keys)
    assert (log.count(), rows.count(), rows.filter("is_deleted = 1").count()) == (6000, 4599, 1516)
    assert rows.agg(F.sum("l_quantity")).first()[0] == 78653
    assert v.compact(log, fx.LINEITEM.keys, "partition").count() == 5985
    at = v.as_of(log, fx.LINEITEM.keys, datetime(1998, 1, 1))
    assert (at.count(), at.filter("is_deleted = 0").count()) == (2359, 1621)


def test_compaction_by_month_keeps_one_per_month(spark):
    log = log_of(spark, ("a", 1.0, "c", "2024-01-01 00:00:00", 0), ("a", 2.0, "u", "2024-01-02 00:00:00", 1), ("a", 3.0, "u", "2024-02-01 00:00:00", 2))
    short = v.compact(log, ["k"], "partition")
    assert short.count() == 2 and v.compact(log, ["k"]).count() == 1
    assert state(v.latest(short, ["k"])) == state(v.latest(log, ["k"]))


def test_expiry_never_resurrects(spark):
    log = log_of(
        spark,
        ("old", 1.0, "c", "2023-01-01 00:00:00", 0), ("old", 0.0, "d", "2023-01-02 00:00:00", 1),
        ("back", 1.0, "d", "2023-01-01 00:00:00", 2), ("back", 2.0, "c", "2023-02-01 00:00:00", 3),
        ("new", 1.0, "c", "2023-12-01 00:00:00", 4), ("new", 0.0, "d", "2023-12-30 00:00:00", 5),
    )
    left = v.expire_deleted(log, ["k"], datetime(2024, 1, 1))
    assert {r.k for r in left.collect()} == {"back", "new"} and left.count() == 4
    assert state(v.active(left, ["k"])) == state(v.active(log, ["k"]))


def test_key_mismatch_of_principals(spark):
    rows = [("t1", 1, "n1", "c", 0), ("t1", 1, "n2", "u", 1)]
    frame = spark.createDataFrame(rows, "tconst string, ordering int, nconst string, cdc_operation string, offset bigint")
    log = frame.withColumns({"cdc_timestamp": F.timestamp_seconds(F.col("offset")), "is_deleted": F.lit(0)})
    assert v.active(log, PRINCIPALS.keys).count() == 2
    assert [r.nconst for r in v.active(log, PRINCIPALS.source_pk).collect()] == ["n2"]


def test_views(spark):
    spec = table("views_t", "k:string x:float64", keys="k")
    log = log_of(spark, ("a", 1.0, "c", "2024-01-01 00:00:00", 0), ("b", 0.0, "d", "2024-01-01 00:00:00", 1))
    v.register_views(log, spec)
    assert spark.table("views_t_active").columns == ["k", "x", "cdc_operation", "cdc_timestamp"]
    counts = [spark.sql(f"SELECT count(*) FROM views_t{s}").first()[0] for s in ("", "_final", "_active")]
    assert counts == [2, 2, 1]


def test_hot_key_is_cut_before_the_shuffle(spark):
    """A third of all rows on one key: one row per map task crosses the shuffle."""
    rows = spark.range(0, 300_000, 1, 6)
    log = rows.select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"),
        F.timestamp_seconds(F.col("id")).alias("cdc_timestamp"),
        F.col("id").alias("offset"),
    )
    newest = v.latest(log, ["k"])
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan
    assert newest.count() == 200_001
    assert newest.filter("k = -1").first().offset == 299_997


def test_expiry_splits_a_hot_key(spark):
    """Half of the log is one living key: it is dealt over the tasks of the join."""
    rows = spark.range(0, 200_000, 1, 8)
    key = F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id"))
    log = rows.select(
        key.alias("k"),
        F.timestamp_seconds(F.col("id")).alias("cdc_timestamp"),
        F.col("id").alias("offset"),
        (F.col("id") % 3 == 1).cast("int").alias("is_deleted"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    log = log.withColumn("is_deleted", F.when(F.col("k") == -1, 0).otherwise(F.col("is_deleted")))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        left = v.expire_deleted(log, ["k"], datetime(2024, 1, 1))
        sizes = [r.n for r in left.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 200_000 - sum(1 for i in range(1, 200_000, 2) if i % 3 == 1)
        assert max(sizes) < 60_000
        assert "SortMergeJoin [k" in left._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_key_filter_reaches_the_scan_and_others_do_not(spark):
    log = fx.lineitem_log(Tables(spark, SMALL))

    def text(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    on_key = text(v.latest(log, fx.LINEITEM.keys).filter("l_orderkey = 7"))
    assert "EqualTo(l_orderkey,7)" in on_key
    on_value = text(v.latest(log, fx.LINEITEM.keys).filter("l_quantity > 40"))
    assert "GreaterThan(l_quantity" not in on_value


# --- changes -----------------------------------------------------------------------------

T = table("t", "id:string n:uint16 tags:list", keys="id")


def source(spark, *rows):
    return spark.createDataFrame(rows, "id string, n int, tags string")


def test_diff_snapshots(spark):
    old = source(spark, ("a", 1, "x"), ("b", 2, None), ("c", 3, ""))
    new = source(spark, ("a", 1, "x"), ("b", 2, "y"), ("d", 4, ""))
    found = {(r.op, (r.before or r.after).id) for r in diff_snapshots(old, new, T, datetime(2024, 1, 1)).collect()}
    assert found == {("u", "b"), ("d", "c"), ("c", "d")}


def test_statements_round(spark):
    start = resolve(snapshot_to_changes(source(spark, ("a", 1, "x,y"), ("b", 2, "z")), T, datetime(2024, 1, 1)).withColumn("offset", F.lit(0)), T)
    more = resolve(insert_rows(source(spark, ("c", 3, "")), T, datetime(2024, 1, 2)).withColumn("offset", F.lit(1)), T)
    log = start.unionByName(more)
    log = log.unionByName(resolve(update_where(log, T, "id = 'a'", {"n": F.col("n") + 10}, datetime(2024, 1, 3)), T))
    log = log.unionByName(resolve(delete_where(log, T, F.col("id").startswith("b"), datetime(2024, 1, 3)), T))
    assert {(r.id, r.n, tuple(r.tags)) for r in v.active(log, T.keys).collect()} == {("a", 11, ("x", "y")), ("c", 3, ("",))}
    # a statement in the same second as the row's last change still wins
    log = log.unionByName(resolve(delete_where(log, T, "id = 'a'", datetime(2024, 1, 3)), T))
    assert {r.id for r in v.active(log, T.keys).collect()} == {"c"}


def test_update_of_a_key_moves_the_row(spark):
    log = resolve(snapshot_to_changes(source(spark, ("a", 1, "x")), T, datetime(2024, 1, 1)).withColumn("offset", F.lit(0)), T)
    moved = update_where(log, T, "id = 'a'", {"id": F.lit("z")}, datetime(2024, 1, 2))
    assert sorted(r.op for r in moved.collect()) == ["c", "d"]
    assert [r.id for r in v.active(log.unionByName(resolve(moved, T)), T.keys).collect()] == ["z"]


def test_unknown_key_column_is_refused():
    with pytest.raises(ValueError):
        table("bad", "a:string", keys="b")
