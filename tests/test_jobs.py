"""Audit, reconciliation, query log, files and streams on small inputs."""

import gzip
import os
from datetime import datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from changelake import session
from changelake.functions import has_prefix, narrow, truncated_close, unescape_text, version_time
from changelake.operators import audit, querylog, reconcile
from changelake.operators.envelope import decode, rejects
from changelake.operators.versions import latest, moment
from changelake.plans import fixtures as fx
from changelake.plans.querylogs import TEXTS
from changelake.plans.registry import Tables
from changelake.sources import changelog, topic, tsv
from changelake.specs import TITLE_TABLES, table
from changelake.streaming import current, ingest, lag, rates

SMALL = "/root/testdata/sf0.001"
RATINGS = TITLE_TABLES["title_ratings"]


# --- audit -------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 21, 22, 100, 4000])
@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 0.99, 1.0])
def test_exact_percentile(spark, n, p):
    values = np.random.default_rng(n).integers(0, 50, n) / 4
    rows = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(values)], "g int, x double")
    found = {r.g: r.percentile for r in audit.exact_percentile(rows, "x", p, ["g"]).collect()}
    for g in found:
        assert found[g] == pytest.approx(np.percentile(values[g::2], p * 100))


def test_exact_percentile_uses_its_bracket(spark):
    """Small accuracy, so that groups are longer than ten times of it; one group holds most rows."""
    rows = spark.range(50_000).select(
        F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 10).alias("g"), (F.xxhash64("id") % 100_000).cast("double").alias("x")
    )
    given = rows.toPandas()
    for p in (0.5, 0.95, 0.999):
        expected = given.groupby("g").x.quantile(p).to_dict()
        for small in (100_000, 1):  # broadcast bounds, salted bounds
            result = audit.exact_percentile(rows, "x", p, ["g"], accuracy=100, small=small)
            assert {r.g: r.percentile for r in result.collect()} == pytest.approx(expected)
        whole = audit.exact_percentile(rows, "x", p, accuracy=100).first().percentile
        assert whole == pytest.approx(given.x.quantile(p))


def test_approximate_percentile_is_within_its_bound(spark):
    events = Tables(spark, SMALL).events
    values = np.sort(np.array([r.value for r in events.select("value").collect()]))
    found = audit.percentile(events, "value", 0.95).first().percentile
    assert abs(np.searchsorted(values, found) / len(values) - 0.95) < 0.01


def test_no_null_group_is_lost(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "g string, x double")
    assert [(r.g, r.percentile) for r in audit.exact_percentile(rows, "x", 0.5, ["g"]).collect()] == [(None, 2.0)]


# --- reconciliation --------------------------------------------------------------------------


def test_field_check_tolerance_and_missing_rows(spark):
    spec = table("t", "k:string x:float32 s:string l:list", keys="k")
    source = spark.createDataFrame([("a", 9.1, "s", "p,q"), ("b", 1.0, None, ""), ("c", 1.0, "s", "")], "k string, x double, s string, l string")
    target = spark.createDataFrame([("a", 9.100000381, "s", ["p", "q"]), ("b", 1.05, None, [""])], "k string, x double, s string, l array<string>")
    cells = {(r.k, r.field): r.ok for r in reconcile.field_check(source, target, spec).collect()}
    assert sorted(k for k, ok in cells.items() if not ok) == [("b", "x"), ("c", "l"), ("c", "s"), ("c", "x")]
    summary = {r.field: (r.passed, r.failed) for r in reconcile.field_summary(source, target, spec).collect()}
    assert summary == {"x": (1, 2), "s": (2, 1), "l": (2, 1)}
    assert reconcile.pass_fail(reconcile.field_check(source, target, spec)).first() == (5, 4, False)


def test_progress_of_an_empty_source(spark):
    empty = spark.range(0)
    row = reconcile.progress({"t": empty}, {"t": empty}).first()
    assert (row.percent, row.done) == (None, False)


def test_default_alert_rules(spark):
    metrics = spark.createDataFrame([("lag", 6e6), ("lag", 2e6), ("memory_percent", 80.0), ("cpu_percent", 201.0)], "metric string, value double")
    fired = sorted((r.value, r.rule) for r in reconcile.alerts(metrics).collect())
    assert fired == [(201.0, "cpu alert"), (2e6, "lag alert"), (6e6, "lag alert"), (6e6, "scale on lag")]


def test_sample_of_any_size(spark):
    """A sample may be as long as the table; only a size that is no size is refused."""
    rows = spark.range(150_000).select(F.col("id").cast("string").alias("tconst"), F.lit(1.0).alias("averageRating"), F.lit(1).alias("numVotes"))
    assert tsv.stable_sample(rows, ["tconst"], 120_000).count() == 120_000
    with pytest.raises(ValueError):
        tsv.stable_sample(rows, ["tconst"], 0)
    with pytest.raises(ValueError):
        reconcile.sample_check(rows, rows, RATINGS, 0)


# --- query log ---------------------------------------------------------------------------------


def test_classification_of_texts(spark):
    log = spark.createDataFrame([(i, s) for i, s in enumerate([*TEXTS, "SELECT a\nFROM t GROUP BY a"])], "i int, sql string")
    found = [r.rule_id for r in querylog.classify(log).orderBy("i").collect()]
    assert found == [100, 100, None, 101, 100, None, None, 100, None]
    groups = {r.target_group for r in querylog.classify(log).filter("rule_id IS NULL").collect()}
    assert groups == {10}


def test_labels_of_unknown_rules(spark):
    rows = spark.createDataFrame([(1,), (100,), (101,)], "rule_id int").select(querylog.rule_label().alias("l"))
    assert [r.l for r in rows.collect()][2] == "Rule 101"


# --- files ---------------------------------------------------------------------------------------


def test_tsv_reads_header_nulls_blanks(spark, tmp_path):
    akas = TITLE_TABLES["title_akas"]
    text = "any\theader\tat\tall\n" + "t1\t1\tA \"b\tUS\t\\N\tx,y\t\t\n" + "t2\tzz\t\\N\t\ten\t\\N\t\\N\t1\n"
    (tmp_path / "a.tsv").write_text(text, encoding="utf-8")
    with gzip.open(tmp_path / "b.tsv.gz", "wt", encoding="utf-8") as f:
        f.write("header\nt3\t3\tSpëcïål\n")
    rows = tsv.read_tsv(spark, str(tmp_path), akas, blank_is_null=["isOriginalTitle"]).orderBy("titleId").collect()
    assert tuple(rows[0]) == ("t1", 1, 'A "b', "US", None, "x,y", "", None)
    assert tuple(rows[1]) == ("t2", None, None, "", "en", None, None, 1)
    assert tuple(rows[2])[:4] == ("t3", 3, "Spëcïål", None)


def test_table_files(spark, tmp_path):
    specs = {n: TITLE_TABLES[n] for n in ("title_ratings", "title_akas")}
    (tmp_path / "title.ratings.tsv").write_text("tconst\taverageRating\tnumVotes\ncustom001\t9.9\t999999\ncustom002\t1.0\t1\n")
    (tmp_path / "title.akas.tsv").write_text("h\nt1\t1\tx\t\\N\t\t\t\t\n")
    frames = tsv.read_tables(spark, str(tmp_path), specs)
    assert [tuple(r) for r in frames["title_ratings"].orderBy("tconst").collect()] == [("custom001", 9.9, 999999), ("custom002", 1.0, 1)]
    row = frames["title_akas"].first()
    assert (row.region, row.language, row.isOriginalTitle) == (None, "", None)


def test_prefix_by_collation(spark):
    rows = spark.createDataFrame([("Test1",), ("test2",), ("Çat",), ("çAt",)], "s string")
    assert rows.filter(has_prefix("s", "test")).count() == 1
    assert rows.filter(has_prefix("s", "test", ignore_case=True)).count() == 2
    assert rows.filter(has_prefix("s", "ÇA", ignore_case=True)).count() == 2


def test_unescape(spark):
    given = ["plain", r"a\tb", r"a\\tb", r"a\\\tb", r"x\\\\y", r"\q\n", "\u0001"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string")
    found = [r.s for r in rows.select("i", unescape_text("s").alias("s")).orderBy("i").collect()]
    assert found == ["plain", "a\tb", "a\\tb", "a\\\tb", "x\\\\y", "q\n", "\u0001"]


def test_chunk_plan(spark):
    plan = [tuple(r) for r in tsv.chunk_plan(spark.range(11), 5).orderBy("chunk").collect()]
    assert plan == [(1, 0, 0, 11), (2, 5, 45, 11), (3, 10, 90, 11)]
    assert tsv.chunk_plan(spark.range(0), 5).count() == 0


def test_hot_month_and_key_are_spread_when_written(spark):
    log = fx.lineitem_log(Tables(spark, SMALL)).withColumns(
        {"l_orderkey": F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(F.col("l_orderkey")), "yyyymm": F.lit(199801)}
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = changelog.arranged(log, fx.LINEITEM).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
        assert max(r.n for r in parts.collect()) < 2 * 6000 / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bucketed_tables_reconcile_without_shuffle(spark):
    t = Tables(spark, SMALL)
    for name in ("src_orders", "dst_orders"):
        changelog.save_bucketed(t.orders.select(*fx.ORDERS.names), name, fx.ORDERS.keys, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        checked = reconcile.field_check(spark.table("src_orders"), spark.table("dst_orders"), fx.ORDERS)
        plan = checked._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert checked.filter("NOT ok").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_month_filter_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "log")
    changelog.append_log(fx.lineitem_log(Tables(spark, SMALL)), path, fx.LINEITEM)
    rows = changelog.read_log(spark, path, fx.LINEITEM).filter("yyyymm = 199801")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(yyyymm" in plan
    stats = audit.storage_stats(spark.read.schema(fx.LINEITEM.log_schema).parquet(path), ["yyyymm"])
    total = stats.agg(F.sum("rows"), F.min("bytes"), F.min("files")).first()
    assert total[0] == 6000 and total[1] > 0 and total[2] >= 1


def test_migration_keeps_rows_and_backup_is_not_replaced(spark, tmp_path):
    old = spark.createDataFrame([("a", 1.5, 3, "c")], "tconst string, averageRating float, numVotes bigint, cdc_operation string")
    new = changelog.migrate(old, RATINGS)
    assert new.schema == RATINGS.log_schema or new.columns == RATINGS.log_schema.names
    row = new.first()
    assert (row.tconst, row.averageRating, row.numVotes, row.is_deleted) == ("a", 1.5, 3, 0)
    changelog.backup(old, str(tmp_path / "b"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        changelog.backup(old, str(tmp_path / "b"))


def test_reset_log_reads_as_empty(spark, tmp_path):
    path = str(tmp_path / "log")
    changelog.append_log(fx.lineitem_log(Tables(spark, SMALL)), path, fx.LINEITEM)
    changelog.reset(spark, path, fx.LINEITEM.log_schema)
    assert changelog.read_log(spark, path, fx.LINEITEM).isEmpty()


def test_retention_limits():
    assert changelog.retention_from_hours(168) == 604_800_000
    for hours in (0, 169):
        with pytest.raises(ValueError):
            changelog.retention_from_hours(hours)


def test_topic_and_remote_options():
    options = topic.topic_options("b:9092", ["x", "y"], start={"x": {"0": 5}}, max_per_trigger=10, min_partitions=4)
    assert options["subscribe"] == "x,y" and options["startingOffsets"] == '{"x": {"0": 5}}' and options["maxOffsetsPerTrigger"] == "10"
    assert topic.topic_name(RATINGS) == "cdc.imdb.title_ratings"
    assert topic.jdbc_options("u", "t", "id", 0, 100, 8)["numPartitions"] == "8"
    with pytest.raises(ValueError):
        topic.jdbc_options("u", "t", "id", 5, 5, 8)


# --- streams -------------------------------------------------------------------------------------


def test_stream_restart_and_late_batch(spark, tmp_path):
    """New files after a stop are picked up once; a late old version does not win."""
    t = Tables(spark, SMALL)
    messages = fx.event_messages(t.events)
    source, root = str(tmp_path / "in"), str(tmp_path)

    def run():
        stream = ingest.message_files(spark, source, messages.schema, max_files=1)
        query = current.maintain_current(decode(stream, fx.EVENTS), fx.EVENTS, f"{root}/cur", f"{root}/cp")
        assert ingest.drain(query)

    messages.filter("offset >= 500").coalesce(1).write.parquet(source)
    run()
    folded = current.fold_current(spark, f"{root}/cur", fx.EVENTS)
    assert current.fold_current(spark, f"{root}/cur", fx.EVENTS, folded) == folded
    messages.filter("offset < 500").coalesce(1).write.mode("append").parquet(source)
    run()
    expected = {(r.user_id, r.offset) for r in latest(decode(messages, fx.EVENTS), ["user_id"]).collect()}
    for how in (None, folded):
        rows = current.read_current(spark, f"{root}/cur", fx.EVENTS, how)
        assert {(r.user_id, r.offset) for r in rows.collect()} == expected
    assert current.fold_current(spark, f"{root}/cur", fx.EVENTS, folded) > folded


def test_rates_count_late_changes(spark, tmp_path):
    """Each later batch is older than the one before by more than any watermark would allow."""
    t = Tables(spark, SMALL)
    messages = fx.event_messages(t.events)
    source = str(tmp_path / "in")
    for low, high in ((700, 10**9), (300, 700), (0, 300)):
        messages.filter((F.col("offset") >= low) & (F.col("offset") < high)).coalesce(1).write.mode("append").parquet(source)
    log = decode(ingest.message_files(spark, source, messages.schema, max_files=1), fx.EVENTS)
    ingest.drain(rates.maintain_rates(log, str(tmp_path / "out"), str(tmp_path / "cp")))
    found = rates.read_rates(spark, str(tmp_path / "out"))
    expected = audit.op_rates(decode(messages, fx.EVENTS)).select(*found.columns)
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def test_new_messages_of_a_late_partition_are_kept(spark, tmp_path):
    schema = "topic string, partition int, offset long, timestamp timestamp, value string"
    source = str(tmp_path / "in")
    for partition, hour, offsets in ((0, 12, range(5)), (1, 5, range(5)), (0, 13, range(3, 8)), (1, 5, range(5))):
        rows = [("t", partition, i, f"2024-01-01 {hour:02d}:00:00", "x") for i in offsets]
        frame = spark.createDataFrame(rows, "topic string, partition int, offset long, timestamp string, value string")
        frame.withColumn("timestamp", F.col("timestamp").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    for ordered in (False, True):
        out, cp = str(tmp_path / f"out{ordered}"), str(tmp_path / f"cp{ordered}")
        stream = ingest.message_files(spark, source, schema, max_files=1)
        ingest.drain(ingest.keep_once(stream, out, cp, ordered=ordered))
        found = [(r.partition, r.offset) for r in ingest.read_once(spark, out, stream.schema).collect()]
        assert sorted(found) == [(0, i) for i in range(8)] + [(1, i) for i in range(5)]


def test_fold_leaves_a_batch_under_way(spark, tmp_path):
    """A folder without its mark of a committed write is not folded, so none of its later files is skipped."""
    path = str(tmp_path / "cur")
    log = decode(fx.event_messages(Tables(spark, SMALL).events), fx.EVENTS)
    newest = latest(log, fx.EVENTS.keys)
    newest.filter("user_id % 2 = 0").coalesce(1).write.parquet(f"{path}/batch=0")
    newest.filter("user_id % 2 = 1").repartition(4).write.parquet(f"{path}/batch=1")
    files = sorted(f for f in os.listdir(f"{path}/batch=1") if f.startswith("part-"))
    for name in ["_SUCCESS", *files[1:]]:
        os.rename(f"{path}/batch=1/{name}", str(tmp_path / name))
    folded = current.fold_current(spark, path, fx.EVENTS)
    assert folded == 0
    for name in ["_SUCCESS", *files[1:]]:
        os.rename(str(tmp_path / name), f"{path}/batch=1/{name}")
    assert current.read_current(spark, path, fx.EVENTS, folded).count() == newest.count()
    assert current.fold_current(spark, path, fx.EVENTS, folded) == 1


def test_absurd_values_end_no_job(spark):
    times = spark.createDataFrame([(0,), (1_700_000_000_000_000_000,), (None,), (-(2**63),)], "ts long")
    found = [r[0] for r in times.select(version_time("ts").cast("long")).collect()]
    assert found == [0, 0, 0, 0]
    numbers = spark.createDataFrame(
        [(1.0, 1.004), (float("nan"), float("nan")), (float("nan"), 1.0), (1e18, 1e18), (1e18, 2e18), (float("inf"), float("inf")), (None, None), (None, 1.0)], "a double, b double"
    )
    assert [r[0] for r in numbers.select(truncated_close("a", "b")).collect()] == [True, True, False, True, False, True, True, False]
    cells = spark.createDataFrame([(123.4,), (12.3,)], "x double").select(narrow("x", None, T.DecimalType(3, 1), "null"))
    assert [r[0] for r in cells.collect()] == [None, Decimal("12.3")]


def test_messages_without_a_usable_time_are_rejected(spark):
    good = fx.event_messages(Tables(spark, SMALL).events).limit(3)
    bad = good.withColumn("value", F.regexp_replace(F.col("value").cast("string"), '"ts_ms":[0-9]+', '"ts_ms":1700000000000000000'))
    assert decode(bad, fx.EVENTS).count() == 0
    assert {r.reason for r in rejects(bad, fx.EVENTS).collect()} == {"bad time"}


def test_lag_and_offsets(spark):
    end = lag.offsets_frame(spark, {"a": {"0": 10, "1": 20}, "b": {"0": 5}})
    done = lag.offsets_frame(spark, '{"a": {"0": 4, "1": 20}}')
    found = {r.topic: r.lag for r in lag.lag_by_topic(end, done).collect()}
    assert found == {"a": 6, "b": 5, "TOTAL": 11}


def test_throughput_over_midnight(spark):
    rows = [("t", "2024-01-01 23:59:30", 100, 0), ("t", "2024-01-02 00:00:00", 40, 3000), ("t", "2024-01-04 00:00:00", 5, 3000)]
    samples = spark.createDataFrame(rows, "topic string, s string, lag bigint, records bigint").withColumn("sampled_at", F.col("s").cast("timestamp")).drop("s")
    series = lag.throughput_series(samples, threshold=50).orderBy("sampled_at").collect()
    assert [(r.lag_change, r.record_change, r.records_per_second, r.caught_up) for r in series] == [
        (None, None, None, False), (-60, 3000, 100, True), (-35, 0, 0, True),
    ]
    assert lag.until_caught_up(lag.throughput_series(samples, threshold=50)).count() == 2


def test_wait_for_lag():
    readings = iter([5_000_000, 2_000_000, 10])
    assert lag.wait_for_lag(lambda: next(readings), poll_s=0.001)
    assert not lag.wait_for_lag(lambda: 5_000_000, timeout_s=0.003, poll_s=0.001)


# --- session -------------------------------------------------------------------------------------


def test_scratch_is_under_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = (session.scratch_dir(spark, "x") for _ in range(2))
    assert first.startswith(base) and first != second


def test_partition_advice():
    assert session.shuffle_partitions_for(10 * 2**40, 8000) % 8000 == 0
    assert session.shuffle_partitions_for(1, 8) == 8


def test_moment_does_not_depend_on_the_local_zone(spark):
    row = spark.range(1).select(F.unix_seconds(moment(datetime(1970, 1, 2))).alias("s")).first()
    assert row.s == 86400
