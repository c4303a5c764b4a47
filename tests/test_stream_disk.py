"""What streams keep on disk: batches of a bounded size, no shuffle of a batch that is written, logs in a dense form."""

import re
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from changelake import TITLE_TABLES
from changelake.operators.envelope import decode
from changelake.plans import fixtures as fx, streams
from changelake.plans.registry import Tables
from changelake.sources import changelog
from changelake.streaming import ingest

LINES = 4000


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """The three tables the streams read, small: lines in four files, with nulls and rows that come twice."""
    path = str(tmp_path_factory.mktemp("given"))
    day = F.expr("timestamp_ntz'1998-01-05 00:00:00' + make_interval(0, 0, 0, CAST(id % 90 AS INT))")
    kind = F.element_at(F.array(*map(F.lit, "NAR")), (F.col("id") % 3 + 1).cast("int"))
    one = spark.range(LINES).select(
        (F.col("id") * 7919 % 100_003).alias("l_orderkey"),
        F.when(F.col("id") % 97 > 0, F.col("id") * 31 % 2000).alias("l_partkey"),
        (F.col("id") % 100).alias("l_suppkey"),
        (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"),
        F.when(F.col("id") % 89 > 0, F.col("id") % 50.0).alias("l_quantity"),
        kind.alias("l_returnflag"),
        F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("l_linestatus"),
        day.alias("l_shipdate"),
    )
    one.unionByName(one.where("l_orderkey % 50 = 0")).repartition(4).write.parquet(f"{path}/lineitem.parquet")
    orders = spark.range(300).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 40).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"),
        F.element_at(F.array(*map(F.lit, "OFP")), (F.col("id") % 3 + 1).cast("int")).alias("o_orderstatus"), day.alias("o_orderdate"),
    )
    orders.coalesce(1).write.parquet(f"{path}/orders.parquet")
    events = spark.range(300).select(
        F.col("id").alias("event_id"), day.alias("ts"), (F.col("id") % 40).alias("user_id"),
        F.when(F.col("id") % 4 == 0, "error").otherwise("view").alias("event_type"), F.lit(1.5).alias("value"),
    )
    events.coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


class Here(Tables):
    """Tables whose scratch folders are known."""

    def __init__(self, spark, sf_dir, root):
        super().__init__(spark, sf_dir)
        self.root = root

    def scratch(self, name):
        return f"{self.root}/{name}"


def content(rows):
    return Counter(map(str, rows.drop("processing_time").collect()))


def sizes(path):
    return [f.stat().st_size for f in Path(path).rglob("*.parquet") if f.is_file()]


def whole_logs_in(spark, t, found, batches):
    """All rows of the given tables are in the logs, which were written in more batches than one."""
    found = {r.table_name: (r.versions, r.deletes) for r in found.collect()}
    assert found.keys() == fx.TITLE_SOURCES.keys()
    for name, (table, _) in fx.TITLE_SOURCES.items():
        path = f"{t.root}/tables/log/{name}"
        log, spec = changelog.read_log(spark, path, TITLE_TABLES[name]), TITLE_TABLES[name]
        should = decode(fx.title_messages(t, name), spec)
        assert content(log) == content(should.select(*log.columns))
        assert found[name] == should.agg(F.count("*"), F.sum("is_deleted")).first()
        assert len([*Path(path).glob("log_part=stream-*")]) >= (batches if table == "lineitem" else 1)


def test_batches_do_not_grow_with_the_table(spark, given, tmp_path, monkeypatch):
    """Two files of lines a batch at most, none of them copied."""
    cores, largest = spark.sparkContext.defaultParallelism, max(sizes(f"{given}/lineitem.parquet"))
    monkeypatch.setattr(streams, "BATCH_BYTES", 2 * largest // cores + 1, raising=False)
    t = Here(spark, given, str(tmp_path))
    whole_logs_in(spark, t, streams.stream_tables(t), 2)
    assert not (tmp_path / "tables/parts").exists()


def test_a_table_in_one_file_is_taken_in_parts(spark, given, tmp_path, monkeypatch):
    """One file, larger than a batch, of several row groups: it is written in parts, once for all five streams."""
    one = tmp_path / "one"
    for name in ("orders", "events"):
        spark.read.parquet(f"{given}/{name}.parquet").write.parquet(f"{one}/{name}.parquet")
    lines = spark.read.parquet(f"{given}/lineitem.parquet").coalesce(1)
    lines.write.options(**{"parquet.block.size": 8192, "parquet.page.size": 1024, "parquet.page.size.row.check.min": 10, "parquet.block.size.row.check.min": 10}).parquet(f"{tmp_path}/folder")
    (file,) = (tmp_path / "folder").glob("*.parquet")
    file.rename(one / "lineitem.parquet")
    monkeypatch.setattr(streams, "BATCH_BYTES", (file_size := (one / "lineitem.parquet").stat().st_size) // 32, raising=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", file_size // 8)
    try:
        t = Here(spark, str(one), str(tmp_path))
        whole_logs_in(spark, t, streams.stream_tables(t), 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(sizes(tmp_path / "tables/parts/lineitem")) > 1


def test_the_shuffle_of_a_written_batch_is_dropped(spark, given, tmp_path):
    """Without waiting for the driver to collect its garbage. The session of the caller keeps its setting."""

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", files))

    before, setting = shuffles(), spark.conf.get(ingest.DROP_SHUFFLES, None)
    t = Tables(spark, given)
    spec = TITLE_TABLES["title_crew"]
    messages = fx.title_messages(t, "title_crew", streams.table_stream(t, "lineitem"))
    query = ingest.ingest(messages, spec, str(tmp_path / "log"), str(tmp_path / "checkpoint"))
    ingest.drain(query)
    until = time.time() + 10
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before
    assert changelog.read_log(spark, str(tmp_path / "log"), spec).count() == t.lineitem.count()
    assert spark.conf.get(ingest.DROP_SHUFFLES, None) == setting


def test_logs_are_dense(spark, tmp_path):
    """Offsets and sorted keys take fewer bytes than in the plain format; rows are the same, lists and blanks too."""
    spec = TITLE_TABLES["title_crew"]
    numbers = spark.range(30_000).select(F.format_string("tt%09d", F.col("id") * 7919 % 1_000_003).alias("tconst"), (F.col("id") * 104_729).alias("offset"))
    values = {
        "directors": F.when(F.col("offset") % 3 > 0, F.array(F.col("tconst"), F.lit("é"))).otherwise(F.array()), "writers": F.array(F.lit("")),
        "cdc_operation": F.lit("u"), "cdc_timestamp": F.lit("1998-01-05").cast("timestamp"), "is_deleted": F.lit(0), "processing_time": F.lit("1998-01-05").cast("timestamp"),
        "topic": F.lit(None), "partition": F.lit(0), "yyyymm": F.lit(199801),
    }
    rows = numbers.withColumns(values).select(*[F.col(f.name).cast(f.dataType) for f in spec.log_schema.fields])
    changelog.append_log(rows, str(tmp_path / "log"), spec, layout="month")
    changelog.arranged(rows, spec, "month").write.partitionBy("yyyymm").parquet(str(tmp_path / "plain"))
    log = changelog.read_log(spark, str(tmp_path / "log"), spec)
    assert content(log) == content(rows.select(*log.columns))
    assert sum(sizes(tmp_path / "log")) < 0.75 * sum(sizes(tmp_path / "plain"))
