"""Store maintenance, Bloom filters, records over lines, alert periods: against brute force on small inputs."""

import glob
import itertools
import os
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from changelake.functions import escape_text, escaped_marks_to_letters, unescape_text
from changelake.operators import periods
from changelake.operators.versions import active, latest
from changelake.plans import fixtures as fx
from changelake.plans.registry import Tables
from changelake.sources import changelog, maintenance, tsv
from changelake.specs import table

SMALL = "/root/testdata/sf0.001"
KEYS = list(fx.LINEITEM.keys)
MONTHS = (199709, 199803)
TEXTS = table("texts", "k:int64 a:string b:string", keys="k")


def content(frame):
    return sorted(map(tuple, frame.drop("processing_time").collect()), key=repr)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "log")
    log = fx.lineitem_log(Tables(spark, SMALL)).withColumn("processing_time", F.lit(datetime(2000, 1, 1)))
    log = log.where(f"yyyymm BETWEEN {MONTHS[0]} AND {MONTHS[1]}").coalesce(2)
    changelog.append_log(log.where("offset % 3 = 0"), path, fx.LINEITEM, part="stream-0")
    changelog.append_log(log.where("offset % 3 = 1"), path, fx.LINEITEM, part="stream-1")
    return path, log


def files(path):
    found = glob.glob(f"{path}/log_part=*/yyyymm=*/*.parquet")
    return {f: os.path.getmtime(f) for f in found}


def test_compaction_rewrites_touched_months_only(spark, stored):
    path, log = stored
    before = files(path)
    expected = content(latest(changelog.read_log(spark, path, fx.LINEITEM), KEYS))
    counts = changelog.read_log(spark, path, fx.LINEITEM).groupBy("yyyymm").count().collect()
    months = maintenance.compact_log(spark, path, fx.LINEITEM)
    assert content(changelog.read_log(spark, path, fx.LINEITEM)) == expected
    after = files(path)
    assert {f: after[f] for f in before} == before  # nothing is written over
    new = {int(f.split("yyyymm=")[1].split("/")[0]) for f in set(after) - set(before)}
    left = {r.yyyymm: r["count"] for r in changelog.read_log(spark, path, fx.LINEITEM).groupBy("yyyymm").count().collect()}
    assert months == sorted(r.yyyymm for r in counts if left.get(r.yyyymm, 0) < r["count"])
    assert new <= set(months)
    assert maintenance.compact_log(spark, path, fx.LINEITEM) == []  # nothing left to do
    gone = {r.folder for r in maintenance.replaced_folders(spark, path).collect()}
    assert gone == {f.split("/log/")[1].rsplit("/", 1)[0] for f in before if int(f.split("yyyymm=")[1].split("/")[0]) in months}


def test_a_stream_beside_a_rewrite_loses_nothing(spark, stored):
    """A part that appears while the rewrite runs, and one that is not finished, are not replaced."""
    path, log = stored
    changelog.append_log(log.where("offset % 3 = 2 AND l_linenumber > 2"), path, fx.LINEITEM, part="stream-2")
    os.rename(f"{path}/log_part=stream-2/_SUCCESS", f"{path}/_held")

    def keep(rows):
        if not os.path.exists(f"{path}/log_part=stream-3"):
            changelog.append_log(log.where("offset % 3 = 2 AND l_linenumber <= 2"), path, fx.LINEITEM, part="stream-3")
        return latest(rows, KEYS)

    assert maintenance.rewrite(spark, path, fx.LINEITEM, keep)
    os.rename(f"{path}/_held", f"{path}/log_part=stream-2/_SUCCESS")
    late = content(log.where("offset % 3 = 2"))
    early = content(latest(log.where("offset % 3 < 2"), KEYS))
    assert content(changelog.read_log(spark, path, fx.LINEITEM)) == sorted(late + early, key=repr)
    assert content(active(changelog.read_log(spark, path, fx.LINEITEM), KEYS)) == content(active(log, KEYS))


def test_an_unpublished_rewrite_is_not_read(spark, stored, monkeypatch):
    path, _ = stored
    before = content(changelog.read_log(spark, path, fx.LINEITEM))
    append = changelog.append_log

    def half(rows, *args, **options):
        append(rows.where("l_linenumber = 1"), *args, **options)

    monkeypatch.setattr(maintenance, "append_log", half)
    with pytest.raises(RuntimeError, match="not published"):
        maintenance.compact_log(spark, path, fx.LINEITEM)
    assert content(changelog.read_log(spark, path, fx.LINEITEM)) == before


def test_dropped_months_and_reset(spark, stored):
    path, log = stored
    months = maintenance.drop_months(spark, path, fx.LINEITEM, 199801)
    assert months and max(months) < 199801
    rows = changelog.read_log(spark, path, fx.LINEITEM)
    assert content(rows) == content(log.where("offset % 3 < 2 AND yyyymm >= 199801"))
    plan = rows.where("yyyymm < 199801")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "NOT" in plan.split("PartitionFilters")[1]
    changelog.reset(spark, path, fx.LINEITEM.log_schema)
    changelog.append_log(log.where("yyyymm < 199801"), path, fx.LINEITEM, part="stream-0")
    assert changelog.read_log(spark, path, fx.LINEITEM).count() == log.where("yyyymm < 199801").count()


def test_empty_log_is_left_alone(spark, tmp_path):
    path = str(tmp_path / "log")
    changelog.reset(spark, path, fx.LINEITEM.log_schema)
    assert maintenance.compact_log(spark, path, fx.LINEITEM) == []
    assert maintenance.replaced_folders(spark, path) is None


def test_key_columns_get_bloom_filters(spark, tmp_path):
    log = fx.lineitem_log(Tables(spark, SMALL)).where("yyyymm = 199801")
    for name, bloom in (("with", ("l_orderkey",)), ("without", ())):
        changelog.append_log(log, str(tmp_path / name), fx.LINEITEM, layout="month", bloom=bloom)
    con = duckdb.connect()
    found = {}
    for name in ("with", "without"):
        sql = f"SELECT path_in_schema, count(bloom_filter_offset) FROM parquet_metadata('{tmp_path}/{name}/*/*/*.parquet') GROUP BY 1"
        found[name] = {k: n for k, n in con.execute(sql).fetchall() if n}
    groups = con.execute(f"SELECT count(*) FROM parquet_metadata('{tmp_path}/with/*/*/*.parquet') WHERE path_in_schema = 'l_orderkey'").fetchone()[0]
    assert found == {"with": {"l_orderkey": groups}, "without": {}}
    for key in (8, 10**9):
        rows = [active(changelog.read_log(spark, str(tmp_path / n), fx.LINEITEM), KEYS).where(f"l_orderkey = {key}") for n in found]
        assert content(rows[0]) == content(rows[1])


# --- records over lines ------------------------------------------------------------------------------


PIECES = ["", "\\", "\t", "\n", "x", "\\\\", "\n\n", "\\n", "\\N", "\r", "\u0000", '"', " ", "é "]


@pytest.mark.parametrize("how", ["letters", "marks"])
@pytest.mark.parametrize("split", [None, 64])
def test_every_text_comes_back(spark, tmp_path, how, split):
    cells = ["".join(p) for p in itertools.product(PIECES, repeat=2)]
    cells += [None, "a\n" * 200, "\\" * 301 + "\n"]
    rows = [(i, a, cells[-1 - i]) for i, a in enumerate(cells)]
    frame = spark.createDataFrame(rows, "k long, a string, b string")
    path = str(tmp_path / "t")
    tsv.write_tsv(frame.coalesce(2), path, escape=how)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:  # records run over many splits
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
        found = tsv.read_tsv(spark, path, TEXTS, header=how == "letters", records=True)
        assert sorted(map(tuple, found.collect())) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_an_export_by_hand(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("k\ta\tb\n1\tone\\\ntwo\t\\N\n\n2\tt\\\tab\tend\\\\\n3\tlast\\", newline="")
    (tmp_path / "b.tsv").write_text("")
    (tmp_path / "c.tsv").write_text("k\ta\tb\n")
    rows = tsv.read_tsv(spark, str(tmp_path), TEXTS, records=True).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(1, "one\ntwo", None), (None, None, None), (2, "t\tab", "end\\"), (3, "last\\", None)], key=repr)
    with pytest.raises(ValueError, match="escape"):
        tsv.write_tsv(spark.range(1), str(tmp_path / "x"), escape="csv")


def test_escapes_undo_each_other(spark):
    cells = ["".join(p) for p in itertools.product(PIECES, repeat=2)]
    rows = spark.createDataFrame([(c,) for c in cells], "s string")
    for marks in (False, True):
        back = unescape_text(escaped_marks_to_letters(escape_text("s", marks)))
        assert rows.where(~back.eqNullSafe(F.col("s"))).count() == 0


# --- periods ------------------------------------------------------------------------------------------


def plain_periods(samples, rules):
    out = []
    for name, metric, threshold in rules:
        for topic in {s[0] for s in samples}:
            run = []
            series = sorted((s for s in samples if s[0] == topic and s[1] == metric), key=lambda s: s[2])
            for s in [*series, (topic, metric, None, None)]:
                if s[3] is not None and s[3] > threshold:
                    run.append(s)
                elif run:
                    out.append((topic, metric, name, threshold, run[0][2], run[-1][2], max(r[3] for r in run), len(run)))
                    run = []
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_alert_periods(spark, seed):
    draw = np.random.default_rng(seed)
    start, samples = datetime(2024, 1, 1), []
    for topic, p in (("hot", 0.97), ("mixed", 0.5), ("calm", 0.05), (None, 0.7)):
        for metric in ("lag", "cpu"):
            for i in np.flatnonzero(draw.random(120) < 0.8):  # days in between may have no sample
                value = None if draw.random() < 0.05 else float(draw.choice([10.0, 20.0, 30.0]) if draw.random() < p else 1.0)
                samples.append((topic, metric, start + timedelta(hours=7 * int(i)), value))
    rules = [("over", "lag", 5.0), ("far over", "lag", 20.0), ("cpu", "cpu", 5.0), ("none", "disk", 1.0)]
    frame = spark.createDataFrame(samples, "topic string, metric string, sampled_at timestamp, value double").repartition(8)
    found = periods.alert_periods(frame, rules).select("topic", "metric", "rule", "threshold", "started_at", "ended_at", "peak", "samples")
    assert sorted(map(tuple, found.collect()), key=repr) == plain_periods(samples, rules)
    assert periods.alert_periods(frame.limit(0), rules).isEmpty()


def test_growth_over_missing_days(spark):
    rows = [("t", "2024-01-01 10:00:00", 5), ("t", "2024-01-01 23:00:00", 10), ("t", "2024-01-04 01:00:00", 40), ("t", "2024-01-05 01:00:00", None)]
    frame = spark.createDataFrame(rows, "topic string, s string, records long").withColumn("sampled_at", F.col("s").cast("timestamp"))
    assert [(str(r.day), r.records, r.per_day) for r in periods.growth_per_day(frame).orderBy("day").collect()] == [("2024-01-01", 10, None), ("2024-01-04", 40, 10.0)]
