"""Ranks, quantiles, samples, carried values, checksum trees and offset intervals against plain versions."""

import hashlib
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelake.operators import checksums, ranks, reconcile, versions
from changelake.specs import TITLE_TABLES, table
from changelake.streaming import offsets

RATINGS = TITLE_TABLES["title_ratings"]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def nulls_first(x):
    return tuple((v is not None, v) for v in x)


def test_ranks_equal_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "hot", "hot", "hot", "b"]), rng.choice([None, *range(50)]), i, "x") for i in range(3000)]
    rows += [("hot", 7, -1, "x")] * 5  # equal rows
    frame = spark.createDataFrame(rows, "g string, x int, i int, rank string").drop("rank").withColumn("_at", F.lit(9))
    got = [tuple(r) for r in ranks.ranked(frame, ["x", "i"], ["g"]).select("g", "x", "i", "_at", "rank").collect()]
    want = []
    for g in {r[0] for r in rows}:
        mine = sorted((r[:3] for r in rows if r[0] == g), key=nulls_first)
        want += [(*r, 9, n) for n, r in enumerate(mine)]
    assert sorted(got, key=nulls_first) == sorted(want, key=nulls_first)
    overall = ranks.ranked(frame.drop("g"), ["x", "i"], name="place").collect()
    assert sorted(r.place for r in overall) == list(range(len(rows)))
    assert ranks.ranked(frame.limit(0), ["x"], ["g"]).count() == 0


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_quantile_of_awkward_values(spark, accuracy):
    """Ties, long tails and infinities; one group holds nearly all rows; a small accuracy so that both sketches narrow."""
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(6000, 5.0), rng.pareto(0.3, 6000), -rng.random(3000), [np.inf, -np.inf, 0.0]])
    rng.shuffle(values)
    rows = spark.createDataFrame([(0 if i % 10 else 1, float(x)) for i, x in enumerate(values)] + [(2, None), (3, 1.5)], "g int, x double")
    for p in (0.0, 0.3, 0.95, 1.0):
        got = {r.g: r.quantile for r in ranks.quantile(rows, "x", p, ["g"], accuracy).collect()}
        assert set(got) == {0, 1, 3} and got[3] == 1.5
        for g in (0, 1):
            mine = np.sort([x for i, x in enumerate(values) if (0 if i % 10 else 1) == g])
            place = p * (len(mine) - 1)
            low, high = mine[int(np.floor(place))], mine[int(np.ceil(place))]
            assert got[g] == (low if low == high else pytest.approx(low + (high - low) * (place - np.floor(place))))


def test_quantile_plan(spark):
    rows = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    frame = ranks.quantile(rows, "x", 0.95)
    assert "SinglePartition" not in plan(frame) and "Window" not in plan(frame)
    assert frame.first().quantile == pytest.approx(0.95 * 999)


def test_samples(spark):
    rows = spark.range(20_000).select("id", F.lit("x").alias("s"))
    order = sorted(range(20_000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    for n in (1, 5, 4097, 19_999, 20_000, 30_000):
        assert sorted(r.id for r in ranks.sampled_keys(rows, ["id"], n).collect()) == sorted(order[:n])
    big = ranks.sampled_keys(rows, ["id"], 10_000)
    assert "SinglePartition" not in plan(big) and "TakeOrdered" not in plan(big) and "Limit" not in plan(big)
    other = {r.id for r in ranks.sampled_keys(rows, ["id"], 5000, seed=2).collect()}
    assert len(other) == 5000 and len(other & set(order[:5000])) < 2500
    assert ranks.sampled_keys(rows, ["id"], 0).count() == ranks.sampled_keys(rows.limit(0), ["id"], 9).count() == 0
    with pytest.raises(ValueError):
        ranks.sampled_keys(rows, ["id"], -1)


def test_sample_of_repeated_and_null_keys(spark):
    rows = spark.createDataFrame([(i % 3 if i % 4 else None,) for i in range(1200)], "k int")
    got = {r.k: r.n for r in ranks.sampled_keys(rows, ["k"], 700).groupBy("k").agg(F.count("*").alias("n")).collect()}
    order = sorted([None, 0, 1, 2], key=lambda k: hashlib.md5((r"\N" if k is None else str(k)).encode()).hexdigest())
    left, want = 700, {}
    for k in order:
        want[k] = min(300, left)
        left -= want[k]
    assert got == {k: n for k, n in want.items() if n}


def test_state_at_many_moments(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    log = [(rng.choice(["hot"] * 8 + ["b", "c", None]), start + timedelta(seconds=rng.randint(0, 300)), i, f"v{i}") for i in range(2000)]
    asked = [(rng.choice(["hot"] * 5 + ["b", "c", "never", None]), rng.choice([None, start + timedelta(seconds=rng.randint(-20, 320))]), i % 50) for i in range(900)]
    frame = spark.createDataFrame(log, "k string, cdc_timestamp timestamp, offset bigint, value string")
    want = []
    for k, at, tag in asked:
        before = [r for r in log if r[0] == k and at is not None and r[1] <= at]
        newest = max(before, key=lambda r: (r[1], r[2])) if before else None
        want.append((k, at, tag, newest[3] if newest else None))
    got = versions.as_of_many(frame, ["k"], spark.createDataFrame(asked, "k string, at timestamp, tag int"))
    found = [(r.k, r.at, r.tag, r.value) for r in got.select("k", "at", "tag", "version.value").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert versions.as_of_many(frame.limit(0), ["k"], got.select("k", "at")).where("version is not null").count() == 0


# --- checksum trees ------------------------------------------------------------------------


def test_only_differing_ranges_are_joined(spark):
    spec = table("t", "k:int64 x:float64 s:string l:list", keys="k")
    n = 200_000
    source = spark.range(n).select(F.col("id").alias("k"), (F.col("id") / 7).alias("x"), F.concat(F.lit("s"), "id").alias("s"), F.lit("a,b").alias("l"))
    target = source.withColumn("s", F.when(F.col("k").between(70_000, 70_005), "edited").otherwise(F.col("s"))).where("k <> 150000")
    target = target.withColumn("l", F.split("l", ",")).unionByName(spark.createDataFrame([(10**9, 1.0, "extra", ["z"])], "k bigint, x double, s string, l array<string>"))
    differing = checksums.differing_ranges(*[checksums.checksum_tree(side, spec) for side in (source, target)])
    leaves = {r.range: (r.source_rows, r.target_rows) for r in differing.where(F.col("depth") == checksums.DEPTHS).collect()}
    size = 1 << checksums.LEAF_BITS
    assert leaves == {70_000 // size: (size, size), 150_000 // size: (size, size - 1), 10**9 // size: (0, 1)}
    suspects = checksums.rows_of_ranges(source, spec, differing)
    assert suspects.count() == 2 * size  # of 200,000
    full = reconcile.field_check(source, target, spec, only_failures=True)
    fast = checksums.field_failures(source, target, spec)
    assert sorted(map(str, fast.collect())) == sorted(map(str, full.collect())) and fast.count() == 12
    both = [sorted(map(tuple, f(source, target, spec).collect())) for f in (checksums.summary, reconcile.field_summary)]
    assert both[0] == both[1]


def test_checksums_of_text_keys_types_and_tolerance(spark):
    """Source and replica store numbers in different types; text keys go by their hash; nulls, empty tables and equal sides."""
    rows = [(f"tt{i}", None if i % 50 == 0 else i / 10, i) for i in range(3000)]
    source = spark.createDataFrame(rows, "tconst string, averageRating double, numVotes bigint")
    target = source.withColumn("averageRating", F.col("averageRating").cast("float"))
    assert checksums.field_failures(source, target, RATINGS).count() == 0
    edited = target.withColumn("averageRating", F.when(F.col("numVotes") == 77, F.lit(None)).when(F.col("numVotes") == 78, 7.806).otherwise(F.col("averageRating")))
    full = reconcile.field_check(source, edited, RATINGS, only_failures=True).collect()
    assert sorted(map(str, checksums.field_failures(source, edited, RATINGS).collect())) == sorted(map(str, full)) and len(full) == 1
    none = source.limit(0)
    assert checksums.field_failures(none, none, RATINGS).count() == 0
    assert checksums.field_failures(source, none, RATINGS).count() == 6000
    assert [tuple(r) for r in checksums.summary(none, none, RATINGS).collect()] == [("averageRating", 0, 0), ("numVotes", 0, 0)]


def test_many_differing_ranges_are_named_by_their_ancestors(spark, monkeypatch):
    monkeypatch.setattr(checksums, "MOST_RANGES", 3)
    spec = table("t", "k:int64 s:string", keys="k")
    source = spark.range(0, 600_000, 50).select(F.col("id").alias("k"), F.lit("a").alias("s"))
    target = source.withColumn("s", F.when(F.col("k") % 100_000 == 0, "b").otherwise(F.col("s")))
    fast, full = checksums.field_failures(source, target, spec), reconcile.field_check(source, target, spec, only_failures=True)
    assert sorted(map(str, fast.collect())) == sorted(map(str, full.collect())) and fast.count() == 6


# --- intervals of offsets --------------------------------------------------------------------


def spans(numbers):
    out = []
    for x in sorted(set(numbers)):
        if out and out[-1][1] + 1 == x:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(x) for x in out]


def test_intervals_of_seen_offsets(spark):
    rng = random.Random(6)
    size = 1 << offsets.CHUNK_BITS
    batches = [list(range(100)) + [size - 2, size - 1], [50, 60, 200, size, size + 1, 5 * size], list(range(100, 200)), [rng.randint(0, 300) for _ in range(200)], []]
    shape = "topic string, part int, chunk bigint, " + offsets.SPANS
    known, all_of = spark.createDataFrame([], shape), {("t", 0): set(), (None, 1): set()}
    for batch in batches:
        for topic, part in all_of:
            ids = spark.createDataFrame([(topic, part, o) for o in batch + batch[:3]], "topic string, part int, o bigint")
            fresh = offsets.new_ids(ids, known, ["topic", "part"], "o")
            assert {r.o for r in fresh.collect()} == set(batch) - all_of[topic, part]
            all_of[topic, part] |= set(batch)
            known = spark.createDataFrame(offsets.merged(known, offsets.seen(ids, ["topic", "part"], "o"), ["topic", "part"]).collect(), shape)
    got = sorted(((r.topic, r.part, r.lo, r.hi) for r in offsets.intervals(known, ["topic", "part"]).collect()), key=str)
    assert got == sorted(((t, p, lo, hi) for (t, p), xs in all_of.items() for lo, hi in spans(xs)), key=str)
    assert known.count() == 6  # three chunks each


def test_rows_without_an_offset_are_kept(spark):
    ids = spark.createDataFrame([("t", None), ("t", 1)], "topic string, o bigint")
    known = offsets.seen(ids, ["topic"], "o")
    assert [(r.topic, r.o) for r in offsets.new_ids(ids, known, ["topic"], "o").collect()] == [("t", None)]
