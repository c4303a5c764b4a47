"""Decoding of literal envelopes."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from changelake.operators.envelope import decode, decode_legacy, encode, parse_messages, rejects
from changelake.specs import TITLE_TABLES, table

RATINGS, BASICS = TITLE_TABLES["title_ratings"], TITLE_TABLES["title_basics"]
AKAS = TITLE_TABLES["title_akas"]


def messages(spark, *texts):
    rows = [("t", 0, i, t if t is None or isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "topic string, partition int, offset bigint, value string")


def change(op, before=None, after=None, ts_ms=1_700_000_000_000):
    return {"op": op, "before": before, "after": after, "ts_ms": ts_ms}


def rating(tconst, value, votes):
    return {"tconst": tconst, "averageRating": value, "numVotes": votes}


def test_ratings_rows(spark):
    given = [("test001", 8.5, 1000), ("test002", 9.1, 999999), ("test003", 0.1, 1), ("test004", 10.0, 0), ("test005", 1.0, 2147483647)]
    log = decode(messages(spark, *[change("c", after=rating(*g)) for g in given]), RATINGS)
    rows = log.orderBy("tconst").collect()
    assert [(r.tconst, round(r.averageRating, 4), r.numVotes) for r in rows] == given
    assert {(r.cdc_operation, r.is_deleted) for r in rows} == {("c", 0)}
    assert dict(log.dtypes)["averageRating"] == "float" and dict(log.dtypes)["numVotes"] == "bigint"
    assert all(r.processing_time is not None for r in rows)


def test_basics_rows(spark):
    names = BASICS.names
    given = [
        ("test001", "movie", "Test Movie 1", "Original Title 1", 0, 2020, 0, 120, "Drama,Action"),
        ("test002", "tvSeries", "Test TV Show", "Test TV Show", 0, 2021, 2023, 45, "Comedy,Romance"),
        ("test003", "short", "Test Short", "Test Short", 1, 1990, 0, 5, "Documentary"),
        ("test004", "movie", "Special Chars: @#$%", "Spëcïål Çhārs", 0, 2024, 0, 90, "Sci-Fi,Thriller"),
        ("test005", "tvEpisode", "Empty Genre Test", "Empty Genre", 0, 2022, 0, 30, ""),
    ]
    log = decode(messages(spark, *[change("c", after=dict(zip(names, g))) for g in given]), BASICS)
    rows = log.orderBy("tconst").collect()
    assert [tuple(r[n] for n in names[:-1]) for r in rows] == [g[:-1] for g in given]
    assert [r.genres for r in rows] == [["Drama", "Action"], ["Comedy", "Romance"], ["Documentary"], ["Sci-Fi", "Thriller"], [""]]
    empty = decode(messages(spark, change("c", after=dict(zip(names, given[4])))), BASICS, empty_lists="empty")
    assert empty.first().genres == []


def test_null_and_missing_become_defaults(spark):
    log = decode(messages(spark, change("c", after={"tconst": "a", "startYear": None})), BASICS)
    row = log.first()
    assert (row.titleType, row.startYear, row.isAdult, row.genres) == ("", 0, 0, [""])
    kept = decode(messages(spark, change("c", after={"tconst": "a"})), BASICS, null_policy="keep").first()
    assert (kept.titleType, kept.startYear, kept.genres) == (None, None, None)


def test_bad_field_does_not_spoil_the_row(spark):
    row = decode(messages(spark, change("c", after={"tconst": "a", "startYear": "soon", "runtimeMinutes": 90})), BASICS).first()
    assert (row.tconst, row.startYear, row.runtimeMinutes) == ("a", 0, 90)


def test_overflow_policies(spark):
    given = messages(spark, change("c", after={"tconst": "a", "isAdult": 2019, "startYear": 70000}))
    wrapped = decode(given, BASICS).first()
    assert (wrapped.isAdult, wrapped.startYear) == (227, 4464)
    nulled = decode(given, BASICS, overflow="null", null_policy="keep").first()
    assert (nulled.isAdult, nulled.startYear) == (None, None)
    with pytest.raises(Exception, match="out of range"):
        decode(given, BASICS, overflow="fail").collect()
    negative = decode(messages(spark, change("c", after={"tconst": "a", "isAdult": -1})), BASICS).first()
    assert negative.isAdult == 0


def test_rating_may_stay_a_decimal(spark):
    spec = table("t", "tconst:string averageRating:decimal3_1 numVotes:uint32", keys="tconst")
    row = decode(messages(spark, change("c", after=rating("a", 9.1, 1)), change("d", before=rating("b", 1, 1))), spec).orderBy("tconst").collect()
    assert [str(r.averageRating) for r in row] == ["9.1", "0.0"]


def test_delete_takes_keys_from_before(spark):
    before = {"titleId": "t1", "ordering": 3, "title": "x", "types": "a,b"}
    row = decode(messages(spark, change("d", before=before)), AKAS).first()
    assert (row.titleId, row.ordering, row.title, row.types, row.is_deleted) == ("t1", 3, "", [], 1)


def test_timestamp_is_cut_to_seconds(spark):
    given = messages(spark, change("c", after=rating("a", 1.0, 1), ts_ms=1_700_000_000_987))
    row = decode(given, RATINGS).select(F.col("cdc_timestamp").cast("timestamp_ntz").alias("t"), "yyyymm").first()
    assert (row.t, row.yyyymm) == (datetime(2023, 11, 14, 22, 13, 20), 202311)
    exact = decode(given, RATINGS, version_precision="ms").select(F.col("cdc_timestamp").cast("timestamp_ntz").alias("t")).first()
    assert exact.t == datetime(2023, 11, 14, 22, 13, 20, 987000)


def test_rejects_and_legacy(spark):
    given = messages(
        spark,
        None,
        "{broken",
        change("x", after=rating("a", 1.0, 1)),
        change("c", after=rating("", 1.0, 1)),
        change("d", before=rating("", 1.0, 1)),
        change("c", after=rating("ok", 1.0, 1)),
        change("d", before=rating("gone", 1.0, 1)),
    )
    found = {r.offset: r.reason for r in rejects(given, RATINGS).collect()}
    assert found == {0: "null message", 1: "malformed", 2: "unknown operation", 3: "blank key", 4: "blank key"}
    assert {r.tconst for r in decode(given, RATINGS).collect()} == {"ok", "gone"}
    legacy = decode_legacy(given, RATINGS)
    assert [r.tconst for r in legacy.collect()] == ["ok"] and "is_deleted" not in legacy.columns


def test_encode_round_trip(spark):
    given = messages(spark, change("u", before=rating("a", 1.0, 1), after=rating("a", 2.0, 2)), change("d", before=rating("b", 1.0, 1)))
    again = encode(parse_messages(given, RATINGS), RATINGS)
    assert [json.loads(r.value) for r in again.orderBy("offset").collect()] == [
        json.loads(r.value) for r in given.orderBy("offset").collect()
    ]


def test_message_is_parsed_once(spark):
    plan = decode(messages(spark, change("c", after=rating("a", 1.0, 1))), RATINGS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1
