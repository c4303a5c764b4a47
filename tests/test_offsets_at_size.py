"""Offsets seen, where a chunk holds thousands of intervals."""

from pyspark.sql import functions as F, types as T

from changelake.streaming import offsets

SOURCE = ["topic", "part"]


def test_rows_are_not_tested_against_every_interval(spark):
    """Every other offset of three chunks seen, each chunk 32,768 intervals: the odd ones and those without an offset are new."""
    size = 3 << offsets.CHUNK_BITS
    ids = spark.range(size).select(F.lit("t").alias("topic"), F.lit(None).cast("int").alias("part"), F.col("id").alias("o"), F.lit("x").alias("_row"))
    known = offsets.seen(ids.where("o % 2 = 0"), SOURCE, "o")
    batch = ids.unionByName(ids.limit(1).withColumn("o", F.lit(None).cast("bigint")))
    new = offsets.new_ids(batch, known, SOURCE, "o")
    assert new.columns == batch.columns
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan and "Join" not in plan
    assert new.agg(F.count("*"), F.sum(F.col("o") % 2), F.count("o")).first() == (size // 2 + 1, size // 2, size // 2)


def test_edges_and_sources(spark):
    shape = T.StructType.fromDDL(f"topic string, part int, chunk bigint, {offsets.SPANS}")
    known = spark.createDataFrame([("t", 1, 0, [(3, 5), (9, 9)]), (None, None, 0, [(0, 1)]), ("t", 1, -1, [(-4, -2)])], shape)
    rows = [("t", 1, o) for o in (-5, -4, -2, -1, 2, 3, 5, 6, 9, 10)] + [(None, None, 1), (None, None, 2), ("t", 2, 4), ("u", None, 0)]
    batch = spark.createDataFrame([*rows, rows[0]], "topic string, part int, o bigint")
    found = sorted(map(str, map(tuple, offsets.new_ids(batch, known, SOURCE, "o").collect())))
    assert found == sorted(map(str, [("t", 1, -5), ("t", 1, -5), ("t", 1, -1), ("t", 1, 2), ("t", 1, 6), ("t", 1, 10), (None, None, 2), ("t", 2, 4), ("u", None, 0)]))
