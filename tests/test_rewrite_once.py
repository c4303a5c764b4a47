"""A rewrite evaluates what it keeps once."""

from pyspark.sql import functions as F

from changelake.plans import fixtures as fx
from changelake.sources import changelog, maintenance


def test_keep_is_evaluated_once(spark, tmp_path):
    """Rows picked at random: were they picked again for the counts or the layout, the rewrite would not add up."""
    path = str(tmp_path / "log")
    numbers = ("l_orderkey bigint", "l_linenumber bigint", "l_partkey bigint", "l_quantity double", "l_linestatus string")
    line = [F.col("id").cast(x.split()[1]).alias(x.split()[0]) for x in numbers]
    at = F.make_timestamp(F.lit(1996), F.lit(1) + F.col("id") % 6, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    log = spark.range(600).select(
        *line, F.lit("c").alias("cdc_operation"), at.alias("cdc_timestamp"), F.lit(0).cast("smallint").alias("is_deleted"), F.current_timestamp().alias("processing_time"),
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), (199601 + F.col("id") % 6).cast("int").alias("yyyymm"),
    )
    changelog.append_log(log, path, fx.LINEITEM)
    calls = []

    def keep(rows):
        calls.append(1)
        return rows.where(F.rand() < 0.5)

    assert maintenance.rewrite(spark, path, fx.LINEITEM, keep) == [199601 + m for m in range(6)]
    assert len(calls) == 1
    left = changelog.read_log(spark, path, fx.LINEITEM)
    assert 200 < left.count() < 400 and left.select("offset").distinct().count() == left.count()
