"""Consumer lag and throughput."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from changelake.operators.skew import spread_join

# Lag that counts as caught up, and how long to wait for it.
LAG_THRESHOLD = 1_000_000
WAIT_SECONDS = 300
POLL_SECONDS = 5


def offsets_frame(spark: SparkSession, offsets: str | dict) -> DataFrame:
    """Offsets as reported by a stream's progress, ``{topic: {partition: offset}}``, as rows."""
    text = offsets if isinstance(offsets, str) else json.dumps(offsets)
    rows = spark.createDataFrame([(text,)], "j string")
    topics = rows.select(F.explode(F.from_json("j", "map<string,map<string,bigint>>")).alias("topic", "parts"))
    return topics.select("topic", F.explode("parts").alias("p", "offset")).select(
        "topic", F.col("p").cast("int").alias("partition"), "offset"
    )


def partition_lag(end: DataFrame, committed: DataFrame) -> DataFrame:
    """Messages not yet consumed, per topic and partition; a partition never read counts whole."""
    done = committed.select("topic", "partition", F.col("offset").alias("committed"))
    return end.join(done, ["topic", "partition"], "left").select(
        "topic", "partition", (F.col("offset") - F.coalesce("committed", F.lit(0))).alias("lag")
    )


def lag_by_topic(end: DataFrame, committed: DataFrame, total: str | None = "TOTAL") -> DataFrame:
    """Lag per topic, and their sum under the label ``total``."""
    lags = partition_lag(end, committed)
    if total is None:
        return lags.groupBy("topic").agg(F.sum("lag").alias("lag"))
    summed = lags.rollup("topic").agg(F.sum("lag").alias("lag"))
    return summed.select(F.coalesce("topic", F.lit(total)).alias("topic"), "lag")


def throughput_series(samples: DataFrame, threshold: int = LAG_THRESHOLD) -> DataFrame:
    """Change of lag and records since the previous sample of a topic, and records per second.

    Input is ``(topic, sampled_at, lag, records)``. The first sample is the baseline and
    has no change. Samples are ordered day by day; the step from one day to the next goes
    through a table with one row per topic and day, so no task sorts a topic's whole history.
    """
    topic_day = ["topic", "_day"]
    rows = samples.withColumn("_day", F.to_date("sampled_at"))
    place = F.struct("sampled_at", "lag", "records")
    last = rows.groupBy(*topic_day).agg(F.max_by(place, F.col("sampled_at")).alias("_last"))
    carried = last.select(*topic_day, F.lag("_last").over(Window.partitionBy("topic").orderBy("_day")).alias("_carried"))
    within = Window.partitionBy(*topic_day).orderBy("sampled_at")
    previous = F.coalesce(F.lag(place).over(within), F.col("_carried"))
    joined = rows.join(carried, topic_day).withColumn("_prev", previous)
    seconds = F.unix_seconds(F.col("sampled_at").cast("timestamp")) - F.unix_seconds(F.col("_prev.sampled_at").cast("timestamp"))
    grown = F.col("records") - F.col("_prev.records")
    return joined.select(
        "topic",
        "sampled_at",
        "lag",
        "records",
        (F.col("lag") - F.col("_prev.lag")).alias("lag_change"),
        grown.alias("record_change"),
        F.call_function("div", grown, F.nullif(seconds, F.lit(0).cast("bigint"))).alias("records_per_second"),
        (F.col("lag") < threshold).alias("caught_up"),
    )


def until_caught_up(series: DataFrame) -> DataFrame:
    """The series up to and including each topic's first sample below the threshold."""
    first = series.groupBy("topic").agg(F.min(F.when(F.col("caught_up"), F.col("sampled_at"))).alias("_stop"))
    return spread_join(series, first, ["topic"], "inner", ["sampled_at"]).filter("_stop IS NULL OR sampled_at <= _stop").drop("_stop")


def wait_for_lag(
    current_lag: Callable[[], int | None],
    threshold: int = LAG_THRESHOLD,
    timeout_s: float = WAIT_SECONDS,
    poll_s: float = POLL_SECONDS,
) -> bool:
    """Poll a lag reading until it is under the threshold; false if it is not by the time-out."""
    waited = 0.0
    while waited < timeout_s:
        lag = current_lag()
        if not lag or lag < threshold:
            return True
        time.sleep(poll_s)
        waited += poll_s
    return False
