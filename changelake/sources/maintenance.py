"""Maintenance of a stored log as jobs: months that change are written anew, others are not touched.

A rewrite reads the finished parts of the log as they are when it starts, writes the changed months to a part of its own and then
publishes, in one file, which months of which parts it replaced. Readers see either the old months or the new ones. A stream or a
statement may go on writing: what it adds has a part of its own that no rewrite of an earlier moment replaces. A rewrite that
fails before it is published changes no result. Run one at a time. Replaced files stay until ``replaced_folders`` are deleted
by whoever knows that no reader uses them any more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column as SqlColumn, DataFrame, SparkSession, functions as F

from changelake.operators.versions import TOMBSTONE_DAYS, compact, expire_deleted
from changelake.session import written
from changelake.sources.changelog import LOG_PART, PUBLISHED, PUBLISHED_SCHEMA, REWRITE, append_log, folder_name, published, visible_rows
from changelake.specs import TableSpec


def _finished_parts(spark: SparkSession, path: str) -> list[str]:
    """Parts whose write was committed."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{LOG_PART}=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(f.getPath().getParent().getName().partition("=")[2] for f in found)


def rewrite(
    spark: SparkSession, path: str, spec: TableSpec, keep: Callable[[DataFrame], DataFrame], layout: str = "range", bloom: Sequence[str] = ()
) -> list[int]:
    """Reduce the log to the rows that ``keep`` leaves of it, and return the months written anew.

    ``keep`` gets all rows and returns some of them. It is evaluated once, into scratch space: its rows are counted, sampled for the
    layout and written from there. Only months that lose rows are written to the log; a month that loses all of them is replaced by
    nothing. An empty log, or one that loses nothing, is left as it is.
    """
    parts = _finished_parts(spark, path)
    there = visible_rows(spark, path, spec).where(F.col(LOG_PART).isin(parts))
    log = there.drop(LOG_PART)
    left = written(keep(log), "rewrite")
    # one row per month
    before, after = (rows.groupBy("yyyymm").agg(F.count("*").alias(n)) for rows, n in ((log, "n"), (left, "left")))
    counts = before.join(after, "yyyymm", "left").where("n > coalesce(left, 0)").collect()
    if not counts:
        return []
    months = sorted(r.yyyymm for r in counts)
    part = f"{REWRITE}{uuid.uuid4().hex}"
    append_log(left.where(F.col("yyyymm").isin(months)), path, spec, layout, part=part, bloom=bloom)
    wanted = sum(r.left or 0 for r in counts)
    found = spark.read.schema(spec.log_schema).parquet(f"{path.rstrip('/')}/{LOG_PART}={part}").count()
    if found != wanted:
        raise RuntimeError(f"rewrite of {path} has {found} rows instead of {wanted}; it was not published")
    replaced = there.where(F.col("yyyymm").isin(months)).select(LOG_PART, "yyyymm").distinct()
    marks = replaced.select(F.lit(part).alias("part"), F.col(LOG_PART).alias("replaced_part"), F.col("yyyymm").alias("replaced_month"))
    marks.to(spark.createDataFrame([], PUBLISHED_SCHEMA).schema).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{PUBLISHED}")
    return months


def compact_log(spark: SparkSession, path: str, spec: TableSpec, scope: str = "global", **options) -> list[int]:
    """Drop superseded versions from the store. Every view of current rows stays as it was."""
    return rewrite(spark, path, spec, lambda log: compact(log, spec.keys, scope), **options)


def expire_log(
    spark: SparkSession, path: str, spec: TableSpec, at: datetime | SqlColumn | None = None, days: int = TOMBSTONE_DAYS, **options
) -> list[int]:
    """Drop the keys deleted more than ``days`` before ``at`` from the store, with all their versions."""
    return rewrite(spark, path, spec, lambda log: expire_deleted(log, spec.keys, at, days), **options)


def drop_months(spark: SparkSession, path: str, spec: TableSpec, before: int, **options) -> list[int]:
    """Drop all versions of months before ``before`` (a number yyyymm), for append-only tables: elsewhere it may bring old rows back
    or lose current ones."""
    return rewrite(spark, path, spec, lambda log: log.where(F.col("yyyymm") >= before), **options)


def replaced_folders(spark: SparkSession, path: str) -> DataFrame | None:
    """Folders that no reader of the present state uses, or None if nothing was replaced yet."""
    table = published(spark, path)
    return table and table.select(folder_name(F.concat(F.lit(f"{LOG_PART}="), "replaced_part"), F.concat(F.lit("yyyymm="), "replaced_month")).alias("folder"))
