"""The stored changelog: parquet, a folder for each statement or stream batch, in it one per month of the version."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column as SqlColumn, DataFrame, SparkSession, functions as F, types as T

from changelake.operators.versions import moment
from changelake.specs import VERSION_ORDER, TableSpec

# Log retention limits and the settings offered by default.
HOUR_MS = 3_600_000
MAX_RETENTION_HOURS = 168
RETENTION_HOURS = {"aggressive": 1, "balanced": 4, "conservative": 24}


def arranged(log: DataFrame, spec: TableSpec, layout: str = "range") -> DataFrame:
    """Log rows laid out for writing by month, sorted by key so files skip well.

    ``range`` cuts months into key ranges. The version columns are part of the range, so
    neither a hot month nor a hot key ends up in one task. It samples its input, so a
    costly input is computed twice. ``month`` gathers months in one pass, and adaptive
    execution splits the big ones; files of a month then overlap in their keys.
    Rows without ``is_deleted`` belong to an append-only table and take its own sort order.
    """
    by = ["yyyymm", *(spec.keys if "is_deleted" in log.columns else spec.append_sort)]
    by += [c for c in VERSION_ORDER if c in log.columns and c not in by]
    if layout == "range":
        return log.repartitionByRange(*by).sortWithinPartitions(*by)
    if layout == "month":
        return log.hint("rebalance", F.col("yyyymm")).sortWithinPartitions(*by)
    raise ValueError(f"unknown layout {layout!r}")


#: Column of the folders that statements and stream batches write to; each write has one of its own.
LOG_PART = "log_part"
#: Parts that replace months of others are called this and a number; they count once the table below names them.
REWRITE = "rewrite-"
#: Under the log: which month of which part a rewrite replaced. One file for each rewrite, which appears at once.
PUBLISHED = "_rewrites/published"
PUBLISHED_SCHEMA = "part string, replaced_part string, replaced_month int"
#: How files of the log are written: offsets and sorted keys as differences to the row before.
FORMAT = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


def append_log(
    log: DataFrame,
    path: str,
    spec: TableSpec,
    layout: str | None = "range",
    rows_per_file: int = 0,
    part: str | None = None,
    bloom: Sequence[str] = (),
) -> None:
    """Append to a stored log, also to one that a stream writes to. Without a layout rows are written as they come.

    ``part`` names the write: a second one of the same name replaces the first, so a repeated stream batch adds nothing.
    ``bloom`` names columns that get a Parquet Bloom filter for each row group, in place of a dictionary, which would keep the
    filter from being written. A look-up of one key then reads the row groups that may hold it only, also where key ranges of files overlap.
    """
    rows = arranged(log, spec, layout) if layout else log
    folder = f"{path.rstrip('/')}/{LOG_PART}={part or 'statement-' + uuid.uuid4().hex}"
    options = FORMAT | {f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom} | {f"parquet.enable.dictionary#{c}": "false" for c in bloom}
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).options(**options)
    writer.partitionBy("yyyymm").parquet(folder)


def save_bucketed(rows: DataFrame, name: str, keys: tuple[str, ...], buckets: int) -> None:
    """Save a table hashed and sorted by its keys.

    Two tables saved with the same keys and buckets are joined on them, and resolved to
    their latest versions, without a shuffle.
    """
    spread = rows.repartition(buckets, *keys)
    spread.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def read_log(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """All statements and finished stream batches. Schema comes from the spec: no inference, and an empty log reads as empty.

    Months that a rewrite replaced are not read.
    """
    return visible_rows(spark, path, spec).drop(LOG_PART)


def folder_name(part: str | SqlColumn, month: str | SqlColumn) -> SqlColumn:
    """Name of one month of one part, as an expression over the partition columns, so that it picks folders before they are read."""
    return F.concat_ws("/", part, F.col(month).cast("string") if isinstance(month, str) else month)


def visible_rows(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """Rows of the log with the part they stand in, without replaced months and unpublished rewrites.

    The list of replaced folders is read by the driver, which lists the folders themselves for any read of the log.
    """
    schema = T.StructType([*spec.log_schema.fields, T.StructField(LOG_PART, T.StringType())])
    rows = spark.read.schema(schema).parquet(path)
    table = published(spark, path)
    if table is None:
        return rows.where(F.coalesce(~F.col(LOG_PART).startswith(REWRITE), F.lit(True)))
    replaced = table.collect()
    parts, gone = {r.part for r in replaced}, [f"{r.replaced_part}/{r.replaced_month}" for r in replaced]
    shown = ~F.col(LOG_PART).startswith(REWRITE) | F.col(LOG_PART).isin(list(parts))
    return rows.where(F.coalesce(shown & ~folder_name(LOG_PART, "yyyymm").isin(gone), F.lit(True)))


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of rewrites, or None if there was none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{PUBLISHED}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(PUBLISHED_SCHEMA).parquet(folder.toString())


def reset(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Remove all rows and versions of a stored table; its folder stays readable.

    A stream that writes to it may go on from its checkpoint: its next batch is the first content of the log.
    """
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def backup(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Plain copy. Refuses to replace an earlier backup."""
    rows.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def with_new_columns(rows: DataFrame, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """Old rows in a newer schema: columns are matched by name, new ones get their default."""
    out = []
    for f in schema.fields:
        value = F.col(f.name) if f.name in rows.columns else F.lit(defaults.get(f.name))
        out.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def migrate(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Append-only rows (no deletes) as versioned log rows."""
    return with_new_columns(rows, spec.log_schema, {"is_deleted": 0, "offset": 0})


def retain(messages: DataFrame, retention_ms: int | dict[str, int], at: datetime | SqlColumn | None = None, default_ms: int | None = None) -> DataFrame:
    """Raw messages younger than the retention time, one for all topics or one per topic.

    A topic without its own setting uses ``default_ms``, or is kept whole. The policy is
    a literal in the filter. For raw messages only: the changelog must keep its versions.
    """
    if isinstance(retention_ms, int):
        keep_ms = F.lit(retention_ms)
    else:
        keep_ms = F.lit(default_ms)
        for topic, ms in retention_ms.items():
            keep_ms = F.when(F.col("topic") == topic, F.lit(ms)).otherwise(keep_ms)
    oldest = moment(at) - F.make_dt_interval(secs=keep_ms.cast("decimal(18,6)") / 1000)
    return messages.filter(F.coalesce(F.col("timestamp") >= oldest, F.lit(True)))


def retention_from_hours(hours: int) -> int:
    if not 1 <= hours <= MAX_RETENTION_HOURS:
        raise ValueError(f"retention must be 1..{MAX_RETENTION_HOURS} hours")
    return hours * HOUR_MS
