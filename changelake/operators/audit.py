"""Counts, rates and summaries over a changelog, and plain aggregates over any table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column as SqlColumn, DataFrame, functions as F

from changelake.functions import start_of_minute
from changelake.operators.ranks import quantile
from changelake.operators.versions import latest, moment

# Fixed value: advice for the partition count of a topic.
RECORDS_PER_PARTITION = 15_000_000


def recent(rows: DataFrame, window: str, at: datetime | SqlColumn | None = None, ts: str = "cdc_timestamp") -> DataFrame:
    """Rows of the last ``window`` (such as ``"1 hour"``) before ``at``."""
    return rows.filter(F.col(ts) >= moment(at) - F.expr(f"INTERVAL {window}"))


def on_day(rows: DataFrame, at: datetime | SqlColumn | None = None, ts: str = "cdc_timestamp") -> DataFrame:
    return rows.filter(F.to_date(ts) == F.to_date(moment(at)))


def op_counts(
    log: DataFrame, keys: Sequence[str], window: str = "1 hour", at: datetime | SqlColumn | None = None
) -> DataFrame:
    """Operations of current rows written in the last ``window``."""
    return recent(latest(log, keys), window, at).groupBy("cdc_operation").agg(F.count("*").alias("count"))


def op_rates(log: DataFrame) -> DataFrame:
    """Deletes, inserts and updates per minute over all versions. Snapshot reads are not counted."""
    op = F.col("cdc_operation")
    return log.groupBy(start_of_minute("cdc_timestamp").alias("minute")).agg(
        F.count_if(op == "d").alias("deletes"),
        F.count_if(op == "c").alias("inserts"),
        F.count_if(op == "u").alias("updates"),
    )


def summary(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total, active and deleted records in one pass over the current rows."""
    counts = latest(log, keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_deleted") == 0).alias("active"),
        F.count_if(F.col("is_deleted") == 1).alias("deleted"),
    )
    return counts.select(
        F.stack(
            F.lit(3),
            F.lit("Total Records"), F.col("total"),
            F.lit("Active Records"), F.col("active"),
            F.lit("Deleted Records"), F.col("deleted"),
        ).alias("category", "count")
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def table_counts(tables: dict[str, DataFrame], total: str | None = "TOTAL") -> DataFrame:
    """Rows per table, and their sum under the label ``total``."""
    counts = union_all(
        [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    )
    if total is None:
        return counts.select("table_name", F.col("n").alias("row_count"))
    summed = counts.rollup("table_name").agg(F.sum("n").alias("row_count"))
    return summed.select(F.coalesce("table_name", F.lit(total)).alias("table_name"), "row_count")


def storage_stats(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, files and bytes of a file-backed table, per ``by`` columns.

    Rows are counted per file first, so the second step sees one row per file.
    """
    meta = F.col("_metadata")
    files = table.groupBy(
        *by, meta["file_path"].alias("file_path"), meta["file_size"].alias("file_size")
    ).agg(F.count("*").alias("n"))
    return files.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.count("*").alias("files"), F.sum("file_size").alias("bytes")
    )


def partition_plan(counts: DataFrame, records: str = "row_count", per: int = RECORDS_PER_PARTITION) -> DataFrame:
    """Adds the partition count advised for each table."""
    wanted = F.ceil(F.col(records) / F.lit(per)).cast("bigint")
    return counts.withColumn("partitions", F.greatest(wanted, F.lit(1).cast("bigint")))


def percentile(rows: DataFrame, value: str, p: float, by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Approximate percentile per group; its sketch has a fixed size."""
    return rows.groupBy(*by).agg(F.percentile_approx(value, p, accuracy).alias("percentile"))


def exact_percentile(
    rows: DataFrame, value: str, p: float, by: Sequence[str] = (), accuracy: int = 10_000, small: int = 0
) -> DataFrame:
    """Interpolated percentile per group, without gathering a group in one place: see ``ranks.quantile``.

    The plan is the same at every size; ``small`` is no longer used.
    """
    return quantile(rows, value, p, by, accuracy).withColumnRenamed("quantile", "percentile")
