"""The current table, kept up to date from a stream of log rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from changelake.operators.versions import latest
from changelake.specs import VERSION_ORDER, TableSpec


def latest_stream(log: DataFrame, keys: Sequence[str], order: Sequence[str] = VERSION_ORDER) -> DataFrame:
    """Newest version per key as a streaming aggregate, for update-mode sinks.

    Keeps one row per key as state; use the RocksDB state store. Partial aggregation
    reduces a hot key to one row per task before the shuffle. Keys come from the grouping,
    so filters on them pass through.
    """
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_newest")
    return log.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in rest])


def maintain_current(
    log: DataFrame, spec: TableSpec, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the newest version per key in files, without state.

    Each micro-batch is cut to one row per key and written to its own folder, which a
    repeated batch overwrites, so the at-least-once call is harmless. ``read_current``
    resolves the folders and ``fold_current`` merges them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = latest(batch, spec.keys).sortWithinPartitions(*spec.keys)
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(f"current_{spec.name}")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _batches(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    schema = T.StructType([*spec.log_schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(path)


def _finished(spark: SparkSession, path: str) -> int | None:
    """Number of the last batch such that it and all before it carry the mark of a committed write."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(pattern: str, up: bool) -> set[int]:
        found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")) or []
        names = [(f.getPath().getParent() if up else f.getPath()).getName() for f in found]
        return {int(n.partition("=")[2]) for n in names if not n.startswith("batch=-")}

    done, there = numbers("batch=*/_SUCCESS", True), numbers("batch=*", False)
    sure = [n for n in done if not any(m <= n for m in there - done)]
    return max(sure, default=None)


def read_current(spark: SparkSession, path: str, spec: TableSpec, folded: int | None = None) -> DataFrame:
    """The current table. ``folded`` is the return value of the last ``fold_current``.

    It only saves reading: folders merged by the fold are skipped. The result is the same
    without it.
    """
    rows = _batches(spark, path, spec)
    if folded is not None:
        rows = rows.filter((F.col("batch") == -(folded + 1)) | (F.col("batch") > folded))
    return latest(rows.drop("batch"), spec.keys)


def fold_current(spark: SparkSession, path: str, spec: TableSpec, folded: int | None = None) -> int | None:
    """Merge the finished batch folders into one, next to them; the stream may go on.

    Only folders whose write was committed count, up to the last before one under way.

    Returns the number of the last merged batch. Folders up to it can be deleted once no
    reader uses them. A fold that fails half-way changes no result; its folder is never
    written over.
    """
    last = _finished(spark, path)
    if last is None or last == folded:
        return folded
    fresh = F.col("batch") >= 0 if folded is None else (F.col("batch") == -(folded + 1)) | (F.col("batch") > folded)
    rows = _batches(spark, path, spec).filter(fresh & (F.col("batch") <= last)).drop("batch")
    merged = latest(rows, spec.keys).repartitionByRange(*spec.keys).sortWithinPartitions(*spec.keys)
    merged.write.mode("errorifexists").parquet(f"{path}/batch={-(last + 1)}")
    return last
