"""The versioned changelog and its views.

Every view that depends on the current row of a key first picks the latest version over
the whole log and filters afterwards. Filters on key columns pass below that step and
reach the file scan on their own; any other filter must not.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column as SqlColumn, DataFrame, Window, functions as F

from changelake.functions import op_label
from changelake.operators.ranks import carried
from changelake.operators.skew import spread_join
from changelake.specs import VERSION_ORDER, TableSpec

# Fixed value: soft-deleted rows are kept this long.
TOMBSTONE_DAYS = 90

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def moment(at: datetime | SqlColumn | None) -> SqlColumn:
    """``as_of`` argument as a column: a datetime (UTC if it has no zone), a column, or now."""
    if at is None:
        return F.current_timestamp()
    if not isinstance(at, datetime):
        return at
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit((at - EPOCH) // timedelta(microseconds=1)).cast("bigint"))


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str] = VERSION_ORDER) -> DataFrame:
    """The newest version of each key.

    ``row_number() = 1`` is planned with a group limit on both sides of the shuffle: each
    map task sends at most one row per key, so a key holding a third of the log costs its
    reducer one row per map task, not all its versions. When logs with restarted
    offsets are combined, pass ``order=("cdc_timestamp", "ingest_epoch", "offset")``.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    ranked = log.withColumn("_version_rank", F.row_number().over(newest_first))
    return ranked.filter("_version_rank = 1").drop("_version_rank")


def active(log: DataFrame, keys: Sequence[str], order: Sequence[str] = VERSION_ORDER) -> DataFrame:
    return latest(log, keys, order).filter("is_deleted = 0")


def active_view(log: DataFrame, spec: TableSpec, keys: Sequence[str] | None = None) -> DataFrame:
    """Active rows with the columns of the published view."""
    return active(log, keys or spec.keys).select(*spec.names, "cdc_operation", "cdc_timestamp")


def register_views(log: DataFrame, spec: TableSpec) -> None:
    """Temp views ``<table>`` (all versions), ``<table>_final`` and ``<table>_active``."""
    log.createOrReplaceTempView(spec.name)
    latest(log, spec.keys).createOrReplaceTempView(f"{spec.name}_final")
    active_view(log, spec).createOrReplaceTempView(f"{spec.name}_active")


def deleted(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose newest version is a delete."""
    return latest(log, keys).filter("is_deleted = 1")


def newest_first(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Listing by time, newest first; keys break ties so the listing is repeatable."""
    return rows.orderBy(F.col("cdc_timestamp").desc(), *keys)


def audit_trail(log: DataFrame, keys: Sequence[str], n: int = 100) -> DataFrame:
    """The last ``n`` changes over current rows, labelled."""
    rows = latest(log, keys).select(
        *keys,
        "cdc_operation",
        op_label("cdc_operation").alias("operation_type"),
        "is_deleted",
        "cdc_timestamp",
    )
    return newest_first(rows, keys).limit(n)


def lifecycle(log: DataFrame, key: dict[str, object], order: Sequence[str] = VERSION_ORDER) -> DataFrame:
    """All versions of one record, oldest first."""
    for name, value in key.items():
        log = log.filter(F.col(name) == F.lit(value))
    return log.orderBy(*order)


def as_of(log: DataFrame, keys: Sequence[str], at: datetime | SqlColumn) -> DataFrame:
    """State at a time: later versions are removed before the newest is picked."""
    return latest(log.filter(F.col("cdc_timestamp") <= moment(at)), keys)


def as_of_many(
    log: DataFrame, keys: Sequence[str], asked: DataFrame, at: str = "at", order: Sequence[str] = VERSION_ORDER
) -> DataFrame:
    """State at many moments in one pass: for each row of ``asked`` (``keys`` and the moment ``at``) the newest version up to it.

    Versions and moments are put in one order per key and the last version is carried to the moments after it, over the
    edges of the range partitions too: no range join, and a key with a third of the log or of the moments is spread like any
    other. Every asked row comes back with its columns and ``version``, a struct of the log's columns, which is null where
    the key had no version yet. Moments and keys may repeat and be null; a null moment has no version.
    """
    rest = [c for c in log.columns if c not in keys]
    none = lambda t: F.lit(None).cast(t)
    image = F.struct(*[F.col(f"`{c}`") for c in rest])
    extra = [c for c in asked.columns if c not in keys]
    shape = log.select(image.alias("v")).schema["v"].dataType
    extras = asked.select(F.struct(*[F.col(f"`{c}`") for c in extra]).alias("q")).schema["q"].dataType
    places = [f"_o{i}" for i in range(1, len(order))]
    versions = log.select(
        *keys, F.col(order[0]).cast("timestamp").alias("_o0"), F.lit(0).alias("_kind"), *[F.col(c).alias(p) for c, p in zip(order[1:], places)],
        image.alias("_v"), none(extras).alias("_q"),
    )
    moments = asked.select(
        *keys, F.col(f"`{at}`").cast("timestamp").alias("_o0"), F.lit(1).alias("_kind"), *[none(log.schema[c].dataType).alias(p) for c, p in zip(order[1:], places)],
        none(shape).alias("_v"), F.struct(*[F.col(f"`{c}`") for c in extra]).alias("_q"),
    )
    last = carried(versions.unionByName(moments), F.col("_v"), ["_o0", "_kind", *places], keys, "_last")
    version = F.when(F.col("_o0").isNotNull(), F.col("_last")).alias("version")
    return last.where("_kind = 1").select(*keys, *[F.col(f"_q.`{c}`") for c in extra], version)


def compact(log: DataFrame, keys: Sequence[str], scope: str = "global") -> DataFrame:
    """Drop superseded versions: over the whole log, or within each month only.

    Month-wise compaction is what background merges of a month-partitioned table reach;
    it shortens the log but leaves one version per key and month.
    """
    if scope == "global":
        return latest(log, keys)
    if scope == "partition":
        return latest(log, ["yyyymm", *keys])
    raise ValueError(f"unknown scope {scope!r}")


def expired_keys(
    log: DataFrame, keys: Sequence[str], at: datetime | SqlColumn | None = None, days: int = TOMBSTONE_DAYS
) -> DataFrame:
    """Keys deleted more than ``days`` ago and not written since."""
    cut = moment(at) - F.make_dt_interval(days=F.lit(days))
    return deleted(log, keys).filter(F.col("cdc_timestamp") < cut).select(*keys)


def expire_deleted(
    log: DataFrame, keys: Sequence[str], at: datetime | SqlColumn | None = None, days: int = TOMBSTONE_DAYS
) -> DataFrame:
    """The log without the keys deleted long ago.

    All versions of such a key go together; removing the delete alone would bring the
    row back.
    """
    return spread_join(log, expired_keys(log, keys, at, days), keys, "left_anti", VERSION_ORDER)


def of_keys(log: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Log rows of the listed keys, for lists too long for ``isin``."""
    return spread_join(log, wanted.select(*keys).distinct(), keys, "left_semi", VERSION_ORDER)
