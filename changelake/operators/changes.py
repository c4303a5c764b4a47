"""Producers of change envelopes: snapshots, snapshot diffs and row statements."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column as SqlColumn, DataFrame, functions as F

from changelake.functions import join_list
from changelake.operators.versions import active, moment
from changelake.specs import TableSpec


def _millis(at: datetime | SqlColumn) -> SqlColumn:
    return F.unix_millis(moment(at))


def image(spec: TableSpec, frame: DataFrame, **replaced: SqlColumn) -> SqlColumn:
    """Row image struct. Lists become comma-joined text and decimals become doubles."""
    types = dict(frame.dtypes)
    fields = []
    for column in spec.columns:
        value = replaced.get(column.name, F.col(column.name))
        if types.get(column.name, "").startswith("array") and column.name not in replaced:
            value = join_list(value)
        fields.append(value.cast(column.json_type).alias(column.name))
    return F.struct(*fields)


def _no_image(spec: TableSpec) -> SqlColumn:
    return F.lit(None).cast(spec.row_schema)


def snapshot_to_changes(rows: DataFrame, spec: TableSpec, at: datetime | SqlColumn) -> DataFrame:
    """Existing rows as snapshot reads (op ``r``), to bootstrap a log."""
    return rows.select(
        F.lit("r").alias("op"),
        _no_image(spec).alias("before"),
        image(spec, rows).alias("after"),
        _millis(at).alias("ts_ms"),
    )


def diff_snapshots(old: DataFrame, new: DataFrame, spec: TableSpec, at: datetime | SqlColumn) -> DataFrame:
    """Creates, updates and deletes that turn ``old`` into ``new``.

    One full outer join on the source key, which is unique on both sides, so the join
    cannot skew. Rows that did not change are dropped before anything else happens.
    """
    pk = list(spec.source_pk)
    left = old.select(*pk, image(spec, old).alias("before"))
    right = new.select(*pk, image(spec, new).alias("after"))
    op = (
        F.when(F.col("before").isNull(), "c")
        .when(F.col("after").isNull(), "d")
        .when(~F.col("before").eqNullSafe(F.col("after")), "u")
    )
    return (
        left.join(right, pk, "full_outer")
        .select(op.alias("op"), "before", "after", _millis(at).alias("ts_ms"))
        .filter("op IS NOT NULL")
    )


def insert_rows(rows: DataFrame, spec: TableSpec, at: datetime | SqlColumn) -> DataFrame:
    """INSERT: every row as a create."""
    return snapshot_to_changes(rows, spec, at).withColumn("op", F.lit("c"))


def _next_place(log: DataFrame) -> list[SqlColumn]:
    """The new change follows the row's last one in the same partition of the log."""
    place = [F.col(c) for c in ("topic", "partition") if c in log.columns]
    return place + [(F.col("offset") + 1).alias("offset")]


def delete_where(log: DataFrame, spec: TableSpec, predicate: str | SqlColumn, at: datetime | SqlColumn) -> DataFrame:
    """DELETE ... WHERE: a delete for each active row that matches."""
    rows = active(log, spec.keys).filter(predicate)
    return rows.select(
        F.lit("d").alias("op"),
        image(spec, rows).alias("before"),
        _no_image(spec).alias("after"),
        _millis(at).alias("ts_ms"),
        *_next_place(log),
    )


def update_where(
    log: DataFrame,
    spec: TableSpec,
    predicate: str | SqlColumn,
    assignments: dict[str, SqlColumn],
    at: datetime | SqlColumn,
) -> DataFrame:
    """UPDATE ... SET ... WHERE: an update for each active row that matches.

    Changing a source key column deletes the row under its old key and creates it under
    the new one.
    """
    rows = active(log, spec.keys).filter(predicate)
    before, after = image(spec, rows), image(spec, rows, **assignments)
    if not set(assignments) & set(spec.source_pk):
        return rows.select(
            F.lit("u").alias("op"),
            before.alias("before"),
            after.alias("after"),
            _millis(at).alias("ts_ms"),
            *_next_place(log),
        )

    def step(op: str, old: SqlColumn, new: SqlColumn) -> SqlColumn:
        return F.struct(F.lit(op).alias("op"), old.alias("before"), new.alias("after"))

    moved = F.array(step("d", before, _no_image(spec)), step("c", _no_image(spec), after))
    return rows.select(F.inline(moved), _millis(at).alias("ts_ms"), *_next_place(log))
