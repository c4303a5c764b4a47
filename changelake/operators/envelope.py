"""Change envelopes ``{op, before, after, ts_ms}``: parse, resolve to log rows, write back as JSON."""

from __future__ import annotations

from pyspark.sql import Column as SqlColumn, DataFrame, functions as F, types as T

from changelake.functions import empty_list, narrow, split_list, time_in_range, version_time, yyyymm
from changelake.specs import Column, TableSpec

# Operations accepted by the two decoders.
FULL_OPS = ("c", "u", "r", "d")
LEGACY_OPS = ("c", "u", "r")

ENVELOPE_COLUMNS = ("op", "before", "after", "ts_ms")
TRANSPORT_COLUMNS = ("topic", "partition", "offset")


def parse_messages(
    messages: DataFrame,
    spec: TableSpec,
    message: str = "value",
    keep_message: bool = False,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Add the four envelope columns in place of the JSON text column.

    Null messages (the marker a broker keeps after a delete) and broken JSON both give a
    null ``op``; ``resolve`` drops them and ``rejects`` reports them.

    The text is parsed in a generator with one output row. A plain projection would be
    copied into every filter above it and parse each message once per use.
    """
    keep = [c for c in messages.columns if c != message or keep_message]
    envelope = F.from_json(F.col(message).cast("string"), schema or spec.envelope_schema)
    return messages.select(*keep, F.inline(F.array(envelope)).alias(*ENVELOPE_COLUMNS))


def _blank(column: Column, null_policy: str) -> SqlColumn:
    if column.kind == "list":
        return empty_list()
    value = F.lit(None) if null_policy == "keep" else F.lit(column.default)
    return value.cast(column.stored_type)


def _stored(column: Column, image: SqlColumn, null_policy: str, overflow: str, empty: str) -> SqlColumn:
    """Value of one column as it is stored, from its value in the row image."""
    if column.kind == "list":
        return split_list(image if null_policy == "keep" else F.coalesce(image, F.lit("")), empty)
    if column.modulus is not None and overflow == "wrap":
        # A negative number is not an unsigned one: it reads as missing.
        image = F.when(image >= 0, image)
    value = narrow(image, column.modulus, column.stored_type, overflow)
    if null_policy == "keep":
        return value
    return F.coalesce(value, F.lit(column.default).cast(column.stored_type))


def _key_present(column: Column, image: SqlColumn) -> SqlColumn:
    return F.octet_length(image) > 0 if column.kind == "string" else image.isNotNull()


def resolve(
    envelopes: DataFrame,
    spec: TableSpec,
    deletes: bool = True,
    null_policy: str = "default",
    overflow: str = "wrap",
    empty_lists: str = "one_blank",
    version_precision: str = "s",
) -> DataFrame:
    """Envelope columns to changelog rows.

    With ``deletes`` a delete keeps its keys from the before image, blanks the other
    columns and sets ``is_deleted``. A commit time outside the years 1 to 9999 is no version: such messages are
    dropped and reported by ``rejects``. Without it, deletes are dropped and there is no
    ``is_deleted`` column. Only the first key column has to be non-empty.
    """
    if null_policy not in ("default", "keep"):
        raise ValueError(f"unknown null policy {null_policy!r}")
    op = F.col("op")
    is_delete = op == "d"

    def after(name: str) -> SqlColumn:
        return F.col(f"after.{name}")

    def applies(name: str) -> SqlColumn:
        return F.when(is_delete, F.col(f"before.{name}")).otherwise(after(name)) if deletes else after(name)

    first_key = spec.column(spec.keys[0])
    kept = envelopes.filter(op.isin(*(FULL_OPS if deletes else LEGACY_OPS))).filter(
        _key_present(first_key, applies(first_key.name)) & time_in_range("ts_ms")
    )

    own = []
    for column in spec.columns:
        if column.name in spec.keys:
            value = _stored(column, applies(column.name), "default", overflow, empty_lists)
        else:
            value = _stored(column, after(column.name), null_policy, overflow, empty_lists)
            if deletes:
                value = F.when(is_delete, _blank(column, null_policy)).otherwise(value)
        own.append(value.alias(column.name))

    version = version_time(F.col("ts_ms"), version_precision)
    log = [op.alias("cdc_operation"), version.alias("cdc_timestamp")]
    if deletes:
        log.append(is_delete.cast("smallint").alias("is_deleted"))
    log.append(F.current_timestamp().alias("processing_time"))
    log += [F.col(c) for c in TRANSPORT_COLUMNS if c in envelopes.columns]
    log.append(yyyymm(version).alias("yyyymm"))
    return kept.select(*own, *log)


def decode(messages: DataFrame, spec: TableSpec, message: str = "value", **policies) -> DataFrame:
    """Raw JSON messages to changelog rows, see ``resolve`` for the policies."""
    return resolve(parse_messages(messages, spec, message, schema=spec.decode_schema), spec, **policies)


def decode_legacy(messages: DataFrame, spec: TableSpec, message: str = "value", **policies) -> DataFrame:
    """Inserts and updates only: what an append-only table is fed with."""
    return decode(messages, spec, message, deletes=False, **policies)


def rejects(messages: DataFrame, spec: TableSpec, message: str = "value") -> DataFrame:
    """The messages ``decode`` drops, whole, each with a reason."""
    op = F.col("op")
    key = spec.column(spec.keys[0])
    image = F.when(op == "d", F.col(f"before.{key.name}")).otherwise(F.col(f"after.{key.name}"))
    reason = (
        F.when(F.col(message).isNull(), "null message")
        .when(op.isNull(), "malformed")
        .when(~op.isin(*FULL_OPS), "unknown operation")
        .when(~F.coalesce(_key_present(key, image), F.lit(False)), "blank key")
        .when(~time_in_range("ts_ms"), "bad time")
    )
    parsed = parse_messages(messages, spec, message, keep_message=True, schema=spec.decode_schema)
    return parsed.select(*messages.columns, reason.alias("reason")).filter("reason IS NOT NULL")


def encode(envelopes: DataFrame, spec: TableSpec, message: str = "value") -> DataFrame:
    """Envelope columns to JSON text, nulls written out, for producing messages."""
    keep = [c for c in envelopes.columns if c not in ENVELOPE_COLUMNS]
    envelope = F.struct(*ENVELOPE_COLUMNS).cast(spec.envelope_schema)
    return envelopes.select(*keep, F.to_json(envelope, {"ignoreNullFields": "false"}).alias(message))
