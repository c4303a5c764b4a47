"""Source against replica by checksums: what is equal is never joined.

Rows are hashed and the hashes added up per range of the key, at several depths. Two such trees are compared from the top: only the
children of ranges that differ are looked at, and only rows of differing leaf ranges are joined field by field. A tree is
small and can be kept or sent where the rows cannot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from changelake.functions import join_list
from changelake.operators.audit import union_all
from changelake.operators.reconcile import field_check, field_summary
from changelake.session import written
from changelake.specs import TableSpec

#: A leaf range holds 2 ** 12 neighbouring whole-number keys (or hashes, see ``key_code``), and a range has 2 ** 4 children.
LEAF_BITS, FAN_BITS, DEPTHS = 12, 4, 6
#: Ranges that are written into a scan's filter at most; more of them are named by their common ancestors.
MOST_RANGES = 256


def key_code(rows: DataFrame, keys: Sequence[str]) -> Column:
    """Whole number that puts keys in ranges: the first key itself if it is a whole number, so that ranges are neighbours in
    the files too; else a hash of all keys, cut to as many values as fill the leaf ranges evenly."""
    if isinstance(rows.schema[keys[0]].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.col(keys[0]).cast("bigint")
    return F.shiftrightunsigned(F.xxhash64(*[F.col(k).cast("string") for k in keys]), 64 - LEAF_BITS - DEPTHS * FAN_BITS)


def row_hash(rows: DataFrame, spec: TableSpec, fields: Sequence[str]) -> Column:
    """Hash of keys and fields such that rows with equal hashes match field by field (but for chance).

    Lists hash as their joined text, numbers with a fraction as hundredths, so that a source and a replica that store them in
    different types agree. Numbers that match only within the tolerance may differ here; then their range is joined.
    """
    types = dict(rows.dtypes)

    def cell(name: str) -> Column:
        if types[name].startswith("array"):
            value = join_list(name)
        elif spec.column(name).kind in ("float32", "float64", "decimal3_1"):
            value = F.round(F.col(name).cast("double"), 2) + F.lit(0.0)
        else:
            value = F.col(name)
        return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))

    return F.xxhash64(*[cell(n) for n in [*spec.source_pk, *fields]])


def leaf_digests(rows: DataFrame, spec: TableSpec, fields: Sequence[str] | None = None) -> DataFrame:
    """leaf, rows, total and mixed (sum and xor of row hashes) per leaf range; combined in every task before the shuffle.

    Only keys and ``fields`` (all others by default) are read. Rows with a null first key form a range of their own.
    """
    fields = list(fields or [n for n in spec.names if n not in spec.source_pk])
    coded = rows.select(F.shiftright(key_code(rows, spec.source_pk), LEAF_BITS).alias("leaf"), row_hash(rows, spec, fields).alias("_h"))
    total = F.sum(F.col("_h").cast("decimal(20,0)")).cast("decimal(38,0)")
    return coded.groupBy("leaf").agg(F.count("*").alias("rows"), total.alias("total"), F.bit_xor("_h").alias("mixed"))


def checksum_tree(rows: DataFrame, spec: TableSpec, fields: Sequence[str] | None = None) -> DataFrame:
    """depth, range, rows, total, mixed: the digests of all depths. Depth 0 are the widest ranges; a range's children lie 16 to one."""
    leaves = written(leaf_digests(rows, spec, fields), "digests")
    levels = []
    for depth in range(DEPTHS + 1):
        shift = FAN_BITS * (DEPTHS - depth)
        level = leaves.groupBy(F.shiftright("leaf", shift).alias("range")).agg(
            F.sum("rows").alias("rows"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("mixed").alias("mixed")
        )
        levels.append(level.select(F.lit(depth).alias("depth"), "range", "rows", "total", "mixed"))
    return union_all(levels)


def differing_ranges(source: DataFrame, target: DataFrame) -> DataFrame:
    """depth, range, source_rows, target_rows: ranges of two trees that differ, found from the top down.

    Each depth joins only the children of ranges found above it; a range that one side lacks differs.
    """
    same = F.col("s.rows").eqNullSafe(F.col("t.rows")) & F.col("s.total").eqNullSafe(F.col("t.total")) & F.col("s.mixed").eqNullSafe(F.col("t.mixed"))
    found: list[DataFrame] = []
    for depth in range(DEPTHS + 1):
        sides = [side.where(F.col("depth") == depth) for side in (source, target)]
        if found:
            above = found[-1].select(F.col("range").alias("above"))
            sides = [s.join(above, F.shiftright("range", FAN_BITS).eqNullSafe(F.col("above")), "left_semi") for s in sides]
        s, t = (side.alias(mark) for side, mark in zip(sides, "st"))
        both = s.join(t, F.col("s.range").eqNullSafe(F.col("t.range")), "full_outer").where(~same)
        level = both.select(
            F.lit(depth).alias("depth"), F.coalesce("s.range", "t.range").alias("range"),
            F.coalesce("s.rows", F.lit(0)).alias("source_rows"), F.coalesce("t.rows", F.lit(0)).alias("target_rows"),
        )
        found.append(written(level, "differing"))
    return union_all(found)


def rows_of_ranges(rows: DataFrame, spec: TableSpec, differing: DataFrame) -> DataFrame:
    """Rows of the differing leaf ranges: a join with the list of leaves, above a filter on the key that reaches the file scan.

    The filter names the ranges of the deepest depth where there are no more than 256 of them; there is always such a depth
    or none is needed, as the join is exact by itself.
    """
    counts = {r["depth"]: r["n"] for r in differing.groupBy("depth").agg(F.count("*").alias("n")).collect()}  # a row for each depth
    few = [d for d, n in counts.items() if n <= MOST_RANGES]
    code = key_code(rows, spec.source_pk)
    leaves = differing.where(F.col("depth") == DEPTHS).select(F.col("range").alias("_leaf"))
    kept = rows
    if few:
        depth = max(few)
        size = LEAF_BITS + FAN_BITS * (DEPTHS - depth)
        condition = F.lit(False)
        for r in sorted(differing.where(F.col("depth") == depth).select("range").collect(), key=lambda r: (r[0] is not None, r[0] or 0)):
            inside = code.isNull() if r["range"] is None else (code >= r["range"] << size) & (code < (r["range"] + 1) << size)
            condition = condition | inside
        kept = rows.where(condition)
    return kept.join(leaves, F.shiftright(key_code(kept, spec.source_pk), LEAF_BITS).eqNullSafe(F.col("_leaf")), "left_semi")


def _suspects(source: DataFrame, target: DataFrame, spec: TableSpec, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    differing = differing_ranges(*[checksum_tree(side, spec, fields) for side in (source, target)])
    return rows_of_ranges(source, spec, differing), rows_of_ranges(target, spec, differing)


def field_failures(source: DataFrame, target: DataFrame, spec: TableSpec, fields: Sequence[str] | None = None) -> DataFrame:
    """What ``field_check(..., only_failures=True)`` gives, joining only rows of ranges whose checksums differ."""
    fields = list(fields or [n for n in spec.names if n not in spec.source_pk])
    return field_check(*_suspects(source, target, spec, fields), spec, fields, only_failures=True)


def summary(source: DataFrame, target: DataFrame, spec: TableSpec, fields: Sequence[str] | None = None) -> DataFrame:
    """What ``field_summary`` gives: keys of equal ranges pass in every field without being joined."""
    fields = list(fields or [n for n in spec.names if n not in spec.source_pk])
    trees = [checksum_tree(side, spec, fields) for side in (source, target)]
    differing = differing_ranges(*trees)
    joined = field_summary(rows_of_ranges(source, spec, differing), rows_of_ranges(target, spec, differing), spec, fields)
    leaf = F.col("depth") == DEPTHS
    rows = [trees[0].where(leaf).select(F.col("rows").alias("n")), differing.where(leaf).select((-F.col("source_rows")).alias("n"))]
    equal = union_all(rows).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    return joined.select("field", (F.col("passed") + equal).alias("passed"), "failed")
