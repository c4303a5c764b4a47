"""Joins of big tables to key lists when one key may hold a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SALTS = 16


def salted(rows: DataFrame, by: Sequence[str], salts: int = SALTS) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))


def copied(lookup: DataFrame, salts: int = SALTS) -> DataFrame:
    return lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def spread_join(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str, by: Sequence[str], salts: int = SALTS
) -> DataFrame:
    """Join ``rows`` to a ``lookup`` that has one row per key.

    The rows of a key are dealt over ``salts`` groups by the columns ``by``, and the
    lookup is copied to each group. The salt also keeps both sides of the join on
    exchanges of their own, which lets adaptive execution split what is still too big,
    or broadcast the lookup once its size is measured. The result does not depend on it.
    """
    return salted(rows, by, salts).join(copied(lookup, salts), [*keys, "_salt"], how).drop("_salt")
