"""Registry of queries and the output form shared with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from changelake.session import scratch_dir, use_utc


@dataclass(frozen=True)
class Query:
    run: Callable[["Tables"], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


class Tables:
    """Reads the given tables on first use: ``t("orders")`` or ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = use_utc(spark)
        self.sf_dir = sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self(name)

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def scratch(self, name: str) -> str:
        return scratch_dir(self.spark, name)


# A table of fewer splits than this is small: at 128 MB a split it has less than 8 GB.
FEW_SPLITS = 64


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Give every core some rows of a small input that comes in fewer splits than there are cores.

    For costly row-wise work or sorting. ``by`` names columns that tell rows apart, all by
    default. A table with many splits is never shuffled for this.
    """
    if rows.isStreaming:
        return rows
    cores = min(rows.sparkSession.sparkContext.defaultParallelism, FEW_SPLITS)
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, *(by or rows.columns))


def register(name: str, sql: str | None = None):
    """Decorator. ``sql`` is the DuckDB statement with the same result, if there is one."""

    def add(run: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return add


def plain(frame: DataFrame) -> DataFrame:
    """Small integers as int, floats as double, timestamps without zone, lists as text and size."""
    out = []
    for f in frame.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ShortType, T.ByteType)):
            out.append(c.cast("int").alias(f.name))
        elif isinstance(f.dataType, T.FloatType):
            out.append(F.round(c.cast("double"), 4).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            out.append(c.cast("timestamp_ntz").alias(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            out.append(F.array_join(c, ",").alias(f.name))
            out.append(F.size(c).cast("bigint").alias(f"{f.name}_size"))
        else:
            out.append(c)
    return frame.select(*out)


def as_doubles(frame: DataFrame, *names: str) -> DataFrame:
    """Whole numbers that may be null, as doubles: readers agree on the nulls of those."""
    return frame.withColumns({n: F.col(n).cast("double") for n in names})


def execute(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(REGISTRY[name].run(Tables(spark, sf_dir)))
