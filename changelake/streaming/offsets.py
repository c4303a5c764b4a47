"""Which offsets were seen: intervals per topic and partition, in place of a list of every id.

Offsets are kept in chunks of 65,536: a row per chunk that was ever touched, with the intervals seen in it. A message is known
if its chunk's intervals hold its offset. Chunks are independent of each other, so a topic partition that delivers a third of all messages
is dealt over as many tasks as its offsets fill chunks, and a chunk with everything seen is one interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_BITS = 16
SPANS = "spans array<struct<lo:bigint,hi:bigint>>"


def chunk_of(offset: str | Column) -> Column:
    return F.shiftright(offset, CHUNK_BITS)


def _islands(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """The ``by`` columns, lo, hi: intervals that touch or overlap made one. A window holds one row for each interval of a group."""
    before = Window.partitionBy(*by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(F.max("hi").over(before) + 1 >= F.col("lo"), 0).otherwise(1)
    numbered = spans.withColumn("_new", starts).withColumn("_island", F.sum("_new").over(upto))
    return numbered.groupBy(*by, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def _chunks(spans: DataFrame, source: Sequence[str]) -> DataFrame:
    by = [*source, "chunk"]
    return _islands(spans, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def seen(ids: DataFrame, source: Sequence[str], offset: str) -> DataFrame:
    """Chunks of some ids: the source columns, chunk, spans (disjoint, ascending, never adjacent). Repeated and null offsets do no harm."""
    plain = ids.where(F.col(offset).isNotNull()).select(*source, chunk_of(offset).alias("chunk"), F.col(offset).cast("bigint").alias("lo"))
    return _chunks(plain.distinct().withColumn("hi", F.col("lo")), source)  # 65,536 rows a chunk at most


def new_ids(batch: DataFrame, known: DataFrame, source: Sequence[str], offset: str) -> DataFrame:
    """Rows of ``batch`` whose offset is in none of the known intervals. Rows without an offset are kept.

    Rows and intervals of a chunk are put in one order, in which the end of the last interval is carried to the rows behind it. So the
    work is that of a sort, however many intervals a chunk has; testing each row against all of them would be their product.
    """
    none = lambda t: F.lit(None).cast(t)
    # no column of the batch can clash with these names but one of the source
    packed = batch.select(*source, chunk_of(offset).alias("_chunk"), F.col(offset).cast("bigint").alias("_lo"), none("bigint").alias("_hi"), F.struct(*[F.col(f"`{c}`") for c in batch.columns]).alias("_row"))
    rows = packed.where("_lo is not null")
    spans = known.select(*source, F.col("chunk").alias("_chunk"), F.inline("spans").alias("_lo", "_hi")).withColumn("_row", none(packed.schema["_row"].dataType))
    upto = Window.partitionBy(*source, "_chunk").orderBy("_lo", F.col("_hi").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    new = rows.unionByName(spans).withColumn("_end", F.max("_hi").over(upto)).where("_row is not null and (_end is null or _end < _lo)")
    return new.select("_row.*").unionByName(batch.where(F.col(offset).isNull()))


def merged(known: DataFrame, more: DataFrame, source: Sequence[str]) -> DataFrame:
    """The chunks of both."""
    flat = [side.select(*source, "chunk", F.inline("spans")) for side in (known, more)]
    return _chunks(flat[0].unionByName(flat[1]), source)


def intervals(known: DataFrame, source: Sequence[str]) -> DataFrame:
    """The source columns, lo, hi: intervals joined over the edges of chunks too, for reports on gaps.

    Only intervals that reach an edge are linked, over a window of a source's chunks with one row for each.
    """
    size = 1 << CHUNK_BITS
    flat = known.select(*source, "chunk", F.inline("spans"))
    inner = flat.where((F.col("lo") % size != 0) & ((F.col("hi") + 1) % size != 0)).select(*source, "lo", "hi")
    edge = flat.where((F.col("lo") % size == 0) | ((F.col("hi") + 1) % size == 0))
    return inner.unionByName(_islands(edge.select(*source, "lo", "hi"), source))
