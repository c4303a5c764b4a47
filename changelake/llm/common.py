"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

import changelake
from changelake.session import scratch_dir

#: Hadoop's setting for the empty file that marks a finished write. Where its native library is missing, the driver starts a
#: process for that file and one for its checksum.
NO_MARK = "mapreduce.fileoutputcommitter.marksuccessfuljobs"

def stored(frame: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a frame under the cluster's shared checkpoint folder and read it back.

    Cuts the lineage like checkpoint(), in columns, so that lost executors repeat no earlier step and a later
    join sees measured sizes and can split a hot key. Nobody waits for the mark of a finished write, so none is made.
    """
    path = scratch_dir(frame.sparkSession, name)
    frame.write.option(NO_MARK, "false").parquet(path, compression=codec)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def narrowed(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names the operator uses; others may clash with those."""
    return docs.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """Whole rows in one column, `row`, beside the named ones: no name of a given column can clash with those."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[value.alias(name) for name, value in columns.items()])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def give_back() -> None:
    """Return memory that was freed but kept, by Arrow and by the C library, of which NumPy's arrays are; other C libraries keep theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_SHIPPED: set[str] = set()


def arrow_map(frame: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInArrow, after making this package importable on the executors (once per application).

    A Python worker stays for later tasks, so what has been kept of a task's memory goes back at its end.
    """

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    context = frame.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(changelake.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="changelake-code-")) / "changelake-code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))  # the driver's file server hands it to every executor, also to later ones
        _SHIPPED.add(context.applicationId)
    return frame.mapInArrow(released, schema)
