"""Tab-separated bulk files with one header row and a null marker, plain or gzip."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column as SqlColumn, DataFrame, SparkSession, Window, functions as F, types as T

from changelake.functions import escape_text, escaped_marks_to_letters, join_list, null_if, unescape_text
from changelake.operators.ranks import ranked
from changelake.operators.reconcile import random_keys
from changelake.specs import TableSpec

NULL_MARKER = "\\N"
# Fixed value: rows of a load chunk.
CHUNK_ROWS = 5_000_000
# Fixed value: columns whose blanks read as null.
BLANK_IS_NULL = {"title_akas": ("isOriginalTitle",)}


def _lines(spark: SparkSession, path: str | Sequence[str], header: bool) -> DataFrame:
    """Whole lines, minus the first one of each file.

    The CSV reader is used with a separator that cannot occur, because it alone knows
    where a file starts when big files are read in splits.
    """
    reader = spark.read.schema("line string").option("sep", "\u0001").option("quote", "").option("lineSep", "\n")
    return reader.option("header", str(header).lower()).option("enforceSchema", "true").csv(path)


def _records(spark: SparkSession, path: str | Sequence[str], header: bool) -> DataFrame:
    """Records that may run over lines: a line that ends in an odd number of backslashes goes on in the next one.

    A segmented scan: lines are ordered within the file's splits, which have a bounded size, and what leads from one split to the
    next goes through a table with one row per split. A record of any number of lines, over any number of splits, is put
    together under the place of its first line. Blank lines are records. A file that ends in an open line ends that record, whose last backslash stays.
    """
    split = ["_file", "_block"]
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("_line"),
    )
    within = Window.partitionBy(*split).orderBy("_at")
    lines = lines.withColumn("_open", F.length(F.regexp_extract("_line", r"(\\*)$", 1)) % 2 == 1)
    # the first line of a split has none before it here
    lines = lines.withColumn("_starts", F.when(~F.lag("_open").over(within), F.col("_at")))
    lines = lines.withColumn("_inner", F.last("_starts", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))

    splits = lines.groupBy(*split).agg(F.min("_at").alias("_first"), F.max_by("_open", "_at").alias("_last_open"), F.max("_starts").alias("_last_start"))
    across = Window.partitionBy("_file").orderBy("_block")
    splits = splits.withColumn("_own", F.when(~F.coalesce(F.lag("_last_open").over(across), F.lit(False)), F.col("_first")))
    earlier = F.last(F.coalesce("_last_start", "_own"), ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    first_of_file = F.col("_first") == F.first("_first").over(across)
    splits = splits.select(*split, F.coalesce("_own", earlier).alias("_from"), F.when(first_of_file, F.col("_first")).alias("_header"))

    placed = lines.join(splits, split).withColumn("_record", F.coalesce("_inner", "_from"))
    if header:
        placed = placed.filter(~F.col("_record").eqNullSafe(F.col("_header")))
    parts = F.array_sort(F.collect_list(F.struct("_block", "_at", "_line")))
    whole = F.array_join(F.transform(parts, lambda p: p["_line"]), "\n")
    return placed.groupBy("_record").agg(whole.alias("_whole")).select(escaped_marks_to_letters("_whole").alias("line"))


def read_tsv(
    spark: SparkSession,
    path: str | Sequence[str],
    spec: TableSpec,
    header: bool = True,
    null_marker: str = NULL_MARKER,
    unescape: bool = False,
    blank_is_null: Iterable[str] | None = None,
    records: bool = False,
) -> DataFrame:
    """Source rows of ``spec``: list columns stay comma-joined text.

    The marker reads as null, a blank stays blank, and a number that does not parse
    reads as null. ``blank_is_null`` names columns where a blank is null too. ``records`` reads cells whose tabs and
    line feeds are escaped by a backslash, in letters or as they are, and undoes all escapes; blank lines count.
    """
    if blank_is_null is None:
        blank_is_null = BLANK_IS_NULL.get(spec.name, ())
    lines = _records(spark, path, header) if records else _lines(spark, path, header)
    unescape = unescape or records
    cells = F.split("line", "\t", -1)
    out = []
    for i, column in enumerate(spec.columns):
        value = null_if(F.try_element_at(cells, F.lit(i + 1)), null_marker)
        if unescape:
            value = unescape_text(value)
        if column.name in blank_is_null:
            value = null_if(value, "")
        if not isinstance(column.json_type, T.StringType):
            value = value.try_cast(column.json_type)
        out.append(value.alias(column.name))
    return lines.select(*out)


def file_name(spec: TableSpec, gzip: bool = False) -> str:
    """``title_ratings`` is delivered as ``title.ratings.tsv`` or ``title.ratings.tsv.gz``."""
    return spec.name.replace("_", ".") + ".tsv" + (".gz" if gzip else "")


def read_tables(spark: SparkSession, folder: str, specs: dict[str, TableSpec], gzip: bool = False) -> dict[str, DataFrame]:
    return {name: read_tsv(spark, f"{folder}/{file_name(spec, gzip)}", spec) for name, spec in specs.items()}


def read_tsv_fast(spark: SparkSession, path: str | Sequence[str], spec: TableSpec, null_marker: str = NULL_MARKER) -> DataFrame:
    """Straight CSV read, for files without blanks: here a blank reads as null like the marker."""
    reader = spark.read.schema(spec.row_schema).option("sep", "\t").option("header", "true").option("quote", "")
    return reader.option("nullValue", null_marker).csv(path)


def write_tsv(
    rows: DataFrame, path: str, null_marker: str = NULL_MARKER, rows_per_file: int | None = None, gzip: bool = False, escape: str | None = None
) -> None:
    """Tab-separated text with a header in every file; lists are joined by commas.

    Lines are built as text, so a blank and a null stay apart. ``escape="letters"`` writes backslashes, tabs, line feeds and the like
    as escapes, so that ``read_tsv(..., records=True)`` gives every cell back. ``escape="marks"`` leaves tabs and line feeds
    behind a backslash, as database exports do, and writes no header.
    """
    if escape not in (None, "letters", "marks"):
        raise ValueError(f"unknown escape {escape!r}")
    cells: list[SqlColumn] = []
    for name, kind in rows.dtypes:
        value = join_list(name) if kind.startswith("array") else F.col(name).cast("string")
        if escape:
            value = escape_text(value, marks=escape == "marks")
        cells.append(F.coalesce(value, F.lit(null_marker)))
    header = "\t".join(rows.columns)
    lines = rows.select(F.concat_ws("\t", *cells).alias(header))
    if escape == "marks":
        limit = {"maxRecordsPerFile": rows_per_file} if rows_per_file else {}
        lines.write.mode("overwrite").options(**limit).text(path, compression="gzip" if gzip else None)
        return
    writer = lines.write.mode("overwrite").option("sep", "\u0001").option("header", "true")
    writer = writer.option("quote", "").option("emptyValue", "").option("escape", "")
    writer = writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def first_rows(rows: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """A sample of ``n`` rows: any ``n``, or with ``keys`` the first ``n`` in key order.

    With keys, rows are ranked over range partitions, so ``n`` may be any number and its rows meet nowhere.
    """
    if not keys:
        return rows.limit(n)
    ranks = ranked(rows, keys, name="_place")
    return ranks.where(F.col("_place") < n).drop("_place")


def stable_sample(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The same ``n`` pseudo-random rows on every run; adaptive execution broadcasts the keys if they turn out to be few."""
    if n <= 0:
        raise ValueError("sample size must be positive")
    return rows.join(random_keys(rows, keys, n), list(keys), "left_semi")


def chunk_plan(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks a load is cut into: number, rows already loaded before it, percent done."""
    size = F.lit(chunk_rows).cast("bigint")
    total = rows.agg(F.count("*").alias("total_rows"))
    chunks = F.call_function("div", F.col("total_rows") + size - 1, size)
    numbers = F.when(chunks > 0, F.sequence(F.lit(1).cast("bigint"), chunks)).otherwise(F.array().cast("array<bigint>"))
    before = (F.col("chunk") - 1) * size
    return total.select("total_rows", F.explode(numbers).alias("chunk")).select(
        "chunk",
        before.alias("rows_before"),
        F.call_function("div", before * 100, F.col("total_rows")).alias("percent"),
        "total_rows",
    )


def write_chunks(rows: DataFrame, path: str, chunk_rows: int = CHUNK_ROWS) -> None:
    """Files of at most ``chunk_rows`` rows, to be loaded a few at a time."""
    rows.write.mode("errorifexists").option("maxRecordsPerFile", chunk_rows).parquet(path)


def not_yet_loaded(targets: dict[str, DataFrame]) -> list[str]:
    """Tables without rows. One limit-1 probe per table."""
    return [name for name, rows in targets.items() if rows.isEmpty()]
