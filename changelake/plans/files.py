"""Queries that write files in the scratch folder and read them back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F, types as T

from changelake.operators.audit import storage_stats, table_counts
from changelake.operators.changes import snapshot_to_changes
from changelake.operators.envelope import resolve
from changelake.operators.reconcile import clean_check
from changelake.operators.versions import active, latest
from changelake.plans import fixtures as fx
from changelake.plans.registry import Tables, as_doubles, register
from changelake.sources import changelog, tsv
from changelake.specs import table
from changelake.streaming.ingest import drain, load_chunks

CUSTOMER_OUT = "c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment"


def customer_tsv(t: Tables, **options) -> str:
    path = t.scratch("customer-tsv")
    tsv.write_tsv(t.customer.select(*fx.CUSTOMER.names), path, **options)
    return path


@register("tsv_round_trip", f"SELECT {CUSTOMER_OUT} FROM customer")
def tsv_round_trip(t: Tables) -> DataFrame:
    return tsv.read_tsv(t.spark, customer_tsv(t), fx.CUSTOMER)


@register("tsv_gzip", f"SELECT {CUSTOMER_OUT} FROM customer")
def tsv_gzip(t: Tables) -> DataFrame:
    return tsv.read_tsv(t.spark, customer_tsv(t, gzip=True, rows_per_file=5_000), fx.CUSTOMER)


@register("tsv_fast", f"SELECT {CUSTOMER_OUT} FROM customer")
def tsv_fast(t: Tables) -> DataFrame:
    return tsv.read_tsv_fast(t.spark, customer_tsv(t), fx.CUSTOMER)


SPOILED = table("customer", "c_custkey:int64 c_name:string c_acctbal:float64 c_mktsegment:string c_flag:uint8", keys="c_custkey")


@register(
    "tsv_null_clean",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name,
    CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment,
    CAST(CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_custkey % 3 END AS DOUBLE) AS c_flag FROM customer""",
)
def tsv_null_clean(t: Tables) -> DataFrame:
    """Null markers, blanks and text in a number column; a blank flag reads as null."""
    key = F.col("c_custkey")
    rows = t.customer.select(
        "c_custkey",
        F.when(key % 3 != 0, F.col("c_name")).alias("c_name"),
        F.when(key % 4 != 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("c_acctbal"),
        F.when(key % 5 != 0, F.col("c_mktsegment")).otherwise("").alias("c_mktsegment"),
        F.when(key % 2 != 0, (key % 3).cast("string")).otherwise("").alias("c_flag"),
    )
    path = t.scratch("spoiled-tsv")
    tsv.write_tsv(rows, path)
    return as_doubles(tsv.read_tsv(t.spark, path, SPOILED, blank_is_null=["c_flag"]), "c_flag")


HAS_NULLS = ("numVotes", "endYear", "deathYear")


def _register_title_load(name: str) -> None:
    spec = fx.TITLE_TABLES[name]
    given, select = fx.TITLE_SOURCES[name]
    sql_types = {"string": "VARCHAR", "list": "VARCHAR", "float32": "DOUBLE"}
    with_nulls = [n for n in spec.names if n in HAS_NULLS]
    types = {c.name: "DOUBLE" if c.name in with_nulls else sql_types.get(c.kind, "BIGINT") for c in spec.columns}
    own = ", ".join(f"CAST({n} AS {kind}) AS {n}" for n, kind in types.items())

    @register(f"load_{name}", f"SELECT {own} FROM ({select} FROM {given})")
    def loaded(t: Tables) -> DataFrame:
        """Source rows as a bulk file with null markers, loaded back."""
        path = t.scratch(f"{name}-tsv")
        tsv.write_tsv(t.spark.sql(select + " FROM {src}", src=t(given)).select(*spec.names), path)
        return as_doubles(tsv.read_tsv(t.spark, path, spec), *with_nulls)


for _name in fx.TITLE_TABLES:
    _register_title_load(_name)


@register("bulk_load", f"SELECT {CUSTOMER_OUT}, 'r' AS cdc_operation FROM customer")
def bulk_load(t: Tables) -> DataFrame:
    """Bulk file to snapshot reads to a stored log to active rows."""
    path = t.scratch("bulk-log")
    rows = tsv.read_tsv(t.spark, customer_tsv(t), fx.CUSTOMER)
    changes = snapshot_to_changes(rows, fx.CUSTOMER, datetime(2002, 1, 1)).withColumn("offset", F.lit(0))
    changelog.append_log(resolve(changes, fx.CUSTOMER), path, fx.CUSTOMER)
    log = changelog.read_log(t.spark, path, fx.CUSTOMER)
    return active(log, fx.CUSTOMER.keys).select(*fx.CUSTOMER.names, "cdc_operation")


@register("load_sample", f"SELECT {CUSTOMER_OUT} FROM customer ORDER BY c_custkey LIMIT 1000")
def load_sample(t: Tables) -> DataFrame:
    """First-N load, a report feature of the loader."""
    return tsv.first_rows(tsv.read_tsv(t.spark, customer_tsv(t), fx.CUSTOMER), 1000, ["c_custkey"])


@register(
    "chunk_plan",
    """WITH n AS (SELECT count(*) AS total_rows FROM orders) SELECT c AS chunk, (c - 1) * 4000 AS rows_before,
    CAST(((c - 1) * 4000 * 100) // total_rows AS BIGINT) AS percent, total_rows
    FROM n, LATERAL (SELECT unnest(generate_series(1, (total_rows + 3999) // 4000)) AS c)""",
)
def chunk_plan(t: Tables) -> DataFrame:
    return tsv.chunk_plan(t.orders, 4000)


@register("chunked_load", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def chunked_load(t: Tables) -> DataFrame:
    """Rows written as chunks of bounded size, loaded chunk by chunk by a stream."""
    root = t.scratch("chunked")
    tsv.write_chunks(t.orders.select(*fx.ORDERS.names), f"{root}/chunks", 50_000)
    query = load_chunks(t.spark, f"{root}/chunks", fx.ORDERS.row_schema, f"{root}/loaded", f"{root}/checkpoint", at_once=16)
    drain(query)
    loaded = t.spark.read.schema(fx.ORDERS.row_schema).parquet(f"{root}/loaded")
    return loaded.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@register(
    "load_missing",
    "SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier",
)
def load_missing(t: Tables) -> DataFrame:
    """Of two targets one is loaded already; only the other is."""
    root = t.scratch("missing")
    source = {"customer": t.customer, "supplier": t.supplier}
    t.supplier.write.parquet(f"{root}/supplier")
    changelog.reset(t.spark, f"{root}/customer", t.customer.schema)

    def stored(name: str) -> DataFrame:
        return t.spark.read.schema(source[name].schema).parquet(f"{root}/{name}")

    for name in tsv.not_yet_loaded({name: stored(name) for name in source}):
        source[name].write.mode("append").parquet(f"{root}/{name}")
    return table_counts({name: stored(name) for name in source}, total=None)


def stored_log(t: Tables) -> str:
    path = t.scratch("log")
    changelog.append_log(fx.lineitem_log(t), path, fx.LINEITEM)
    return path


@register(
    "log_layout",
    fx.LINEITEM_CL + "SELECT yyyymm, count(*) AS n, CAST(sum(is_deleted) AS BIGINT) AS deletes FROM cl GROUP BY yyyymm",
)
def log_layout(t: Tables) -> DataFrame:
    """Written by month and key range, counted by month folder."""
    log = changelog.read_log(t.spark, stored_log(t), fx.LINEITEM)
    return log.groupBy("yyyymm").agg(F.count("*").alias("n"), F.sum("is_deleted").alias("deletes"))


@register("log_month_pruned", fx.LINEITEM_CL + "SELECT yyyymm, op AS cdc_operation, count(*) AS n FROM cl WHERE yyyymm BETWEEN 199801 AND 199812 GROUP BY ALL")
def log_month_pruned(t: Tables) -> DataFrame:
    """All versions of one year: month folders outside it are not read."""
    log = changelog.read_log(t.spark, stored_log(t), fx.LINEITEM).filter("yyyymm BETWEEN 199801 AND 199812")
    return log.groupBy("yyyymm", "cdc_operation").agg(F.count("*").alias("n"))


@register(
    "stored_log_active",
    fx.LINEITEM_CL + "SELECT l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM latest WHERE is_deleted = 0 GROUP BY 1",
)
def stored_log_active(t: Tables) -> DataFrame:
    log = changelog.read_log(t.spark, stored_log(t), fx.LINEITEM)
    rows = active(log, fx.LINEITEM.keys)
    return rows.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register(
    "storage_rows",
    fx.LINEITEM_CL + 'SELECT yyyymm, count(*) AS "rows" FROM cl GROUP BY yyyymm',
)
def storage_rows(t: Tables) -> DataFrame:
    """The part of ``storage_stats`` that SQL can say: rows per month, counted per file first."""
    return storage_stats(t.spark.read.schema(fx.LINEITEM.log_schema).parquet(stored_log(t)), ["yyyymm"]).select("yyyymm", "rows")


@register("storage_stats")
def stats(t: Tables) -> DataFrame:
    """Rows, files and bytes per month. No SQL twin: file sizes are Spark's own."""
    return storage_stats(t.spark.read.schema(fx.LINEITEM.log_schema).parquet(stored_log(t)), ["yyyymm"])


@register("backup_restore", "SELECT " + CUSTOMER_OUT + " FROM customer")
def backup_restore(t: Tables) -> DataFrame:
    """Backup, reset, restore by name."""
    root = t.scratch("backup")
    rows = t.customer.select(*fx.CUSTOMER.names)
    rows.write.parquet(f"{root}/live")
    changelog.backup(t.spark.read.schema(rows.schema).parquet(f"{root}/live"), f"{root}/backup")
    changelog.reset(t.spark, f"{root}/live", rows.schema)
    saved = t.spark.read.schema(rows.schema).parquet(f"{root}/backup")
    changelog.with_new_columns(saved, fx.CUSTOMER.row_schema, {}).write.mode("append").parquet(f"{root}/live")
    return t.spark.read.schema(fx.CUSTOMER.row_schema).parquet(f"{root}/live")


@register(
    "reset_tables",
    """WITH c AS (SELECT 'customer' AS table_name, CAST(0 AS BIGINT) AS source_count, CAST(0 AS BIGINT) AS target_count
    UNION ALL SELECT 'orders', count(*), 0 FROM orders)
    SELECT *, source_count = 0 AND target_count = 0 AS clean FROM c
    UNION ALL SELECT 'TOTAL', CAST(sum(source_count) AS BIGINT), CAST(sum(target_count) AS BIGINT), sum(source_count) = 0 FROM c""",
)
def reset_tables(t: Tables) -> DataFrame:
    """Sources and targets of two tables; one source is not reset."""
    root = t.scratch("reset")
    frames = {"customer": t.customer, "orders": t.orders}
    for side in ("source", "target"):
        for name, rows in frames.items():
            rows.write.parquet(f"{root}/{side}/{name}")
            if (side, name) != ("source", "orders"):
                changelog.reset(t.spark, f"{root}/{side}/{name}", rows.schema)

    def stored(side: str) -> dict[str, DataFrame]:
        return {n: t.spark.read.schema(f.schema).parquet(f"{root}/{side}/{n}") for n, f in frames.items()}

    return clean_check(stored("source"), stored("target"))


_AS_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in ("n_nationkey", "n_name", "n_regionkey")])


@register(
    "text_output",
    "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation",
)
def text_output(t: Tables) -> DataFrame:
    path = t.scratch("text")
    tsv.write_tsv(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path)
    return t.spark.read.schema(_AS_TEXT).option("sep", "\t").option("header", "true").csv(path)


@register(
    "stable_sample_size",
    "SELECT CAST(least(count(*), 500) AS BIGINT) AS n, true AS unique_keys FROM orders",
)
def stable_sample_size(t: Tables) -> DataFrame:
    picked = tsv.stable_sample(t.orders, ["o_orderkey"], 500)
    return picked.agg(F.count("*").alias("n"), (F.count_distinct("o_orderkey") == F.count("*")).alias("unique_keys"))


@register("latest_from_files", fx.LINEITEM_CL + "SELECT l_orderkey, l_linenumber, is_deleted FROM latest")
def latest_from_files(t: Tables) -> DataFrame:
    """The log in two appends, as two loads leave it."""
    path = t.scratch("appended")
    log = fx.lineitem_log(t)
    changelog.append_log(log.filter("cdc_operation = 'd'"), path, fx.LINEITEM, layout=None)
    changelog.append_log(log.filter("cdc_operation <> 'd'"), path, fx.LINEITEM, layout="month")
    rows = latest(changelog.read_log(t.spark, path, fx.LINEITEM), fx.LINEITEM.keys)
    return rows.select("l_orderkey", "l_linenumber", "is_deleted")
