"""Topics to changelogs: one continuous decode per table, exactly once into its files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from changelake.operators.envelope import decode, rejects
from changelake.specs import TableSpec
from changelake.sources.changelog import append_log
from changelake.sources.topic import topic_name
from changelake.streaming import offsets

EVENT_ID = ("topic", "partition", "offset")

#: Spark keeps the files of a shuffle until the driver collects its garbage. With this they go as soon as a write has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def message_files(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Stream of message files with the columns of a topic, for replays and tests."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _before(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """Rows of the batch folders below ``batch_id``; only these folders are read."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(whole).parquet(path).filter(F.col("batch") < batch_id)


def keep_once(
    messages: DataFrame, path: str, checkpoint: str, ids: Sequence[str] = EVENT_ID, ordered: bool = False, trigger: dict | None = None
) -> StreamingQuery:
    """Write each message once, however late it comes and however often it is delivered.

    There is no watermark: a message is left out only because its id was written before. Every
    micro-batch goes to a folder of its own, which a repeated batch overwrites, and nothing stored is read again: beside
    the data lie the intervals of offsets seen so far (see ``offsets``), a row for each 65,536 offsets, and a batch
    reads those of the batch before it. ``ordered`` is for sources that deliver the offsets of a partition in
    rising order, as a broker does: then the highest offset of each partition is enough, one row each.
    The last column of ``ids`` is the offset, a whole number.
    """
    marks = f"{path.rstrip('/')}-marks"
    source = list(ids)[:-1]
    offset = list(ids)[-1]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(ids))
        kinds = T.StructType([batch.schema[c] for c in ids])
        if ordered:
            seen = new.groupBy(*source).agg(F.max(offset).alias(offset))
            if batch_id > 0:
                known = _before(spark, marks, kinds, batch_id).filter(F.col("batch") == batch_id - 1).drop("batch")
                new = new.join(known.withColumnRenamed(offset, "_mark"), source, "left").filter(F.coalesce(F.col(offset) > F.col("_mark"), F.lit(True))).drop("_mark")
                seen = known.unionByName(seen).groupBy(*source).agg(F.max(offset).alias(offset))
            new.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            seen.select(*ids).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
            return
        shape = T.StructType([*[batch.schema[c] for c in source], *T.StructType.fromDDL(f"chunk bigint, {offsets.SPANS}")])
        known = _before(spark, marks, shape, batch_id).filter(F.col("batch") == batch_id - 1).drop("batch") if batch_id > 0 else spark.createDataFrame([], shape)
        if batch_id > 0:
            new = offsets.new_ids(new, known, source, offset)
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        # from what was written, so that both agree even if the batch's rows come in another order the next time
        stored = spark.read.schema(batch.schema).parquet(f"{path}/batch={batch_id}")
        offsets.merged(known, offsets.seen(stored, source, offset), source).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName("keep_once")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_seen(spark: SparkSession, path: str, messages: T.StructType, ids: Sequence[str] = EVENT_ID) -> DataFrame:
    """Chunks of offsets seen by an unordered ``keep_once``, as its last batch left them."""
    shape = T.StructType([*[messages[c] for c in list(ids)[:-1]], *T.StructType.fromDDL(f"chunk bigint, {offsets.SPANS}, batch bigint")])
    marks = spark.read.schema(shape).parquet(f"{path.rstrip('/')}-marks")
    return marks.where(F.col("batch") == marks.agg(F.max("batch")).scalar()).drop("batch")


def read_once(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``keep_once`` has written."""
    return spark.read.schema(schema).parquet(path)


def ingest(
    messages: DataFrame,
    spec: TableSpec,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    message: str = "value",
    layout: str | None = "month",
    name: str = "stream",
    **policies,
) -> StreamingQuery:
    """Decode one table's messages and append them to its log. Late events are never dropped.

    Every batch is written to a folder of its own, which a repeated batch replaces, and the checkpoint holds the consumed
    offsets, so a restart neither loses nor repeats rows. Statements may be appended to the same log. Streams that share a log
    need different names. The shuffle of a batch is on disk until the batch is written: a source that is far ahead should
    hand out its rows in batches of a bounded size.
    """
    log = decode(messages, spec, message, **policies)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.sparkSession.conf.set(DROP_SHUFFLES, "true")  # this session is the stream's own
        append_log(batch, path, spec, layout, part=f"{name}-{batch_id}")

    writer = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(f"ingest_{spec.name}")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ingest_tables(
    messages: DataFrame | dict[str, DataFrame], specs: dict[str, TableSpec], root: str, prefix: str = "cdc.imdb", trigger: dict | None = None
) -> list[StreamingQuery]:
    """One pipeline and one checkpoint per table.

    ``messages`` is one stream for each table, subscribed to its own topic, or one that holds all topics; of
    that, each pipeline reads everything and keeps its topic.
    """

    def of_table(name: str, spec: TableSpec) -> DataFrame:
        if isinstance(messages, dict):
            return messages[name]
        return messages.filter(messages["topic"] == topic_name(spec, prefix))

    return [
        ingest(
            of_table(name, spec),
            spec,
            f"{root}/log/{name}",
            f"{root}/checkpoint/{name}",
            trigger,
        )
        for name, spec in specs.items()
    ]


def keep_rejects(messages: DataFrame, spec: TableSpec, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write the messages that do not decode, with a reason, next to the table's log."""
    writer = rejects(messages, spec).writeStream.format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint).queryName(f"rejects_{spec.name}")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def load_chunks(
    spark: SparkSession, chunks: str, schema: T.StructType, path: str, checkpoint: str, at_once: int = 1
) -> StreamingQuery:
    """Load chunk files ``at_once`` per commit; a restart goes on after the last committed ones."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(chunks)
    writer = source.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def drain(query: StreamingQuery, timeout_s: int | None = None) -> bool:
    """Wait until a query has read everything there was at its start; false on time-out."""
    done = query.awaitTermination(timeout_s) if timeout_s else query.awaitTermination()
    return done is not False
