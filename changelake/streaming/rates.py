"""Operation rates per minute over a stream of log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from changelake.operators.audit import op_rates

RATE_SCHEMA = "minute timestamp, deletes bigint, inserts bigint, updates bigint, batch bigint"


def maintain_rates(log: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Count the operations of every micro-batch by minute, into a folder of its own.

    There is no state and no watermark: a change counts in its minute however late it comes. A repeated batch
    overwrites its folder, so nothing counts twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        op_rates(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName("op_rates")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Counts of each minute: the sum over the batches that held changes of it."""
    rows = spark.read.schema(RATE_SCHEMA).parquet(path)
    return rows.groupBy("minute").agg(*[F.sum(c).alias(c) for c in ("deletes", "inserts", "updates")])
