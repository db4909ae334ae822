"""Resumable ingestion and monitoring of logs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, key: str = "id", process: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Rows of new JSON files go into the Parquet table ``store`` unless their key is there.

    The checkpoint keeps which files are done, the store which keys are: a run that fails between
    the two repeats its batch without doubling rows. Keys that ``process`` drops are not stored,
    so they are tried again. Runs over what is there and ends.
    """
    stream = spark.readStream.schema(schema).json(source)

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        rows = process(rows) if process else rows
        try:
            rows = rows.join(spark.read.parquet(store).select(key), key, "left_anti")
        except Exception as e:  # the first batch: there is no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LOG = "current_steps int, total_steps int, loss double, lr double, epoch double, elapsed_time string, total_tokens bigint, throughput double"


def monitor(spark: SparkSession, folder: str, name: str, every: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """The rows of a growing log folder in the memory table ``name``, with progress in percent."""
    rows = spark.readStream.schema(LOG).json(folder).withColumn("percentage", F.when(F.col("total_steps") > 0, F.round(100 * F.col("current_steps") / F.col("total_steps"), 2)).otherwise(100.0))
    writer = rows.writeStream.format("memory").queryName(name).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def latest(log: DataFrame) -> DataFrame:
    """The row of the greatest step."""
    return log.agg(F.max_by(F.struct(*log.columns), "current_steps").alias("r")).select("r.*")


def losses(log: DataFrame) -> DataFrame:
    """(step, loss) of the rows with a loss that is not 0."""
    return log.where("loss is not null and loss <> 0").select(F.col("current_steps").alias("step"), "loss")


class RowStream:
    """A dataset read in order, a block at a time, without holding it: no length, no access by place, and
    a state from which reading goes on.

    The rows are numbered once (see ``sequence.with_ordinal``) and each block is read by its numbers.
    """

    def __init__(self, df: DataFrame, order: list[str], block: int = 1000, state: dict | None = None):
        from textloom.common import materialize
        from textloom.operators.sequence import with_ordinal

        self.rows = materialize(with_ordinal(df, order, name="_place").repartitionByRange("_place").sortWithinPartitions("_place"), "stream")
        self.block, self.at = block, (state or {}).get("at", 0)

    def __iter__(self):
        while True:
            part = self.rows.where((F.col("_place") >= self.at) & (F.col("_place") < self.at + self.block)).orderBy("_place").drop("_place").collect()  # a block
            if not part:
                return
            for row in part:
                self.at += 1
                yield row

    def state(self) -> dict:
        return {"at": self.at}
