"""Records that arrive over time, as Structured Streaming. An extension: what is rebuilt here has no streams.

The checkpoint takes the place of a progress file: a query that starts again goes on where it ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators.reconcile import latest


def arriving(spark: SparkSession, folder: str, schema: str, files: int = 50) -> DataFrame:
    """JSON lines that are put into a folder, so many files at a time; what is no record has null fields and _bad."""
    return spark.readStream.schema(f"{schema}, _bad STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", files).json(folder)


def ingest(rows: DataFrame, table: str, rejected: str, checkpoint: str, key: str) -> StreamingQuery:
    """Keeps the table with the last row of each key, and what is no record beside it.

    Each batch is written under its number, so that one that runs again replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        good = batch.where("_bad is null").drop("_bad").where(F.col(key).isNotNull())
        good.dropDuplicates([key]).write.mode("overwrite").parquet(f"{table}/batch={number}")
        bad = batch.where("_bad is not null").select("_bad")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, key: str) -> DataFrame:
    """The last row of each key over all batches."""
    return latest(spark.read.parquet(table), key, "batch").drop("batch")


def outcomes(events: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts of each outcome in windows of the events' time ts; what comes later than the delay is left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "outcome").agg(F.count("*").alias("n"))
