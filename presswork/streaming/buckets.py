"""The calendar views and the deduplicating log as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presswork.session import own_dir


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 4) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts a window and key, tumbling or sliding; rows later than ``late`` are dropped when streaming."""
    src = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return src.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("value_sum")).select(
        F.col("w.start").alias("window_start"), *keys, "n_rows", "value_sum")


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """First arrival of each key; state is kept for ``late`` only."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", prepare: Callable | None = None) -> DataFrame:
    """Runs a stream over what is there now, into a table of the shared folder, and reads it.

    The checkpoint lies beside the table, so a restarted query goes on where it stopped.
    """
    import uuid

    spark = stream.sparkSession
    base = f"{own_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    if mode == "complete":
        def save(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/data")

        q = stream.writeStream.outputMode(mode).foreachBatch(save)
    else:
        q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/data")
    query = q.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")
