"""Work that is done batch by batch: what is left, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def todo(all_rows: DataFrame, done: DataFrame, key: str, order: str, batch: int | None = None, done_if: str | None = None) -> DataFrame:
    """The next rows, by `order`, whose key isn't done; all of them without `batch`. done_if: a condition on `done` that a row must
    meet to count, so that failures ("symbol IS NULL") are tried again. Rows with a null key are never done."""
    d = (done.where(done_if) if done_if else done).select(F.col(key).alias("__done")).distinct()
    left = all_rows.join(d, all_rows[key] == F.col("__done"), "left_anti")
    return left if batch is None else left.orderBy(order, key).limit(batch)


def purge_failed(done: DataFrame, column: str) -> DataFrame:
    """Rows whose column isn't null."""
    return done.na.drop(subset=[column])


def stream_new(spark: SparkSession, source: str, schema: StructType, key: str, sink: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], files: int = 100, time: str | None = None, late: str = "1 day") -> int:
    """Process what came into the folder `source` since the last call and append it to `sink`; returns the rows of the sink.

    Keys are taken once: with `time`, repeated rows are told within `late` of it, which bounds the state; without it every key is
    kept. Each micro-batch is written under its own number, so a batch that is run again after a failure replaces itself.
    """
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    s = s.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else s.dropDuplicates([key])

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    q = s.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink).count()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n) in tumbling windows; rows later than `late` are dropped when it runs as a stream."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("window_start"), key, "n")
