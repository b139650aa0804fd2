"""Micro-batches of newly arrived point tables: each batch is segmented as soon as it lands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def segment_arrivals(spark: SparkSession, source: str, target: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame], available_now: bool = True) -> StreamingQuery:
    """Runs plan on each batch of Parquet files (point_id, xi, yi, zi) that arrive in source, and writes it below target by batch, so that a batch that is
    repeated after a failure replaces itself. With available_now the query ends when all files are done."""

    def one(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    arrivals = spark.readStream.schema("point_id long, xi long, yi long, zi long").parquet(source)
    writer = arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
