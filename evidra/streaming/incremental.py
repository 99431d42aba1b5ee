"""Incremental evaluation: new generation files run through the batch operators as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidra import schemas
from evidra.operators.evaluation import upgrade_records


def evaluate_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, evaluate: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Each batch of new JSON-lines files is upgraded, evaluated and written under its batch id, so
    that a batch that runs again after a failure replaces its own output."""
    source = spark.readStream.schema(schemas.GENERATION).json(folder)

    def sink(batch: DataFrame, number: int) -> None:
        done = upgrade_records(batch)
        (evaluate(done) if evaluate else done).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(events: DataFrame, time: str, window: str, late: str, key: str) -> DataFrame:
    """Counts per event-time window and key; rows later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))
