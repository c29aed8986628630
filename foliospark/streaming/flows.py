"""Incremental ingest and live metrics with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.metrics import latency_windows
from ..sources.sinks import upsert_table


def ingest_stream(spark: SparkSession, source: str, schema: StructType, table: str, checkpoint: str, key: str = "chunk_id", order: str | None = None, once: bool = True) -> StreamingQuery:
    """New files of a folder are upserted into a table.  The checkpoint skips files already taken, and the upsert makes a
    repeated batch harmless."""
    rows = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, _epoch: int) -> None:
        upsert_table(df, table, key, order)

    w = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")).start()


def new_files(rows: DataFrame, watermark: str = "1 day", time: str = "modificationTime") -> DataFrame:
    """Files of a stream by checksum, each once within the watermark."""
    return rows.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["sha256"])


def live_latency(metrics: DataFrame, lateness: str = "5 minutes", length: str = "5 minutes", slide: str = "5 seconds") -> DataFrame:
    """Windows of request durations over a stream; rows later than *lateness* are dropped, as are redeliveries."""
    zoned = metrics.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time with zone
    once = zoned.withWatermark("ts", lateness).dropDuplicates(["metric_id", "ts"])
    return latency_windows(once, length, slide).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregating stream over all that is there; every batch replaces the table with the complete result."""

    def batch(rows: DataFrame, _epoch: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    q = df.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def provider_of(rows: DataFrame, providers: list[str], strategy: str = "round_robin", order: str = "chunk_id", weights: list[int] | None = None) -> DataFrame:
    """Adds the provider that serves a row: the first (default), in turn (round_robin), or one row for each (all).

    Turns go by the number *order*, each provider as often as its weight (1 without any), so no global order is needed.
    """
    names = F.array(*map(F.lit, providers))
    if strategy == "all":
        return rows.withColumn("provider", F.explode(names))
    if strategy == "round_robin":
        turns = F.array(*[F.lit(p) for p, w in zip(providers, weights or [1] * len(providers)) for _ in range(w)])
        return rows.withColumn("provider", F.element_at(turns, (F.pmod(F.col(order), F.size(turns)) + 1).cast("int")))
    if strategy != "default":
        raise ValueError("provider strategy must be one of default, round_robin, all")
    return rows.withColumn("provider", F.lit(providers[0]))
