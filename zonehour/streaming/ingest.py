"""Incremental ingestion of monthly files, and hourly counts of a stream of trips."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def ingest_available(spark: SparkSession, in_dir: str, out_dir: str, schema: T.StructType, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, by: Sequence[str] = (), files_per_batch: int | None = None, glob: str | None = None) -> StreamingQuery:
    """Processes the files that are new since the last call, each exactly once, and stops."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.parquet(in_dir)
    df = transform(df) if transform else df
    w = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out_dir).outputMode("append").trigger(availableNow=True)
    return (w.partitionBy(*by) if by else w).start()


def hourly_counts(trips: DataFrame, ts: str = "pickup_datetime", late: str = "1 day", keys: Sequence[str] = ("PULocationID", "DOLocationID")) -> DataFrame:
    """Trips per key and hour, of a table or a stream; a stream's hours close once they are later than `late`."""
    x = trips.withColumn(ts, F.col(ts).cast("timestamp"))
    x = x.withWatermark(ts, late) if x.isStreaming else x
    return x.groupBy(*keys, F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("trip_count")).select(*keys, F.col("w.start").alias("hour_start"), "trip_count")
