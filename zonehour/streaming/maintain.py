"""Tables that streams of files keep up to date: closed hours of a watermark, and a panel by month."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from zonehour.shared import delete
from zonehour.sources.sinks import write_partitioned
from zonehour.streaming.ingest import hourly_counts

MONTH = ("year", "month")


def hourly_stream(spark: SparkSession, in_dir: str, out_dir: str, schema: T.StructType, checkpoint: str, ts: str, keys: Sequence[str], late: str = "1 day", files_per_batch: int | None = None) -> StreamingQuery:
    """Counts per key and hour of the files that are new since the last call; appends the hours that are closed and stops.

    An hour is closed once the latest time seen is `late` beyond its end. Open hours
    wait in the checkpoint's state for the next call; rows of closed hours, in whatever file, are dropped.
    """
    r = spark.readStream.schema(schema)
    r = r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r
    counts = hourly_counts(r.parquet(in_dir), ts, late, keys)
    return counts.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out_dir).outputMode("append").trigger(availableNow=True).start()


def _months(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({"year": F.year(ts), "month": F.month(ts)})


def rebuild_months(trips: DataFrame, months: DataFrame, panel_dir: str, panel: Callable[[DataFrame], DataFrame]) -> None:
    """Writes the panel of the months (year, month) anew, from all trips (year, month, ...); other months' files stay as they are.

    months is joined to the partitions, so that only theirs are read.
    """
    wanted = trips.join(F.broadcast(months.distinct()), list(MONTH), "left_semi")  # a row per calendar month at most
    write_partitioned(panel(wanted), panel_dir, by=MONTH)


def maintain_panel(spark: SparkSession, in_dir: str, trips_dir: str, panel_dir: str, schema: T.StructType, checkpoint: str, clean: Callable[[DataFrame], DataFrame], panel: Callable[[DataFrame], DataFrame], ts: str = "pickup_datetime", files_per_batch: int | None = None) -> StreamingQuery:
    """Takes up the files that are new since the last call, and writes the panel's months that they touch anew.

    `clean` makes trips of raw rows, `panel` a panel with the columns year and month of trips that have them. Trips stay
    in trips_dir, a folder per batch: a batch that runs again replaces its own. Percentiles can't be merged, so a month that is touched is made
    of all its trips; which those are is found from the batch's months.
    """

    def take(batch: DataFrame, number: int) -> None:
        at = f"{trips_dir}/batch={number}"
        delete(batch.sparkSession, at)
        rows = _months(clean(batch), ts)
        write_partitioned(rows, at, by=MONTH)
        new = batch.sparkSession.read.schema(rows.schema).parquet(at)
        if not new.isEmpty():
            rebuild_months(batch.sparkSession.read.parquet(trips_dir).drop("batch"), new.select(*MONTH), panel_dir, panel)

    r = spark.readStream.schema(schema)
    r = r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r
    return r.parquet(in_dir).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lacking(spark: SparkSession, path: str, column: str, by: Sequence[str]) -> DataFrame:
    """The partitions (by) of an output in which some file lacks a column, from the footers, which tasks read."""
    from zonehour.sources.footers import footers

    f = footers(spark, path)
    without = f.where(~F.exists("columns", lambda c: c["name"] == column))
    kind = spark.read.parquet(path).schema
    keys = [F.regexp_extract("file_name", f"/{c}=([^/]*)/", 1).cast(kind[c].dataType).alias(c) for c in by]
    return without.select(*keys).distinct()


def rewrite_obsolete(spark: SparkSession, path: str, column: str, by: Sequence[str], rebuilt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Writes the partitions anew that lack a column that their writer makes today; returns which those were.

    `rebuilt` gives the rows of the partitions that it is asked for. Other
    partitions' files stay as they are.
    """
    from zonehour.shared import staged

    old = staged(lacking(spark, path, column, by), "obsolete")
    if not old.isEmpty():
        write_partitioned(rebuilt(old), path, by=by)
    return old
