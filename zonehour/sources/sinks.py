"""Writing canonical tables, reports and documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from zonehour.operators.tables import conform


def write_partitioned(df: DataFrame, path: str, schema: T.StructType | None = None, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Snappy Parquet in a canonical schema. Of a partitioned table only the partitions that df has are replaced.

    Rows are dealt out by the partition columns first, so that a partition has
    few files; a large one is split by the adaptive engine.
    """
    extra = [df.schema[c] for c in by if schema and c not in schema.names]
    out = conform(df, T.StructType([*schema.fields, *extra])) if schema else df
    if by:
        out = out.hint("rebalance", *by)
    out.write.mode(mode).option("compression", "snappy").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """df as a table of the catalogue, dealt into buckets by its keys and sorted there; tables alike in that join on all keys without an exchange."""
    df.repartition(buckets, *keys).write.mode("overwrite").option("compression", "snappy").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_report(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", redo: bool = False) -> list[str]:
    """One folder per table; finished ones are skipped, so that a report can be resumed. Returns what was written."""
    done = []
    for name, df in tables.items():
        spark, path = df.sparkSession, f"{folder}/{name}"
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not redo and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            continue
        w = df.write.mode("overwrite")
        (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)
        done.append(name)
    return done
