"""What the footers of many Parquet files say, read by tasks, and reports on it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonehour.shared import staged

FOOTER = "file_name string, n_bytes long, n_rows long, n_row_groups int, columns array<struct<name:string,type:string>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    for b in batches:
        out = []
        for uri, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as f:
                m = pq.ParquetFile(f)
                columns = [{"name": c.name, "type": str(c.type)} for c in m.schema_arrow]
                out.append({"file_name": uri, "n_bytes": size, "n_rows": m.metadata.num_rows, "n_row_groups": m.metadata.num_row_groups, "columns": columns})
        kind = pa.schema([("file_name", pa.string()), ("n_bytes", pa.int64()), ("n_rows", pa.int64()), ("n_row_groups", pa.int32()), ("columns", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())])))])
        yield pa.RecordBatch.from_pylist(out, kind)


def footers(spark: SparkSession, path: str | Sequence[str], glob: str = "*.parquet") -> DataFrame:
    """(file_name, n_bytes, n_rows, n_row_groups, columns) of the Parquet files below a path; columns in the files' order, types as Arrow names them.

    Spark lists the files; their footers, and nothing else of them, are read in tasks, at once and into a table, by
    pyarrow, which must know the store.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path if isinstance(path, str) else list(path)).select(F.col("path"), F.col("length"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return staged(found.repartition(n, "path").mapInArrow(_read, FOOTER), "footers")


def column_table(files: DataFrame) -> DataFrame:
    """(file_name, column, type) of a table of footers."""
    return files.select("file_name", F.explode("columns").alias("c")).select("file_name", F.col("c.name").alias("column"), "c.type")


def drift(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, file_name, column, change) of files against the first by name of each `by`: added, removed or type changed.

    files is a table of footers. Each column of a file meets the first's once.
    """
    keys = list(by) or ["__all"]
    named = files.select(*by, "file_name", "columns", *([] if by else [F.lit(1).alias("__all")]))
    x = named.join(named.groupBy(*keys).agg(F.min_by("columns", "file_name").alias("base")), keys)
    both = F.array_union(F.transform("columns", lambda c: c["name"]), F.transform("base", lambda c: c["name"]))
    kind = lambda of, name: F.get(F.filter(of, lambda c: c["name"] == name), F.lit(0))["type"]
    change = lambda a, b: F.when(b.isNull(), "added").when(a.isNull(), "removed").when(a != b, "type changed")
    x = x.select(*by, "file_name", F.explode(F.transform(both, lambda n: F.struct(n.alias("column"), change(kind("columns", n), kind("base", n)).alias("change")))).alias("c"))
    return x.select(*by, "file_name", "c.*").where("change IS NOT NULL")


def inventory_of(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n_files, n_rows, n_bytes) of a table of footers."""
    return files.groupBy(*by).agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))


def expected(files: DataFrame, wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    """The inventory of wanted outputs (by): those without a file too, with exists false and no counts."""
    have = inventory_of(files, by)
    return wanted.select(*by).distinct().join(have, list(by), "left").withColumn("exists", F.col("n_files").isNotNull())
