"""Reading trip files, CSV generations, header-row JSON and polygons; lists of files as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonehour.operators.tables import conform, select_existing
from zonehour.schemas import MODES, trip_schema
from zonehour.shared import staged


def read_trips(spark: SparkSession, paths: Sequence[str], mode: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A mode's raw files in canonical names and types; only wanted columns are read.

    Every path (a file, folder or glob) is a schema generation of its own, so
    that columns may come, go and change type between them. The pickup range is
    pushed down to the files.
    """
    m = MODES[mode]
    names = {"pickup_datetime": (m.pickup,), "dropoff_datetime": (m.dropoff,)} | dict(m.aliases)
    if m.distance:
        names["trip_distance"] = (m.distance,)
    if "dropoff_datetime" in m.aliases:
        names["dropoff_datetime"] = m.aliases["dropoff_datetime"]
    schema = trip_schema(mode)
    wanted = [f.name for f in schema.fields if f.name not in ("dataset", "duration_min")]
    out = None
    for p in paths:
        df = select_existing(spark.read.parquet(p), wanted, names)
        if start:
            df = df.where(F.col("pickup_datetime") >= F.lit(start).cast("timestamp_ntz"))
        if end:
            df = df.where(F.col("pickup_datetime") < F.lit(end).cast("timestamp_ntz"))
        df = conform(df, schema, lenient=True).withColumn("dataset", F.lit(mode))
        out = df if out is None else out.unionByName(df)
    return out


def file_year(name: Column) -> Column:
    """The first four-digit year in a file's name."""
    return F.regexp_extract(name, r"(\d{4})", 1).try_cast("int")


def prune_files_by_year(files: DataFrame, min_year: int, max_year: int | None = None, exclude_prefixes: Sequence[str] = (), name: str = "file_name") -> DataFrame:
    """Of a table of files those of the years, without names or folders that begin with a prefix."""
    y = file_year(F.col(name))
    out = files.where(y >= min_year)
    out = out if max_year is None else out.where(y <= max_year)
    for p in exclude_prefixes:
        out = out.where(~F.col(name).startswith(p) & ~F.col(name).contains(f"/{p}"))
    return out


def one_per_month(files: DataFrame, name: str = "file_name") -> DataFrame:
    """The first file by name of each month; names hold yyyy-mm or yyyymm."""
    key = F.concat(F.regexp_extract(name, r"(\d{4})-?(\d{2})", 1), F.lit("-"), F.regexp_extract(name, r"(\d{4})-?(\d{2})", 2))
    x = files.withColumn("month_key", key)
    return x.withColumn("k", F.row_number().over(W.partitionBy("month_key").orderBy(name))).where("k = 1").drop("k")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file_name, size, modified) of the files below a path, in any store that Spark reads."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select(F.col("path").alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_csv_typed(spark: SparkSession, paths: Sequence[str] | str, schema: T.StructType, columns: Sequence[str] | None = None, source: str | None = None) -> DataFrame:
    """CSV with a header under a fixed schema; what doesn't fit is NULL. source: a column for the file's name."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(paths)
    if source:
        df = df.withColumn(source, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return df.select(*columns, *([source] if source else [])) if columns else df


def read_csv_named(spark: SparkSession, paths: Sequence[str] | str, schema: T.StructType, pattern: str, names: Mapping[str, str]) -> DataFrame:
    """CSV files under a fixed schema, found by glob, with columns from their paths: {column: type} for each group of a pattern of the path."""
    df = read_csv_typed(spark, paths, schema)
    path = F.url_decode("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(path, pattern, k).try_cast(kind).alias(n) for k, (n, kind) in enumerate(names.items(), 1)])


def split_csv(line: Column) -> Column:
    """The fields of one CSV line: quoted ones without their quotes, doubled quotes in them as one."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(\s*"(?:[^"]|"")*"\s*|[^,]*)'), F.lit(1))
    return F.transform(fields, lambda f: F.when(F.trim(f).startswith('"'), F.replace(F.regexp_extract(f, r'^\s*"((?:[^"]|"")*)"\s*$', 1), F.lit('""'), F.lit('"'))).otherwise(f))


def read_csv_generations(spark: SparkSession, path: Sequence[str] | str, aliases: Mapping[str, Sequence[str]], schema: T.StructType, source: str = "source_file") -> DataFrame:
    """The CSV files below a path, of whatever header generations, as one table of one schema.

    One scan of text gives each file's header, another its rows, which meet by the file's
    name. Which column a field is, the header says: by position among the first of its aliases that is there,
    whatever its case. Nobody has to sort the files, and thousands of them are one plan. Fields hold no line breaks; what doesn't
    fit its type is NULL, and so is what a short row lacks.
    """
    paths = [path] if isinstance(path, str) else list(path)
    text = spark.read.option("recursiveFileLookup", True).text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    first = text.where("at = 0").groupBy("file").agg(F.min_by("value", "k").alias("header"))
    heads = staged(first.select("file", "header", F.transform(split_csv(F.col("header")), lambda c: F.lower(F.trim(c))).alias("names")), "headers")
    rows = spark.read.option("recursiveFileLookup", True).text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    x = rows.join(heads, "file").where((F.col("value") != F.col("header")) & (F.trim("value") != "")).withColumn("fields", split_csv(F.col("value")))

    def field(name: str) -> Column:
        known = [F.when(F.array_contains("names", a.lower()), F.try_element_at("fields", F.array_position("names", F.lit(a.lower())).cast("int"))) for a in (name, *aliases.get(name, ()))]
        return F.nullif(F.coalesce(*known), F.lit(""))

    named = x.select(*[F.element_at(F.split("file", "/"), -1).alias(f.name) if f.name == source else field(f.name).alias(f.name) for f in schema.fields])
    return conform(named, schema, lenient=True)


def read_lookup(spark: SparkSession, path: Sequence[str] | str) -> DataFrame:
    """A small CSV with a header whose types are inferred, which reads it twice. What is large has a schema."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, header) of the CSV files below a path: the header as an array of names; empty files have none.

    One scan of text, of which only the first row of each file's first block leaves its task.
    """
    x = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    first = x.where("at = 0").groupBy("file_name").agg(F.min_by("value", "k").alias("header"))
    return first.select("file_name", F.transform(F.split("header", ","), lambda c: F.trim(F.btrim(c, F.lit('"')))).alias("header"))


def header_generation(header: Column) -> Column:
    """Which generation of bike files a header belongs to: old, new or unknown; case doesn't matter, and old goes first."""
    names = F.transform(header, lambda c: F.lower(c))

    def has(*any_of: str) -> Column:
        return F.arrays_overlap(names, F.array(*map(F.lit, any_of)))

    return F.when(has("tripduration", "start station id"), "old").when(has("started_at", "start_lat"), "new").otherwise("unknown")


def generation_changes(headers: DataFrame, by: Sequence[str] = (), name: str = "file_name") -> DataFrame:
    """Adds generation, and changed: whether it differs from that of the file before; a first file doesn't. A row per file, so that windows are small."""
    x = headers.withColumn("generation", header_generation(F.col("header")))
    before = F.lag("generation").over(W.partitionBy(*by).orderBy(name))
    return x.withColumn("changed", F.coalesce(before != F.col("generation"), F.lit(False)))


def table_from_header_json(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    """JSON arrays whose first row is the header -> a row per data row, the named columns as text.

    Responses may order their columns differently.
    """
    x = df.select(F.from_json(col, "array<array<string>>").alias("a")).select(F.col("a")[0].alias("head"), F.explode(F.slice("a", F.lit(2), F.greatest(F.size("a") - 1, F.lit(0)))).alias("row"))
    return x.select(*[F.try_element_at("row", F.array_position("head", F.lit(n)).cast("int")).alias(n) for n in names])


def read_jsonl(spark: SparkSession, paths: Sequence[str] | str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(paths)


_GEOJSON = "type string, features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def read_polygons(spark: SparkSession, path: str, id_property: str) -> DataFrame:
    """(zone_id, coords) of a GeoJSON collection: a row per polygon, a multi-polygon as several rows of one zone."""
    f = spark.read.schema(_GEOJSON).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    ring = "array<array<array<double>>>"
    one = F.array(F.from_json("f.geometry.coordinates", ring))
    many = F.from_json("f.geometry.coordinates", f"array<{ring}>")
    return f.select(F.col("f.properties")[id_property].alias("zone_id"), F.explode(F.when(F.col("f.geometry.type") == "Polygon", one).otherwise(many)).alias("coords"))


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
