"""Station and model text files, record files, cubes in Parquet: sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text_dates import packed_degrees, padded_date, spanish_number
from ..model import nullify
from ..operators.joins import with_tile


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Several products under each other by column names; a glob or a list of paths along time needs no more."""
    out = None
    for p in paths:
        d = spark.read.parquet(p)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def read_semicolon(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """Semicolon-separated station records in Latin-1 with a header, read as text unless a schema is given."""
    r = spark.read.option("sep", ";").option("header", True).option("encoding", "ISO-8859-1")
    return (r.schema(schema) if schema else r).csv(paths)


def station_records(raw: DataFrame) -> DataFrame:
    """code, name, province, altitude, lon, lat, day and rain (tenths of mm become mm) of daily and sub-daily maxima."""
    num = lambda c: F.col(c).try_cast("int")
    rain = [(F.col(c).try_cast("double") / 10).alias(c.lower()) for c in ("PMAX10", "PMAX60", "P24") if c in raw.columns]
    return raw.select(F.col("INDICATIVO").alias("code"), F.col("NOMBRE").alias("name"), F.col("NOM_PROV").alias("province"), F.col("ALTITUD").try_cast("double").alias("altitude"), packed_degrees(num("LONGITUD")).alias("lon"), packed_degrees(num("LATITUD"), lon=False).alias("lat"), padded_date(num("ANO"), num("MES"), num("DIA")).alias("day"), *rain)


def stations(records: DataFrame) -> DataFrame:
    """One row for each station: its attributes on the first day, and its period of record."""
    first = lambda c: F.min_by(c, "day").alias(c)
    return records.groupBy("code").agg(*(first(c) for c in ("name", "province", "altitude", "lon", "lat")), F.min("day").alias("sdate"), F.max("day").alias("edate"))


def read_network(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Space-separated 10-minute records (stn_id, ts, rain); -999 is missing."""
    raw = spark.read.option("sep", " ").option("header", True).schema("stn_id string, DateTime string, Prec double").csv(paths)
    ts = F.coalesce(F.try_to_timestamp("DateTime", F.lit("yyyy-MM-dd_HH:mm:ss")), F.try_to_timestamp("DateTime", F.lit("yyyyMMddHHmm"))).cast("timestamp_ntz")
    return nullify(raw.select("stn_id", ts.alias("ts"), F.col("Prec").alias("rain")), "rain")


def read_skipping(spark: SparkSession, path: str, skip: int, names: list[str], sep: str = ",") -> DataFrame:
    """Columns by name of text files without (or with another) header, less the first `skip` lines of each file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    first = lines.where("b = 0").groupBy("f").agg(F.min("i").alias("i0"))
    part = F.split("value", sep, -1)
    return lines.join(F.broadcast(first), "f").where((F.col("b") > 0) | (F.col("i") >= F.col("i0") + skip)).where("value != ''").select(*(F.trim(F.get(part, F.lit(k))).alias(n) for k, n in enumerate(names)))  # one row for each file


def hourly_series(raw: DataFrame) -> DataFrame:
    """ts and rain of text columns year, month, day, hour, pr."""
    part = [F.lpad(F.col(c).cast("int").cast("string"), 2, "0") for c in ("month", "day", "hour")]
    ts = F.try_to_timestamp(F.concat(F.col("year").cast("int").cast("string"), *part), F.lit("yyyyMMddHH")).cast("timestamp_ntz")
    return raw.select(ts.alias("ts"), F.col("pr").try_cast("double").alias("rain"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of records."""
    return spark.read.option("multiLine", True).json(path)


def climatology_records(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("indicativo").alias("code"), F.col("nombre").alias("name"), F.col("provincia").alias("province"), F.to_date("fecha").alias("day"), spanish_number(F.col("prec")).alias("rain"))


def write_records(df: DataFrame, path: str, mode: str = "ignore") -> None:
    df.write.mode(mode).json(path)


def prune(df: DataFrame, first_year: int, last_year: int, months: list[int] | None = None) -> DataFrame:
    """Filters on the partition columns year and month, which the scan prunes."""
    d = df.where(F.col("year").between(first_year, last_year))
    return d.where(F.col("month").isin(months)) if months else d


def write_cube(df: DataFrame, path: str, tile: int = 50, mode: str = "ignore", attributes: dict[str, str] | None = None) -> None:
    """A cube by run and tile, its series together and in time order; attributes go to a sidecar table. An existing product stays (mode 'ignore')."""
    d = with_tile(df, tile)
    d.repartition("run", "ty", "tx").sortWithinPartitions("run", "ty", "tx", "y", "x", "ts").write.mode(mode).partitionBy("run", "ty", "tx").parquet(path)
    if attributes:
        df.sparkSession.createDataFrame(list(attributes.items()), "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}_attributes")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}_attributes")


def merge_tiles(*parts: DataFrame) -> DataFrame:
    """Tiles to a domain, or pieces of time to a series: cells carry their coordinates, so rows are put under each other."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_bounds(df: DataFrame, step_minutes: int, ts: str = "ts") -> DataFrame:
    half = step_minutes * 30
    return df.withColumns({"ts_from": F.timestamp_add("SECOND", F.lit(-half), F.col(ts)), "ts_to": F.timestamp_add("SECOND", F.lit(half), F.col(ts))})


def for_maps(df: DataFrame, grid: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renamed columns, coordinates joined to every step, time as yyyy-MM-dd_HH:mm:ss."""
    return df.join(grid.select("y", "x", "lat", "lon"), ["y", "x"]).withColumn("Times", F.date_format("ts", "yyyy-MM-dd_HH:mm:ss")).withColumnsRenamed(names)


def rewrap_and_clip(df: DataFrame, box: tuple[float, float, float, float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Longitudes over 180 become negative; rows outside the box go."""
    wrapped: Column = F.when(F.col(lon) > 180, F.col(lon) - 360).otherwise(F.col(lon))
    return df.withColumn(lon, wrapped).where(F.col(lat).between(box[0], box[2]) & F.col(lon).between(box[1], box[3]))
