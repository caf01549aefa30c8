"""Readers: every input the library takes, as Spark sources with fixed schemas where known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def permits_csv(spark: SparkSession, path: str) -> DataFrame:
    """Registry export with a header; every column stays text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def parse_permits_csv(lines: DataFrame, names: Sequence[str], value: str = "value") -> DataFrame:
    """Registry lines (text column ``value``, without the header) to text columns, quote-aware.

    Short lines leave nulls, fields beyond the names are dropped, empty fields are null.
    """
    schema = ", ".join(f"`{name}` string" for name in names)
    parsed = F.from_csv(F.col(value), schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return lines.select(parsed.alias("r")).select("r.*")


def parse_permits_json(texts: DataFrame, names: Sequence[str], value: str = "value") -> DataFrame:
    """Registry texts (an array of records each) to a row per record with text values.

    Absent keys and JSON nulls are null; a text that is no array of records gives no row.
    """
    records = F.explode(F.from_json(F.col(value), "array<map<string,string>>"))
    return texts.select(records.alias("r")).select(*(F.col("r").getItem(name).alias(name) for name in names))


def permits_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Registry records (one array per file, or one record per line) with text values."""
    return spark.read.json(path, multiLine=not lines, primitivesAsString=True)


_GEOMETRY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("coordinates", T.StringType()),  # nesting depends on the type: parsed later
])


def features(
    spark: SparkSession, path: str, properties: str | T.StructType, lines: bool = False
) -> DataFrame:
    """GeoJSON features: property columns plus ``geometry`` (type, coordinates as text).

    A FeatureCollection file is one record and is read by one task; ``lines`` reads the
    one-feature-per-line form that ``writers.features`` produces, which splits freely.
    """
    props = T.StructType.fromDDL(properties) if isinstance(properties, str) else properties
    feature = T.StructType([
        T.StructField("geometry", _GEOMETRY), T.StructField("properties", props)
    ])
    if lines:
        rows = spark.read.schema(feature).json(path)
    else:
        whole = T.StructType([T.StructField("features", T.ArrayType(feature))])
        rows = (
            spark.read.schema(whole).json(path, multiLine=True)
            .select(F.explode("features").alias("f"))
            .select("f.*")
        )
    return rows.select("properties.*", "geometry")


def parse_features(texts: DataFrame, properties: str, value: str = "value") -> DataFrame:
    """FeatureCollection texts to a row per feature: property columns plus ``geometry``."""
    feature = T.StructType([T.StructField("geometry", _GEOMETRY), T.StructField("properties", T.StructType.fromDDL(properties))])
    whole = T.StructType([T.StructField("features", T.ArrayType(feature))])
    return texts.select(F.explode(F.from_json(F.col(value), whole)["features"]).alias("f")).select("f.properties.*", "f.geometry")


def feature_points(df: DataFrame) -> DataFrame:
    """Point features to longitude and latitude; other or empty geometries give nulls."""
    xy = F.from_json("geometry.coordinates", "array<double>")
    at = lambda i: F.when(F.col("geometry.type") == "Point", F.get(xy, F.lit(i)))
    return df.withColumns({"longitude": at(0), "latitude": at(1)}).drop("geometry")


def feature_rings(df: DataFrame) -> DataFrame:
    """Polygon features to ``rings`` (first the shell, then holes)."""
    nested = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    ring = lambda r: F.transform(
        r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    )
    polygons = df.filter(F.col("geometry.type") == "Polygon")
    return polygons.withColumn("rings", F.transform(nested, ring)).drop("geometry")


def setbacks(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """Setback polygons with their attributes."""
    return feature_rings(features(spark, path, properties, lines))


def layer(spark: SparkSession, path: str) -> DataFrame:
    """A processed layer (permits, polygons, supply map) as written by ``writers.layer``."""
    return spark.read.parquet(path)


def raster(spark: SparkSession, path: str) -> DataFrame:
    """Crop pixels (tile_id, row, col, code) or blocks (tile_id, row, col0, codes)."""
    return spark.read.parquet(path)


def rgb(spark: SparkSession, path: str) -> DataFrame:
    """Image pixels; bands beyond the first three are not read."""
    return spark.read.parquet(path).select("tile_id", "row", "col", "r", "g", "b")


def summaries(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """``key: value`` text files to one row per file with the keyed numbers.

    Thousands commas are dropped; a missing or unreadable value is null.  Giving the keys
    saves the extra pass that finding them would take.
    """
    return parse_summaries(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value"), keys)


def parse_summaries(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines (file, value) of key/value texts to one row per file; of a repeated key one value counts."""
    pair = F.split("value", ":", 2)
    number = F.regexp_replace(F.trim(F.get(pair, F.lit(1))), ",", "").try_cast("double")
    return (
        lines.filter(F.col("value").contains(":"))
        .select("file", F.lower(F.trim(pair[0])).alias("key"), number.alias("number"))
        .groupBy("file").pivot("key", list(keys)).agg(F.first("number", ignorenulls=True))
    )


_REPLY = "id string, address string, match_flag string, match_type string, matched_address string, lon_lat string"


def geocode_replies(spark: SparkSession, path: str) -> DataFrame:
    """Geocoder reply lines, quote-aware; short lines leave nulls and are dropped later."""
    return spark.read.schema(_REPLY).csv(path, quote='"', escape='"', mode="PERMISSIVE")


def tiles(spark: SparkSession, path: str, limit: int | None = None, pattern: str = "*.tif") -> DataFrame:
    """Tile files in name order (path, length); file contents are never read."""
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(path)
        .select("path", "length").orderBy("path")
    )
    return found if limit is None else found.limit(limit)


_MANIFEST = (
    "farm_name string, county string, headcount bigint, longitude double, latitude double, "
    "tile_path string"
)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Site to tile manifest."""
    return spark.read.schema(_MANIFEST).json(path, multiLine=True)


def parse_manifest(texts: DataFrame, value: str = "value") -> DataFrame:
    """Manifest texts (an array of entries each) to a row per entry."""
    entries = F.from_json(F.col(value), f"array<struct<{_MANIFEST.replace(' ', ': ').replace(',:', ',')}>>")
    return texts.select(F.explode(entries).alias("e")).select("e.*")


def scenarios(spark: SparkSession, path: str, n_hubs: Sequence[int] | None = None) -> DataFrame:
    """Scenario tables partitioned by ``n_hubs``; absent scenarios are simply not there."""
    df = spark.read.parquet(path)
    return df if n_hubs is None else df.filter(F.col("n_hubs").isin(*n_hubs))
