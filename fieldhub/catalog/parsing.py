"""Parsing of the text inputs: the tables written as text, read back, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhub.catalog.registry import query
from fieldhub.fixtures import tables as T
from fieldhub.fixtures.views import with_views
from fieldhub.operators import embeddings
from fieldhub.sources import readers

RECORD = ["Permit ID", "Farm Name", "Status", "Farm County", "Number of Animals"]


def _records(spark, d):
    """Registry records with quotes, commas and line-safe text in the names."""
    name = F.concat(F.lit('"A", '), F.col("Farm Name"))
    return T.raw_registry(spark, d).withColumn("Farm Name", name).select(*RECORD)


_EXPECTED = """
SELECT permit_id, trim('"A",   ' || c_name) AS farm_name, status, county, {count} AS animals FROM registry JOIN customer ON c_custkey = permit_id"""


def _typed(rows):
    return rows.select(
        F.col("Permit ID").cast("bigint").alias("permit_id"), F.trim("Farm Name").alias("farm_name"),
        F.trim("Status").alias("status"), F.col("Farm County").alias("county"), F.col("Number of Animals").alias("animals"))


@query("parse_csv", with_views(["registry"], _EXPECTED.format(count="animals_text")))
def parse_csv(spark, d):
    lines = _records(spark, d).select(F.to_csv(F.struct(*RECORD), {"quote": '"', "escape": '"'}).alias("value"))
    return _typed(readers.parse_permits_csv(lines, RECORD))


@query("parse_json", with_views(["registry"], _EXPECTED.format(count="animals_text")))
def parse_json(spark, d):
    texts = _records(spark, d).select(F.to_json(F.array(F.struct(*RECORD))).alias("value"))
    return _typed(readers.parse_permits_json(texts, RECORD))


@query("parse_features", with_views(["permit"], """
SELECT permit_id, county, longitude, latitude FROM permit WHERE permit_id % 97 <> 1"""))
def parse_features(spark, d):
    """Collections of one feature each; those without a place have no geometry, some collections are empty."""
    place = F.when(F.col("longitude").isNotNull(), F.struct(
        F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), place.alias("geometry"), F.struct("permit_id", "county").alias("properties"))
    some = F.when(F.col("permit_id") % 97 != 1, F.array(feature)).otherwise(F.filter(F.array(feature), lambda x: F.lit(False)))
    texts = T.permit(spark, d).select(F.to_json(F.struct(
        F.lit("FeatureCollection").alias("type"), some.alias("features"))).alias("value"))
    return readers.feature_points(readers.parse_features(texts, "permit_id bigint, county string"))


@query("parse_summaries", with_views(["permit"], """
SELECT county AS file, count(*)::DOUBLE AS facilities, sum(headcount)::DOUBLE AS "total animals", NULL::DOUBLE AS "avg distance"
FROM permit GROUP BY county"""))
def parse_summaries(spark, d):
    """Reports of a county with thousands commas, a heading and an unreadable value."""
    sums = T.permit(spark, d).groupBy("county").agg(F.count(F.lit(1)).alias("n"), F.sum("headcount").alias("animals"))
    lines = F.array(
        F.lit("SUMMARY"), F.format_string("Facilities: %,d", "n"), F.format_string("  Total Animals : %,d ", "animals"),
        F.lit("Avg Distance: n/a"))
    return readers.parse_summaries(
        sums.select(F.col("county").alias("file"), F.explode(lines).alias("value")),
        ["facilities", "total animals", "avg distance"])


@query("parse_manifest", with_views(["permit"], """
SELECT trim(farm_name) AS farm_name, county, headcount, longitude, latitude, '/tiles/' || permit_id || '.tif' AS tile_path FROM permit"""))
def parse_manifest(spark, d):
    entry = F.struct(
        F.trim("farm_name").alias("farm_name"), "county", "headcount", "longitude", "latitude",
        F.concat(F.lit("/tiles/"), F.col("permit_id").cast("string"), F.lit(".tif")).alias("tile_path"))
    return readers.parse_manifest(T.permit(spark, d).select(F.to_json(F.array(entry)).alias("value")))


@query("band_vectors", with_views(["embedding"], """
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i:
  CASE WHEN (i - 1) % 9 = 8 OR vector IS NULL THEN 0.0::DOUBLE ELSE vector[i]::DOUBLE * i END)), 6) AS weighted,
  64 AS bands FROM embedding"""))
def band_vectors(spark, d):
    """Vectors given as band columns of either name; every ninth band is absent."""
    given = T.embedding(spark, d)
    names = [(i, f"embedding_{i}" if i % 2 else f"b{i}") for i in range(64) if i % 9 != 8]
    wide = given.select("vec_id", *(F.get("vector", F.lit(i)).alias(name) for i, name in names))
    vector = embeddings.from_bands(wide)
    total = F.aggregate(
        F.transform(vector, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return wide.select("vec_id", F.round(total, 6).alias("weighted"), F.size(vector).alias("bands"))
