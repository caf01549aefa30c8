"""Sinks: features, layers, tables, rasters, reports and request batches.

All writes are parallel; a sink with an order keeps it across part files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One GeoJSON feature per line (column ``feature``)."""
    df.select("feature").write.mode(mode).text(path)


def layer(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def scenarios(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scenario rows under one folder per hub count."""
    df.write.mode(mode).partitionBy("n_hubs").parquet(path)


def table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report table as CSV with a header."""
    df.write.mode(mode).csv(path, header=True)


def demand(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """N and P2O5 demand pixels under one folder per tile; pixels without demand are left
    out, as 0 is the raster's no-data value."""
    kept = df.filter("n_demand > 0 or p_demand > 0")
    kept.select("tile_id", "row", "col", "n_demand", "p_demand").write.mode(mode).partitionBy(
        "tile_id"
    ).parquet(path)


def report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report lines in (section, ord) order."""
    lines.orderBy("section", "ord").select("line").write.mode(mode).text(path)


def county_reports(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per county, named with underscores, lines in order.

    A county's report is a few dozen lines, so each is one file.
    """
    keyed = lines.withColumn("county_key", F.regexp_replace("county", " ", "_"))
    (
        keyed.repartition("county_key")
        .sortWithinPartitions("county_key", "section", "ord")
        .select("county_key", "line")
        .write.mode(mode).partitionBy("county_key").text(path)
    )


def geocode_batches(requests: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per request batch; the batch size bounds each file."""
    requests.repartition("batch").select("batch", "line").write.mode(mode).partitionBy(
        "batch"
    ).text(path)
