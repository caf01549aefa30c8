"""Detection and segment tables: filters, shapes, fallback boxes, feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhub import constants as K
from fieldhub.functions import geo, text
from fieldhub.operators.spatial import points_in_boxes


def center(b: Column) -> tuple[Column, Column]:
    """Integer midpoint of a pixel box."""
    half = lambda p, q: F.floor((b[p] + b[q]) / 2).cast("int")
    return half("x1", "x2"), half("y1", "y2")


def confident(dets: DataFrame, threshold: float = K.MIN_CONFIDENCE) -> DataFrame:
    return dets.filter(F.col("confidence") >= threshold)


def labelled(dets: DataFrame) -> DataFrame:
    return dets.withColumn("class_name", text.class_label(F.col("class_id")))


def box_shape(dets: DataFrame) -> DataFrame:
    """Area and side lengths of axis-aligned boxes."""
    b = F.col("bbox_px")
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return dets.withColumns({
        "area_px": w * h,
        "long_side": F.greatest(w, h),
        "short_side": F.least(w, h),
        "aspect": F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1)),
    })


def house_like(regions: DataFrame) -> DataFrame:
    """Long, narrow roofs."""
    return regions.filter(
        F.col("area_px").between(150, 4000)
        & (F.col("short_side") >= 1)
        & (F.col("aspect") >= 2.5)
        & F.col("long_side").between(25, 300)
    )


def lagoon_like(regions: DataFrame) -> DataFrame:
    """Compact water bodies."""
    return regions.filter(
        F.col("area_px").between(300, 60000)
        & (F.col("short_side") >= 1)
        & (F.col("aspect") <= 5)
    )


def permit_boxes(
    permits: DataFrame, tiles: DataFrame, pixel: float, width: int, height: int
) -> DataFrame:
    """One fixed-size box per permit and tile that holds it, clipped to the tile.

    ``tiles`` has (tile_path, west, north); its extent follows from the pixel size.
    """
    bounds = tiles.select(
        "tile_path",
        "west",
        (F.col("north") - pixel * height).alias("south"),
        (F.col("west") + pixel * width).alias("east"),
        "north",
    )
    hits = points_in_boxes(
        permits.filter(F.col("longitude").isNotNull() & F.col("latitude").isNotNull()),
        bounds, "longitude", "latitude", cell=max(width, height) * pixel,
    )
    grid = geo.Grid(west=F.col("west"), north=F.col("north"), a=pixel, e=-pixel)
    half = K.FALLBACK_BOX_PX // 2
    px, py = grid.col(F.col("longitude")), grid.row(F.col("latitude"))
    lon, lat = F.col("longitude"), F.col("latitude")
    return (
        hits.withColumns({"px": px, "py": py})
        .withColumn(
            "bbox_px",
            F.struct(
                F.greatest(F.lit(0), F.col("px") - half).alias("x1"),
                F.greatest(F.lit(0), F.col("py") - half).alias("y1"),
                F.least(F.lit(width), F.col("px") + half).alias("x2"),
                F.least(F.lit(height), F.col("py") + half).alias("y2"),
            ),
        )
        .filter((F.col("bbox_px.x2") > F.col("bbox_px.x1")) & (F.col("bbox_px.y2") > F.col("bbox_px.y1")))
        .select(
            F.col("permit_id").alias("source_id"),
            "tile_path",
            "bbox_px",
            geo.box(lon - 0.001, lat - 0.001, lon + 0.001, lat + 0.001).alias("bbox_geo"),
            F.lit(1.0).alias("confidence"),
            F.lit(0).alias("class_id"),
            F.coalesce(F.col("animal_type"), F.lit("afo_structure")).alias("class_name"),
        )
    )


def or_fallback(dets: DataFrame, fallback: DataFrame) -> DataFrame:
    """The detections, or the fallback rows when there is not a single detection."""
    none = dets.limit(1).select((F.count(F.lit(1)) == 0).alias("none")).scalar()
    return dets.unionByName(fallback.filter(none))


def with_sites(dets: DataFrame, manifest: DataFrame, key: str = "tile") -> DataFrame:
    """Attach the attributes of the site each tile was fetched for."""
    return dets.join(manifest, key)


def per_tile(dets: DataFrame, *extra: str) -> DataFrame:
    return dets.groupBy("tile_path", *extra).agg(F.count(F.lit(1)).alias("detections"))


# --- feature rows ----------------------------------------------------------------
def _position(p: Column) -> Column:
    return F.format_string("[%.6f,%.6f]", p["x"], p["y"])


def polygon_geometry(ring: Column) -> Column:
    positions = F.array_join(F.transform(ring, _position), ",")
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), positions, F.lit("]]}"))


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.concat(
        F.lit('{"type":"Point","coordinates":'), _position(geo.point(lon, lat)), F.lit("}")
    )


def feature(geometry: Column, properties: Column) -> Column:
    """One GeoJSON feature as a line of text; ``properties`` is a struct or JSON text."""
    return F.concat(
        F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties,
        F.lit("}"),
    )


def detection_features(dets: DataFrame) -> DataFrame:
    """Box features; rows without a geographic box are dropped."""
    b = F.col("bbox_px")
    properties = F.format_string(
        '{"class_name":%s,"class_id":%d,"confidence":%.4f,"tile":%s,"bbox_px":[%d,%d,%d,%d]}',
        json_text(F.col("class_name")), F.col("class_id"), F.col("confidence"),
        json_text(text.basename(F.col("tile_path"))), b["x1"], b["y1"], b["x2"], b["y2"],
    )
    return dets.filter(F.col("bbox_geo").isNotNull()).withColumn(
        "feature", feature(polygon_geometry(geo.box_ring(F.col("bbox_geo"))), properties)
    )


def polygon_features(segments: DataFrame) -> DataFrame:
    """Segment features; null and empty rings are dropped."""
    properties = F.format_string(
        '{"class_name":%s,"confidence":%.4f,"area_m2":%.2f,"area_acres":%.4f,"tile":%s}',
        json_text(F.col("class_name")), F.col("confidence"), F.col("area_m2"),
        F.col("area_m2") / F.lit(K.SQ_M_PER_ACRE_EXPORT),
        json_text(text.basename(F.col("tile_path"))),
    )
    kept = segments.filter(F.coalesce(F.size("ring") > 0, F.lit(False)))
    return kept.withColumn("feature", feature(polygon_geometry(F.col("ring")), properties))


def point_features(points: DataFrame, *properties: str) -> DataFrame:
    return points.withColumn(
        "feature",
        feature(
            point_geometry(F.col("longitude"), F.col("latitude")),
            F.to_json(F.struct(*properties)),
        ),
    )


def json_text(value: Column) -> Column:
    """A string as JSON text, escapes included."""
    wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)  # strips {"v": and }
