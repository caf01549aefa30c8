"""Readers and writers on real files."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldhub.fixtures import tables as T
from fieldhub.operators import detections as D
from fieldhub.operators import registry as R
from fieldhub.plans import demand as demand_plan
from fieldhub.plans import reports
from fieldhub.sources import readers, writers
from fieldhub.streaming import ingest as stream_ingest


def lines_of(path: Path) -> list[str]:
    return [
        line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()
    ]


def test_point_features_round_trip(spark, sf, tmp_path):
    points = R.located(T.permit(spark, sf))
    out = str(tmp_path / "points")
    writers.features(D.point_features(points, "permit_id", "county", "headcount"), out)
    parsed = [json.loads(line) for line in lines_of(Path(out))]
    assert len(parsed) == points.count() and parsed[0]["geometry"]["type"] == "Point"
    schema = "permit_id bigint, county string, headcount bigint"
    back = readers.feature_points(readers.features(spark, out, schema, lines=True))
    joined = back.alias("b").join(points.alias("p"), "permit_id")
    assert joined.filter(
        "abs(b.longitude - p.longitude) > 1e-6 or abs(b.latitude - p.latitude) > 1e-6"
    ).count() == 0 and joined.count() == points.count()


def test_feature_collection(spark, tmp_path):
    path = tmp_path / "fc.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-76.0, 38.5]}, "properties": {"name": "a"}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [
            [[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]}, "properties": {"name": "b"}},
        {"type": "Feature", "geometry": None, "properties": {"name": "c"}},
    ]}, indent=2))
    df = readers.features(spark, str(path), "name string")
    pts = {r["name"]: (r["longitude"], r["latitude"]) for r in readers.feature_points(df).collect()}
    assert pts == {"a": (-76.0, 38.5), "b": (None, None), "c": (None, None)}
    ring = readers.setbacks(spark, str(path), "name string").first()
    assert ring["name"] == "b" and [len(r) for r in ring["rings"]] == [4, 4]


def test_feature_escapes_and_dropped_rows(spark):
    dets = spark.createDataFrame(
        [((1, 2, 3, 4), (-76.0, 38.0, -75.0, 39.0), 0.123456, 0, 'a "quoted" name', "/x/y/t.tif"),
         ((1, 2, 3, 4), None, 0.5, 0, "gone", "/x/y/t.tif")],
        "bbox_px struct<x1:int,y1:int,x2:int,y2:int>, "
        "bbox_geo struct<west:double,south:double,east:double,north:double>, "
        "confidence double, class_id int, class_name string, tile_path string",
    )
    feature, = [json.loads(r["feature"]) for r in D.detection_features(dets).collect()]
    assert feature["properties"]["class_name"] == 'a "quoted" name'
    assert feature["properties"]["confidence"] == 0.1235 and feature["properties"]["tile"] == "t.tif"
    ring = feature["geometry"]["coordinates"][0]
    assert len(ring) == 5 and ring[0] == ring[-1] == [-76.0, 38.0]


def test_center(spark):
    dets = spark.createDataFrame([((100, 200, 300, 400),)], "b struct<x1:int,y1:int,x2:int,y2:int>")
    assert tuple(dets.select(*D.center(F.col("b"))).first()) == (200, 300)


def test_summaries(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Title\nHubs: 10\n  annual_transport_cost: 6,032,374.14\nnote: a: b\n")
    (tmp_path / "b.txt").write_text("annual_transport_cost: n/a\n")
    df = readers.summaries(spark, str(tmp_path), ["annual_transport_cost", "hubs"])
    got = {Path(r["file"]).name: (r["annual_transport_cost"], r["hubs"]) for r in df.collect()}
    assert got == {"a.txt": (6032374.14, 10.0), "b.txt": (None, None)}


def test_tiles_manifest_pending(spark, tmp_path):
    for name in ("c.tif", "a.tif", "b.tif", "x.txt"):
        (tmp_path / name).write_bytes(b"0123")
    found = readers.tiles(spark, str(tmp_path), limit=2).collect()
    assert [Path(r["path"]).name for r in found] == ["a.tif", "b.tif"] and found[0]["length"] == 4
    wanted = spark.createDataFrame([("a.tif",), ("z.tif",)], "tile_key string")
    have = readers.tiles(spark, str(tmp_path)).select(
        F.element_at(F.split("path", "/"), -1).alias("tile_key")
    )
    assert [r[0] for r in R.pending(wanted, have).collect()] == ["z.tif"]
    (tmp_path / "m.json").write_text(json.dumps([{"farm_name": "F", "headcount": 5, "tile_path": "/t/a.tif"}]))
    row = readers.manifest(spark, str(tmp_path / "m.json")).first()
    assert (row["farm_name"], row["headcount"], row["county"]) == ("F", 5, None)


def test_scenarios_prune_and_skip_missing(spark, tmp_path):
    df = spark.createDataFrame([(8, 1), (10, 2), (10, 3)], "n_hubs int, site_id int")
    path = str(tmp_path / "s")
    writers.scenarios(df, path)
    assert readers.scenarios(spark, path, [10, 12]).count() == 2
    assert readers.layer(spark, path).count() == 3


def test_reports_and_tables(spark, sf, tmp_path):
    permits = T.permit(spark, sf)
    writers.report(reports.baseline_report(permits), str(tmp_path / "r"))
    lines = lines_of(tmp_path / "r")
    assert lines[0].startswith("Total AFO Records: ") and lines[-1].startswith("4. ")
    writers.county_reports(reports.county_reports(permits), str(tmp_path / "c"))
    folders = sorted(p.name for p in (tmp_path / "c").glob("county_key=*"))
    assert len(folders) == 10 and any("Queen_Anne" in f for f in folders)
    one = lines_of(tmp_path / "c" / folders[0])
    assert one[0].startswith("Total AFOs: ") and one[-1].startswith("• ")
    writers.table(permits.select("permit_id", "headcount"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == permits.count()


def test_request_batches_and_layers(spark, sf, tmp_path):
    permits = R.parse_permits(T.raw_registry(spark, sf), "permit_id")
    requests = R.geocode_requests(permits, batch_size=40)
    writers.geocode_batches(requests, str(tmp_path / "b"))
    back = spark.read.text(str(tmp_path / "b"))
    assert back.count() == requests.count()
    assert back.groupBy("batch").count().agg(F.max("count")).first()[0] <= 40
    writers.layer(permits, str(tmp_path / "l"))
    assert readers.layer(spark, str(tmp_path / "l")).dtypes == permits.dtypes


def test_demand_sink(spark, sf, tmp_path):
    out = demand_plan.build(
        T.raster(spark, sf), T.setback(spark, sf), 100, 100, str(tmp_path / "d")
    )
    back = readers.raster(spark, str(tmp_path / "d"))
    assert set(back.columns) == {"tile_id", "row", "col", "n_demand", "p_demand"}
    assert back.count() == out.filter("n_demand > 0 or p_demand > 0").count()
    rgb_path = str(tmp_path / "rgb")
    writers.layer(T.rgb(spark, sf).withColumn("nir", F.lit(1)), rgb_path)
    assert readers.rgb(spark, rgb_path).columns == ["tile_id", "row", "col", "r", "g", "b"]


def test_permit_stream_equals_batch(spark, sf, tmp_path):
    raw = T.raw_registry(spark, sf)
    writers.table(raw, str(tmp_path / "in"))
    batch = readers.permits_csv(spark, str(tmp_path / "in"))
    stream = stream_ingest.permit_stream(spark, str(tmp_path / "in"), batch.schema)
    assert stream.isStreaming
    query = stream_ingest.land(
        stream_ingest.clean(stream, "permit_id"), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    query.awaitTermination(120)
    landed = spark.read.parquet(str(tmp_path / "out"))
    want = R.active(R.parse_permits(batch, "permit_id"))
    assert landed.count() == want.count()
    assert landed.exceptAll(want).count() == 0


def test_cuts_go_to_the_checkpoint_folder(spark, monkeypatch, tmp_path):
    from fieldhub import session

    monkeypatch.setattr(session, "checkpoint_root", lambda s: str(tmp_path))
    scratch = session.Scratch(spark, "loop", keep=2)
    df = spark.range(5)
    for _ in range(4):
        df = scratch.cut(df.select((F.col("id") + 1).alias("id")))
    assert sorted(r["id"] for r in df.collect()) == [4, 5, 6, 7, 8]
    kept = sorted(p.name for p in next(tmp_path.iterdir()).iterdir())
    assert kept == ["g2", "g3"]


def test_small_table(spark):
    from fieldhub.session import small_table

    rows = [(1, 2.5, "it's"), (2, 1e21, "b")]
    df = small_table(spark, rows, {"a": "bigint", "b": "double", "c": "string"})
    assert [tuple(r) for r in df.collect()] == rows
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string"]


def test_scratch_is_left_empty(spark):
    from fieldhub.session import Scratch, checkpoint_root, drop_scratch

    drop_scratch(spark)
    cut = Scratch(spark, "left").cut(spark.range(3))
    assert cut.count() == 3
    drop_scratch(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_root(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert not [s for s in files.listStatus(path) if s.getPath().getName().startswith("left-")]


def test_a_cluster_must_name_a_shared_folder():
    from fieldhub.session import checkpoint_root

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())
