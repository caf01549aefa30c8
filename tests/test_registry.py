"""Cleaning, filters, geocoding and small column values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldhub.functions import geo, nutrient, text
from fieldhub.operators import registry as R
from fieldhub.plans.ingest import permit_layer
from fieldhub.sources import readers

HEADER = (
    "Farm Name,Farm Designation,Primary Animal Type,Number of Animals,Status,Farm City,"
    "Farm County,Farm Zip Code,Latitude,Longitude"
)
ROWS = [
    "  North Houses ,cafo, Broiler Chicken,150000,Registered,Hurlock,Dorchester,21643-12,38.62,-75.85",
    "Creek Dairy,mafo,Dairy Cattle,500,Registered,Easton,Talbot,21601,38.77,-76.07",
    "Closed Acres,cafo,Turkey,25000,Closed,Salisbury,Wicomico,21801,38.36,-75.60",
    "Layer Works,cafo,Layer Chicken,not known,Pending,Denton,Caroline,21629,,",
]


@pytest.fixture
def csv_permits(spark, tmp_path):
    path = tmp_path / "permits.csv"
    path.write_text("\n".join([HEADER, *ROWS]))
    return readers.permits_csv(spark, str(path))


def test_csv_is_all_text(csv_permits):
    assert {t for _, t in csv_permits.dtypes} == {"string"}


def test_parse_and_filters(csv_permits):
    permits = R.parse_permits(csv_permits)
    rows = {r["farm_name"]: r for r in permits.collect()}
    first = rows["North Houses"]
    assert first["headcount"] == 150000 and first["animal_type"] == "broiler chicken"
    assert first["designation"] == "CAFO" and first["zip_code"] == "21643"
    assert rows["Layer Works"]["headcount"] == 0 and rows["Layer Works"]["latitude"] is None
    assert R.active(permits).count() == 3
    assert R.in_county(permits, "dorch").count() == 1
    assert R.target_boxes(permits, 1.0).count() == 3
    assert permit_layer(csv_permits, county="Talbot").first()["farm_name"] == "Creek Dairy"


def test_wide_json_and_missing_columns(spark, tmp_path):
    path = tmp_path / "permits.json"
    path.write_text(
        '[{"laying_hens": 120, "dairy_cattle": "7", "ducks": null, "hen_building_qty": 9000,'
        ' "city_state_zip": "Chestertown , MD 21620", "county": null},'
        ' {"laying_hens": "x", "dairy_cattle": 0, "ducks": 0, "city_state_zip": "Elkton", "county": "Cecil"},'
        ' {"laying_hens": 5, "dairy_cattle": 5, "ducks": 1, "city_state_zip": "A, MD 21001"}]'
    )
    raw = readers.permits_json(spark, str(path))
    rows = R.parse_permits(raw).collect()
    assert [(r["headcount"], r["animal_type"]) for r in rows] == [
        (120, "laying_hens"),
        (0, "unknown"),
        (5, "dairy_cattle"),  # columns come in name order, the first of a tie wins
    ]
    assert [r["zip_code"] for r in rows] == ["21620", None, "21001"]
    assert rows[0]["city"] == "Chestertown" and rows[0]["county"] is None
    assert rows[0]["farm_name"] == "Unknown Farm" and rows[0]["status"] == "Unknown"
    assert (rows[0]["latitude"], rows[0]["longitude"]) == (38.80, -75.80)
    assert R.in_county(R.parse_permits(raw), "c").count() == 1  # null county never matches


def test_empty_standard_column_falls_back(spark):
    raw = spark.createDataFrame(
        [("0", "Goat", "12", "3")], ["Headcount", "Animal Type", "Sheep", "Goats"]
    )
    row = R.parse_permits(raw).first()
    assert (row["headcount"], row["animal_type"]) == (12, "sheep")


def test_nan_text_is_missing(spark):
    raw = spark.createDataFrame(
        [("nan", "Goat", "nan", "-76.0"), ("None", "Goat", "38.5", "NaN"), ("7.9", None, "39", "-76")],
        ["Headcount", "Animal Type", "Lat", "Lon"],
    )
    rows = R.parse_permits(raw).collect()
    assert [(r["headcount"], r["latitude"], r["longitude"]) for r in rows] == [
        (0, None, -76.0), (0, 38.5, None), (7, 39.0, -76.0)
    ]
    assert R.located(R.parse_permits(raw)).count() == 1
    none = spark.createDataFrame([("nan", "Goat", "3")], ["Headcount", "Animal Type", "Sheep"])
    assert R.parse_permits(none).first()["animal_type"] == "sheep"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Broiler Chicken", "broiler_chicken"), ("  TURKEY  ", "turkey"), ("dairy", "dairy_cattle"),
        ("hog", "swine"), ("", "unknown"), (None, "unknown"), ("Alpaca", "alpaca"),
    ],
)
def test_canonical_animal(spark, raw, want):
    assert one(spark, text.canonical_animal(F.lit(raw).cast("string")))[0] == want


def test_extended_aliases(spark):
    extra = {"chickens_not_laying_hens": "broiler_chicken"}
    got = one(spark, text.canonical_animal(F.lit("chickens_not_laying_hens"), extra))[0]
    assert got == "broiler_chicken"


def test_nutrient_values(spark):
    row = one(
        spark,
        nutrient.nitrogen_lbs(F.lit("broiler_chicken"), F.lit(150_000)),
        nutrient.phosphate_lbs(F.lit("broiler_chicken"), F.lit(150_000)),
        nutrient.nitrogen_lbs(F.lit("dairy_cattle"), F.lit(500)),
        nutrient.nitrogen_lbs(F.lit("unknown"), F.lit(500)),
        nutrient.nitrogen_lbs(F.lit("swine"), F.lit(0)),
        nutrient.acres(F.lit(4046.86)),
    )
    assert list(row)[:5] == [887_250.0, 614_250.0, 84_000.0, 0.0, 0.0]
    assert row[5] == pytest.approx(1.0, abs=1e-5)


def test_boxes(spark):
    b = geo.box_around(F.lit(-76.0), F.lit(39.0), 2.0)
    df = spark.range(1).select(b.alias("b"))
    row = df.select("b.*", geo.box_center(F.col("b")).alias("c")).first()
    assert row["c"]["x"] == pytest.approx(-76.0) and row["c"]["y"] == pytest.approx(39.0)
    assert row["north"] - row["south"] == pytest.approx(4 / 111)
    assert one(spark, geo.box_text(geo.box(*[F.lit(v) for v in (-76.0, 38.0, -75.0, 39.0)])))[0] == (
        "-76.0,38.0,-75.0,39.0"
    )
    grown = one(spark, geo.grow_box(geo.box(*[F.lit(v) for v in (-76.0, 38.0, -75.0, 39.0)]), 111.0))[0]
    assert (grown["south"], grown["north"]) == (37.0, 40.0) and grown["west"] < -77.0


def test_projections_against_great_circle(spark):
    """Planar distances agree with the sphere to a few tenths of a percent."""
    import math

    pairs = [((-76.1, 38.5), (-75.6, 38.9)), ((-75.9, 38.1), (-76.4, 39.2)), ((-77.0, 39.0), (-76.0, 39.3))]
    for (lon1, lat1), (lon2, lat2) in pairs:
        p1, p2 = math.radians(lat1), math.radians(lat2)
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(
            math.radians(lon2 - lon1) / 2
        ) ** 2
        sphere = 2 * 6371008.8 * math.asin(math.sqrt(h))
        for project, scale in ((geo.utm18, 1.0), (geo.state_plane, geo.METRES_PER_US_FOOT)):
            a, b = project(F.lit(lon1), F.lit(lat1)), project(F.lit(lon2), F.lit(lat2))
            got = one(spark, geo.distance(a[0], a[1], b[0], b[1]))[0] * scale
            assert got == pytest.approx(sphere, rel=4e-3)
    x, y = one(spark, *geo.utm18(F.lit(-75.0), F.lit(0.0)))
    assert (x, y) == (pytest.approx(500000.0), pytest.approx(0.0, abs=1e-6))
    x, y = one(spark, *geo.state_plane(F.lit(-77.0), F.lit(37 + 40 / 60)))
    assert (x, y) == (pytest.approx(400000 * 3937 / 1200), pytest.approx(0.0, abs=1e-3))


def test_return_url(spark):
    df = spark.createDataFrame(
        [("<r><returnURL> http://x/a.tif </returnURL></r>",), ('{"returnURL" : "http://x/b.tif"}',), ("<html>",)],
        ["t"],
    )
    got = [r[0] for r in df.select(text.return_url(F.col("t"))).collect()]
    assert got == ["http://x/a.tif", "http://x/b.tif", None]


def test_geocode_round_trip(spark, tmp_path):
    path = tmp_path / "reply.csv"
    path.write_text(
        '"1","1 Main St, Easton, MD","Match","Exact","1 MAIN ST, EASTON","-76.07,38.77","1","L"\n'
        '"2","2 Main St","No_Match"\n'
        '"3","3 Main St","Match","Exact","3 MAIN","not,numbers"\n'
        "short\n"
        '"4","4 Main","match","Non_Exact","4 MAIN"," -75.5 , 38.2 "\n'
    )
    codes = R.parse_geocode_replies(readers.geocode_replies(spark, str(path)))
    assert sorted(map(tuple, codes.collect())) == [(1, 38.77, -76.07), (4, 38.2, -75.5)]
    permits = spark.createDataFrame(
        [(1, 38.80, -75.80), (4, 39.0, -76.0), (5, None, None)],
        "permit_id bigint, latitude double, longitude double",
    )
    after = R.apply_geocodes(permits, codes, only=R.is_placeholder())
    assert {r["permit_id"]: (r["latitude"], r["longitude"], r["geocoded"]) for r in after.collect()} == {
        1: (38.77, -76.07, True), 4: (39.0, -76.0, False), 5: (None, None, False),
    }


def test_request_batches_number_all_rows(spark):
    rows = [(i, "" if i % 3 == 0 else f"{i} Rd", "Town", "21601") for i in range(0, 400, 2)]
    permits = spark.createDataFrame(rows, "permit_id bigint, address string, city string, zip_code string")
    got = R.geocode_requests(permits, batch_size=30).collect()
    want = {r[0]: pos // 30 for pos, r in enumerate(rows) if r[1]}
    assert {r["permit_id"]: r["batch"] for r in got} == want
    assert {r["line"] for r in got if r["permit_id"] == 2} == {'"2","2 Rd","Town","MD","21601"'}
