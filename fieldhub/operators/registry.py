"""Permit registry: cleaning, filters and geocode updates (all lazy, no actions)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldhub import constants as K
from fieldhub.functions import geo, text


def normalise_names(raw: DataFrame) -> DataFrame:
    return raw.toDF(*text.snake_names(raw.columns))


def _found(df: DataFrame, candidates: list[str]) -> Column | None:
    name = text.first_present(df.columns, candidates)
    return None if name is None else F.col(f"`{name}`")


def _headcount_and_animal(df: DataFrame, assume_standard: bool | None) -> tuple[Column, Column]:
    count_col = _found(df, K.HEADCOUNT_COLUMNS)
    animal_col = _found(df, K.ANIMAL_COLUMNS)
    wide = text.animal_count_columns(df.columns)

    none = (F.lit(0).cast("bigint"), F.lit("unknown"))
    if wide:
        counts = {c: text.to_count(F.col(f"`{c}`")) for c in wide}
        values = list(counts.values())
        best = F.greatest(*values) if len(values) > 1 else values[0]
        fallback = (best, text.argmax_label(counts, best))
    else:
        fallback = none
    if count_col is None or animal_col is None:
        return fallback
    standard = (text.to_count(count_col), F.lower(F.trim(animal_col)))
    if assume_standard is not None:
        return standard if assume_standard else fallback
    # The whole column decides: a scalar subquery, evaluated once when the plan runs.
    total = df.select(F.sum(F.coalesce(text.to_number(count_col), F.lit(0.0)))).scalar()
    usable = F.coalesce(total, F.lit(0.0)) > 0
    return (
        F.when(usable, standard[0]).otherwise(fallback[0]),
        F.when(usable, standard[1]).otherwise(fallback[1]),
    )


def _coordinates(df: DataFrame) -> tuple[Column, Column]:
    lat = lon = None
    for c in df.columns:
        if "latitude" in c or c == "lat":
            lat = c
        elif "longitude" in c or c in ("lon", "lng"):
            lon = c
    if lat is None or lon is None:
        return F.lit(K.PLACEHOLDER_LAT), F.lit(K.PLACEHOLDER_LON)
    return text.to_number(F.col(f"`{lat}`")), text.to_number(F.col(f"`{lon}`"))


def parse_permits(
    raw: DataFrame, id_column: str | None = None, assume_standard: bool | None = None
) -> DataFrame:
    """All-text registry rows to the typed permit table.

    Columns are found on the schema.  Whether the standard headcount column is used
    depends on its total over the table; pass ``assume_standard`` when that is already
    known (needed for streams, saves one scan otherwise).
    """
    df = normalise_names(raw)
    headcount, animal = _headcount_and_animal(df, assume_standard)
    lat, lon = _coordinates(df)
    csz = _found(df, K.CITY_STATE_ZIP_COLUMNS)
    city = _found(df, K.CITY_COLUMNS)
    zip_code = _found(df, K.ZIP_COLUMNS)
    designation = _found(df, K.DESIGNATION_COLUMNS)
    address = _found(df, K.ADDRESS_COLUMNS)

    if city is not None:
        city = F.trim(city)
    elif csz is not None:
        city = text.city_of(csz)
    else:
        city = F.lit("Unknown")
    if zip_code is not None:
        zip_code = text.zip5(zip_code)
    elif csz is not None:
        zip_code = text.zip_of(csz)
    else:
        zip_code = F.lit("00000")

    out = [
        text.trimmed(_found(df, K.NAME_COLUMNS), "Unknown Farm").alias("farm_name"),
        (F.lit("UNKNOWN") if designation is None else F.upper(F.trim(designation)))
        .alias("designation"),
        animal.alias("animal_type"),
        headcount.alias("headcount"),
        text.trimmed(_found(df, K.STATUS_COLUMNS), "Unknown").alias("status"),
        city.alias("city"),
        text.trimmed(_found(df, K.COUNTY_COLUMNS), "Unknown").alias("county"),
        zip_code.alias("zip_code"),
        lat.alias("latitude"),
        lon.alias("longitude"),
    ]
    if address is not None:
        out.append(address.alias("address"))
    if id_column is not None:
        out.insert(0, F.col(id_column).cast("bigint").alias("permit_id"))
    return df.select(*out)


# --- filters -----------------------------------------------------------------
def is_located() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def located(permits: DataFrame) -> DataFrame:
    return permits.filter(is_located())


def active(permits: DataFrame, statuses: Iterable[str] = K.ACTIVE_STATUSES) -> DataFrame:
    return permits.filter(F.col("status").isin(*statuses))


def in_county(permits: DataFrame, part: str) -> DataFrame:
    """Literal, case-insensitive substring match; a missing county never matches."""
    return permits.filter(F.coalesce(F.lower("county").contains(part.lower()), F.lit(False)))


def in_region(permits: DataFrame, region: str) -> DataFrame:
    """'eastern-shore', 'full-state', or one exact county name."""
    if region == "full-state":
        return permits
    counties = K.EASTERN_SHORE if region == "eastern-shore" else [region]
    return permits.filter(F.col("county").isin(*counties))


def is_placeholder() -> Column:
    """Both coordinates equal the stand-in point to two decimals."""
    near = lambda c, v: F.round(F.col(c) * 100) == round(v * 100)
    return F.coalesce(
        near("latitude", K.PLACEHOLDER_LAT) & near("longitude", K.PLACEHOLDER_LON), F.lit(False)
    )


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def explore(
    permits: DataFrame,
    counties: list[str] | None = None,
    animals: list[str] | None = None,
    headcount: tuple[int, int] | None = None,
    statuses: list[str] | None = None,
) -> DataFrame:
    """Any combination of the four explorer filters; all reach the scan."""
    for column, allowed in (("county", counties), ("animal_type", animals), ("status", statuses)):
        if allowed:
            permits = permits.filter(F.col(column).isin(*allowed))
    if headcount:
        permits = permits.filter(F.col("headcount").between(*headcount))
    return permits


def target_boxes(permits: DataFrame, km: float = K.TARGET_BUFFER_KM) -> DataFrame:
    """One analysis box per located permit."""
    return located(permits).withColumn(
        "box", geo.box_around(F.col("longitude"), F.col("latitude"), km)
    )


# --- geocoding tables ----------------------------------------------------------
def dense_index(df: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """Add ``idx`` = 0,1,2,… in the order of a unique numeric key, without one global sort.

    Quantiles split the key range; each bucket is numbered on its own and shifted by the
    number of rows in the buckets before it (``buckets`` rows, hence a safe broadcast).
    """
    cuts = df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.001)
    cuts = sorted(set(cuts))
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + (F.col(key) > c).cast("int")
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_bucket").orderBy(key)
    return (
        tagged.withColumn("_rn", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("idx", F.col("_offset") + F.col("_rn"))
        .drop("_bucket", "_offset", "_rn")
    )


def geocode_requests(
    permits: DataFrame, key: str = "permit_id", state: str = "MD", batch_size: int = K.GEOCODE_BATCH
) -> DataFrame:
    """Request lines ``"id","address","city","state","zip"`` with their batch number.

    Rows are numbered before rows without a usable address are dropped, as a batch is a
    slice of the input.
    """
    shown = lambda c: F.coalesce(F.trim(c), F.lit(""))
    quoted = F.format_string(
        '"%s","%s","%s","%s","%s"',
        F.col(key).cast("string"), shown("address"), shown("city"), F.lit(state), shown("zip_code"),
    )
    return (
        dense_index(permits, key)
        .filter(text.usable_address(F.col("address")))
        .select(
            F.col(key),
            F.floor(F.col("idx") / batch_size).cast("bigint").alias("batch"),
            quoted.alias("line"),
        )
    )


def geocode_place_requests(
    permits: DataFrame, key: str = "permit_id", state: str = "MD", batch_size: int = K.GEOCODE_BATCH
) -> DataFrame:
    """Plain request lines ``id,address,city,state,zip`` of rows that name a city or a ZIP code,
    with or without an address, and their batch number (a slice of the input)."""
    shown = lambda c: F.coalesce(F.trim(c), F.lit(""))
    line = F.concat_ws(
        ",", F.col(key).cast("string"), shown("address"), shown("city"), F.lit(state), shown("zip_code")
    )
    return (
        dense_index(permits, key)
        .filter((shown("city") != "") | (shown("zip_code") != ""))
        .select(F.col(key), F.floor(F.col("idx") / batch_size).cast("bigint").alias("batch"), line.alias("line"))
    )


def parse_geocode_replies(replies: DataFrame) -> DataFrame:
    """Reply columns (id, address, match_flag, …, lon_lat) to (id, lat, lon).

    Unmatched and malformed replies are dropped.
    """
    part = lambda i: text.to_number(F.trim(F.split_part("lon_lat", F.lit(","), F.lit(i))))
    return (
        replies.filter(F.lower(F.trim("match_flag")) == "match")
        .select(F.trim("id").try_cast("bigint").alias("id"), part(2).alias("lat"), part(1).alias("lon"))
        .dropna()
    )


def apply_geocodes(
    permits: DataFrame, geocodes: DataFrame, key: str = "permit_id", only: Column | None = None
) -> DataFrame:
    """Overwrite coordinates where a geocode exists; ``only`` limits which rows may change.

    Adds ``geocoded``.  Several replies for one id collapse to one before the join.
    """
    one = (
        geocodes.groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("_g"))
        .withColumnRenamed("id", key)
    )
    may = F.lit(True) if only is None else only
    hit = F.col("_g").isNotNull() & may
    joined = permits.join(one, key, "left").withColumn("geocoded", hit)
    return (
        joined.withColumn("_lat", F.when(F.col("geocoded"), F.col("_g.lat")).otherwise(F.col("latitude")))
        .withColumn("_lon", F.when(F.col("geocoded"), F.col("_g.lon")).otherwise(F.col("longitude")))
        .drop("_g", "latitude", "longitude")
        .withColumnsRenamed({"_lat": "latitude", "_lon": "longitude"})
    )


def geocode_coverage(before: DataFrame, after: DataFrame) -> DataFrame:
    """Located rows before and after geocoding, and the coverage reached.

    ``after`` is the output of ``apply_geocodes`` on ``before``; one pass over it is enough
    when the two frames share rows, so only ``after`` is scanned.
    """
    now = is_located()
    newly = F.col("geocoded") & now
    n = F.count(F.lit(1))
    return after.agg(
        n.alias("total"),
        F.count_if(now & ~newly).alias("located_before"),
        F.count_if(newly).alias("newly_geocoded"),
        F.count_if(now).alias("located_after"),
        F.count_if(~now).alias("still_missing"),
        F.round(F.count_if(now) * 100.0 / F.nullif(n, F.lit(0)), 6).alias("coverage_pct"),
    )


def pending(requested: DataFrame, existing: DataFrame, key: str = "tile_key") -> DataFrame:
    """Requested work whose output does not exist yet."""
    return requested.join(existing.select(key), key, "left_anti")
