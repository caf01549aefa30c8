"""Descriptive aggregations: distributions, county profiles, hub tables, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldhub import constants as K
from fieldhub.functions import nutrient
from fieldhub.operators.registry import is_located


def _rows() -> Column:
    return F.count(F.lit(1))


def _share(part: Column, whole: Column) -> Column:
    return part * 100.0 / F.nullif(whole, F.lit(0))


def _whole(column: str) -> Column:
    """Sum over all groups.  Only tables of one row per group are summed this way, so the
    input is read once and the window holds the groups."""
    return F.sum(column).over(Window.partitionBy())


def distribution(permits: DataFrame, by: str) -> DataFrame:
    """Facilities and animals per value of ``by`` and the share of all animals."""
    groups = permits.groupBy(by).agg(_rows().alias("facilities"), F.sum("headcount").alias("animals"))
    return groups.withColumn("pct", _share(F.col("animals"), _whole("animals")))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def size_histogram(permits: DataFrame) -> DataFrame:
    """Facilities per size class, empty classes included, in class order."""
    labels = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(s).alias("size_class"))
        for i, s in enumerate(K.SIZE_LABELS)
    ])
    counts = permits.groupBy(nutrient.size_label(F.col("headcount")).alias("size_class")).agg(
        _rows().alias("facilities")
    )
    shares = counts.withColumn("pct", _share(F.col("facilities"), _whole("facilities"))).filter(
        "size_class is not null"
    )
    spark = permits.sparkSession
    classes = spark.range(1).select(F.explode(labels).alias("l")).select("l.*")
    return classes.join(F.broadcast(shares), "size_class", "left").select(
        "ord", "size_class",
        F.coalesce("facilities", F.lit(0)).alias("facilities"),
        F.coalesce("pct", F.lit(0.0)).alias("pct"),
    )


def quality(permits: DataFrame) -> DataFrame:
    return permits.agg(
        _rows().alias("records"),
        F.count_if(is_located()).alias("located"),
        F.count_if(~is_located()).alias("missing"),
        F.count_if(F.col("headcount") > 0).alias("with_headcount"),
        F.sum("headcount").alias("animals"),
    )


def county_summary(permits: DataFrame) -> DataFrame:
    """Facilities, animals, share, mean size and industrial sites per county."""
    groups = permits.groupBy("county").agg(
        _rows().alias("facilities"),
        F.sum("headcount").alias("animals"),
        F.count_if(F.col("headcount") > K.INDUSTRIAL_HEADCOUNT).alias("industrial"),
    )
    return groups.withColumns({
        "pct_of_state": _share(F.col("animals"), _whole("animals")),
        "avg_per_facility": F.col("animals") / F.col("facilities"),
    })


def top_counties(summary: DataFrame, n: int = 10) -> DataFrame:
    return top(summary, n, F.desc("animals"), F.col("county"))


def county_priority(summary: DataFrame) -> DataFrame:
    """Density, volume and industrial share combined into HIGH / MEDIUM / LOW."""
    density = F.col("facilities") / 100
    volume = F.col("animals") / 10_000_000
    industrial = F.col("industrial") * 100.0 / F.col("facilities")
    score = density + volume + industrial / 10
    return summary.select(
        "county",
        density.alias("density_score"),
        volume.alias("volume_score"),
        industrial.alias("industrial_pct"),
        score.alias("priority_score"),
        F.when(score > 5, "HIGH").when(score > 2, "MEDIUM").otherwise("LOW").alias("priority"),
    )


def within_county(rows: DataFrame, by: str, counties: DataFrame | None = None) -> DataFrame:
    """Facilities and animals per county and ``by``, with the share of the county's animals.

    ``counties`` (county, animals) gives the totals when they cover more than ``rows``.
    """
    groups = rows.groupBy("county", by).agg(
        _rows().alias("facilities"), F.sum("headcount").alias("animals")
    )
    if counties is None:
        counties = rows.groupBy("county").agg(F.sum("headcount").alias("animals"))
    totals = counties.select("county", F.col("animals").alias("_all"))
    return (
        groups.join(totals, "county")
        .withColumn("pct_of_county", _share(F.col("animals"), F.col("_all")))
        .drop("_all")
    )


def top_per_county(permits: DataFrame, n: int = 10) -> DataFrame:
    """The n largest facilities of each county (Spark prunes each group before the shuffle)."""
    order = Window.partitionBy("county").orderBy(F.desc("headcount"), "permit_id")
    return permits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def zone_totals(assigned: DataFrame, hubs: DataFrame) -> DataFrame:
    """Facilities and animals per hub; a hub without facilities shows zeros."""
    loads = (
        assigned.filter("assigned_site_idx >= 0")
        .groupBy(F.col("assigned_site_idx").alias("site_id"))
        .agg(_rows().alias("zone_afos"), F.sum("headcount").alias("zone_animals"))
    )
    return hubs.join(loads, "site_id", "left").withColumns({
        "zone_afos": F.coalesce("zone_afos", F.lit(0)),
        "zone_animals": F.coalesce("zone_animals", F.lit(0)),
    })


def zone_balance(assigned: DataFrame) -> DataFrame:
    """Each hub's share of the served facilities and of all animals."""
    groups = assigned.groupBy("assigned_site_idx").agg(
        _rows().alias("n"), F.sum("headcount").alias("animals")
    )
    served = F.when(F.col("assigned_site_idx") >= 0, F.col("n"))
    return (
        groups.withColumns({
            "pct_afos": _share(F.col("n"), F.sum(served).over(Window.partitionBy())),
            "pct_animals": _share(F.col("animals"), _whole("animals")),
        })
        .filter("assigned_site_idx >= 0")
        .select(F.col("assigned_site_idx").alias("site_id"), "pct_afos", "pct_animals")
    )


def hub_summary(zones: DataFrame, capacity: int = K.HUB_CAPACITY) -> DataFrame:
    used = F.col("zone_animals") / capacity * 100
    return zones.withColumn("capacity_pct", F.round(used, 0))


def hubs_by_county(hubs: DataFrame) -> DataFrame:
    return hubs.groupBy("county").agg(
        _rows().alias("hubs"),
        F.sum("zone_afos").alias("total_afos"),
        F.sum("zone_animals").alias("total_animals"),
    )


def baseline_findings(permits: DataFrame) -> DataFrame:
    n, animals = _rows(), F.sum("headcount")
    chicken = F.coalesce(F.lower("animal_type").contains("chicken"), F.lit(False))
    industrial = F.col("headcount") > K.INDUSTRIAL_HEADCOUNT
    return permits.agg(
        n.alias("records"),
        animals.alias("animals"),
        _share(F.count_if(F.col("county").isin(*K.EASTERN_SHORE)), n).alias("region_pct"),
        _share(F.coalesce(F.sum(F.when(chicken, F.col("headcount"))), F.lit(0)), animals)
        .alias("chicken_pct"),
        F.count_if(industrial).alias("industrial"),
        _share(F.count_if(industrial), n).alias("industrial_pct"),
    )


def map_markers(assigned: DataFrame) -> DataFrame:
    return assigned.withColumns({
        "radius": nutrient.marker_radius(F.col("headcount")),
        "simple_radius": nutrient.simple_radius(F.col("headcount")),
        "colour": nutrient.hub_colour(F.col("assigned_site_idx")),
    })
