"""Text reports as line tables: (section, ord, line), ordered and written by a sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldhub import constants as K
from fieldhub.functions import nutrient
from fieldhub.functions.text import fixed, grouped
from fieldhub.operators import profiles as A


def _line(section: int, ord_: Column, fmt: str, *args: Column) -> list[Column]:
    return [
        F.lit(section).alias("section"),
        ord_.cast("int").alias("ord"),
        F.format_string(fmt, *args).alias("line"),
    ]


def _rows() -> Column:
    return F.count(F.lit(1))


def _facts(row: DataFrame, section: int, *lines: tuple) -> DataFrame:
    """Several lines from one-row facts."""
    made = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.format_string(fmt, *args).alias("line"))
        for i, (fmt, *args) in enumerate(lines)
    ])
    return row.select(F.explode(made).alias("l")).select(
        F.lit(section).alias("section"), "l.ord", "l.line"
    )


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def baseline_report(permits: DataFrame) -> DataFrame:
    """Data quality, distributions and findings of a permit table."""
    c = F.col
    quality = A.quality(permits)
    parts = [
        _facts(
            quality, 1,
            ("Total AFO Records: %,d", c("records")),
            ("With Valid Coordinates: %,d (%s%%)", c("located"),
             fixed(c("located") * 100.0 / F.nullif(c("records"), F.lit(0)), 1)),
            ("Missing Coordinates: %,d", c("missing")),
            ("With Headcount Data: %,d", c("with_headcount")),
            ("Total Animals: %,d", c("animals")),
        )
    ]
    ranked = F.row_number().over(Window.orderBy(F.desc("animals"), "name"))  # a few groups
    for section, by, n, width in ((2, "animal_type", 5, 30), (3, "county", 10, 20)):
        groups = A.distribution(permits, by).withColumnRenamed(by, "name")
        best = A.top(groups, n, F.desc("animals"), c("name")).withColumn("rn", ranked)
        parts.append(best.select(*_line(
            section, c("rn"), f"%-{width}s: %4d AFOs, %,12d animals (%5s%%)",
            c("name"), c("facilities"), c("animals"), fixed(c("pct"), 1),
        )))
    parts.append(A.size_histogram(permits).select(*_line(
        4, c("ord"), "%-15s: %4d facilities (%5s%%)", c("size_class"), c("facilities"),
        fixed(c("pct"), 1),
    )))
    parts.append(_facts(
        A.baseline_findings(permits), 5,
        ("1. %,d registered AFOs managing %,d animals", c("records"), c("animals")),
        ("2. %s%% of AFOs are concentrated on the Eastern Shore", fixed(c("region_pct"), 1)),
        ("3. %s%% of total animals are chickens", fixed(c("chicken_pct"), 1)),
        ("4. %,d facilities (%s%%) have >100K animals", c("industrial"), fixed(c("industrial_pct"), 1)),
    ))
    return _stack(parts)


def county_reports(permits: DataFrame, assigned: DataFrame | None = None, top_n: int = 10) -> DataFrame:
    """Lines of one report per leading county: (county, section, ord, line)."""
    c = F.col
    summary = A.county_summary(permits)
    leading = F.broadcast(A.top_counties(summary, top_n))  # top_n rows
    mine = permits.join(leading.select("county"), "county", "left_semi")
    row = lambda df, section, ord_, fmt, *args: df.select("county", *_line(section, ord_, fmt, *args))

    def facts(df: DataFrame, section: int, *lines: tuple) -> DataFrame:
        made = F.array(*[
            F.struct(F.lit(i).alias("ord"), F.format_string(fmt, *args).alias("line"))
            for i, (fmt, *args) in enumerate(lines)
        ])
        return df.select("county", F.explode(made).alias("l")).select(
            "county", F.lit(section).alias("section"), "l.ord", "l.line"
        )

    rank = lambda *order: F.row_number().over(Window.partitionBy("county").orderBy(*order))
    parts = [
        facts(
            leading, 1,
            ("Total AFOs: %,d", c("facilities")),
            ("Total Animals: %,d", c("animals")),
            ("Percentage of State Total: %s%%", fixed(c("pct_of_state"), 1)),
            ("Average Animals per AFO: %s", grouped(c("avg_per_facility"))),
        ),
        row(
            A.within_county(mine, "animal_type"), 2, rank(F.desc("animals"), "animal_type"),
            "%-30s: %3d AFOs, %,12d animals (%5s%%)",
            F.trim("animal_type"), c("facilities"), c("animals"), fixed(c("pct_of_county"), 1),
        ),
    ]
    # five counts per county in class order, empty classes included
    label = nutrient.size_label(c("headcount"))
    counted = mine.groupBy("county").agg(_rows().alias("all"), F.array(*[
        F.struct(F.lit(i + 1).alias("ord"), F.lit(name).alias("name"), F.count_if(label == name).alias("n"))
        for i, name in enumerate(K.SIZE_LABELS)
    ]).alias("classes"))
    parts.append(row(
        counted.select("county", "all", F.explode("classes").alias("s")), 3, c("s.ord"),
        "%-15s: %3d facilities (%5s%%)", c("s.name"), c("s.n"), fixed(c("s.n") * 100.0 / c("all"), 1),
    ))
    parts.append(row(
        A.top_per_county(mine, 10), 4, c("rank"), "%-50s %,12d %s",
        F.substring(F.trim("farm_name"), 1, 50), c("headcount"), F.trim("animal_type"),
    ))
    if assigned is not None:
        hubs = A.within_county(
            assigned.join(leading.select("county"), "county", "left_semi"), "assigned_site_idx",
            leading.select("county", "animals"),
        )
        parts.append(row(
            hubs, 5, rank(F.desc("animals"), "assigned_site_idx"),
            "Hub %2d: %3d AFOs, %,12d animals (%5s%%)",
            c("assigned_site_idx"), c("facilities"), c("animals"), fixed(c("pct_of_county"), 1),
        ))
    by_level = lambda texts: F.element_at(F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), v)]), c("priority"))
    ranked = A.county_priority(leading)
    parts.append(facts(
        ranked, 6,
        ("Priority Level: %s", c("priority")),
        ("Reason: %s", by_level({k: F.lit(v) for k, v in K.PRIORITY_REASON.items()})),
        ("AFO Density Score: %s", fixed(c("density_score"), 1)),
        ("Volume Score: %s", fixed(c("volume_score"), 1)),
        ("Industrial Facilities: %s%%", fixed(c("industrial_pct"), 0)),
    ))
    advice = by_level({k: F.array(*map(F.lit, v)) for k, v in K.PRIORITY_ADVICE.items()})
    parts.append(row(
        ranked.select("county", F.posexplode(advice).alias("pos", "text")), 7, c("pos"), "• %s", c("text"),
    ))
    return _stack(parts)


def county_master(permits: DataFrame, top_n: int = 10) -> DataFrame:
    """The leading counties side by side, in report order, with the name of each one's report."""
    c = F.col
    leading = A.top_counties(A.county_summary(permits), top_n)
    rank = F.row_number().over(Window.orderBy(F.desc("animals"), "county"))  # top_n rows
    return leading.select(
        rank.alias("rank"), "county", "facilities", "animals", "pct_of_state", "avg_per_facility",
        c("industrial").alias("industrial_facilities"),
        F.concat(F.replace(c("county"), F.lit(" "), F.lit("_")), F.lit("_report.txt")).alias("report_file"),
    )


def sensitivity_report(flow: DataFrame, transport: DataFrame, construction: DataFrame) -> DataFrame:
    """Summary lines of the base case and of the two cost grids (all small tables)."""
    c = F.col
    m = lambda name: fixed(c(name) / 1_000_000, 1)
    base = _facts(
        flow, 1,
        ("Construction: $%sM", m("construction_cost")),
        ("Annual Transport: $%sM", m("annual_transport_cost")),
        ("Annual Revenue: $%sM", m("total_annual_revenue")),
        ("5-Year NPV: $%sM", m("npv_5yr")),
        ("Payback: %s years", F.when(
            c("payback_years") < float("inf"), fixed(c("payback_years"), 1)
        ).otherwise("Infinity")),
    )
    order = lambda name: F.row_number().over(Window.orderBy(name))  # one row per grid value
    rates = transport.select(*_line(
        2, order("transport_cost_per_km"), "$%s/km: 5-yr cost = $%sM",
        fixed(c("transport_cost_per_km"), 2), m("total_5yr_cost"),
    ))
    costs = construction.select(*_line(
        3, order("construction_cost_per_hub"), "$%sM/hub: Total = $%sM",
        m("construction_cost_per_hub"), m("total_5yr_cost"),
    ))
    return _stack([base, rates, costs])
