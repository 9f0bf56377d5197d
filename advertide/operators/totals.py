"""Reads over series and observations: totals, shares, changes, rankings and bands.

Observations are reduced by grouped partial aggregation before anything is
joined or ordered. The two periods a report needs are found first and filter the
observation scan, so a table partitioned by period reads two partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from advertide.functions.periods import change_struct
from advertide.session import stage


@dataclass(frozen=True)
class Scope:
    """Which series a report reads."""

    source: str
    dataset: str
    edition: str
    levels: tuple[str, ...]
    occupation: str | None = None
    state: str | None = None


def refusal_reason() -> Column:
    """Why a registered source may not be aggregated, null where it may."""
    return (
        F.when(F.col("activation") == "DEVELOPMENT_ONLY", "development fixture")
        .when(F.col("activation") != "ACTIVE", F.concat(F.lit("activation is "), "activation"))
        .when(F.col("compliance_status") != "VERIFIED", F.concat(F.lit("compliance is "), "compliance_status"))
        .when(~F.col("permits_aggregates"), "its licence reserves aggregate use")
    )


def require_aggregable(registry: DataFrame, key: str) -> DataFrame:
    """One row naming the source; the job fails with the reason when its figures may not be published."""
    found = registry.filter(F.col("source_key") == key).agg(
        F.count(F.lit(1)).alias("n"), F.first(refusal_reason(), ignorenulls=True).alias("reason")
    )
    checked = (
        F.when(F.col("n") == 0, F.raise_error(F.lit(f"no source registered as {key}")))
        .when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit(f"{key} may not be aggregated: "), "reason")))
        .otherwise(F.lit(key))
    )
    return found.select(checked.alias("source_key"))


def scoped_series(series: DataFrame, geography: DataFrame, scope: Scope) -> DataFrame:
    """Series in scope with the area each names and the state the area lies in."""
    wanted = series.filter((F.col("source_key") == scope.source) & (F.col("dataset") == scope.dataset))
    if scope.occupation is not None:
        wanted = wanted.filter(F.col("occ_code") == scope.occupation)
    areas = geography.filter(
        (F.col("edition") == scope.edition) & F.col("level").isin(*scope.levels)
    ).select(
        F.col("code").alias("geo_code"),
        F.col("name").alias("geo_name"),
        "level",
        F.col("parent_code").alias("state_code"),
    )
    # Every area hangs directly off its state, so the parent code is the state.
    if scope.state is not None:
        areas = areas.filter(F.col("state_code") == scope.state)
    return wanted.select("series_key", "geo_code", "occ_code", "occ_name").join(areas, "geo_code")


def two_latest(observations: DataFrame, period: str = "period_start") -> DataFrame:
    """The two most recent periods, newest first."""
    return observations.select(period).distinct().orderBy(F.desc(period)).limit(2)


def latest_pair(metric: DataFrame, scoped: DataFrame) -> tuple[Column, Column]:
    """The newest and second newest period in scope, as values a filter can use."""
    periods = (
        metric.join(scoped.select("series_key"), "series_key", "left_semi")
        .select("period_start")
        .distinct()
        .agg(F.sort_array(F.collect_list("period_start"), asc=False).alias("periods"))
    )
    both = periods.select(
        F.struct(
            F.try_element_at("periods", F.lit(1)).alias("latest"),
            F.try_element_at("periods", F.lit(2)).alias("previous"),
        ).alias("pair")
    ).scalar()
    return both["latest"], both["previous"]


def scoped_readings(series: DataFrame, metric: DataFrame, geography: DataFrame, scope: Scope) -> DataFrame:
    """Every series in scope once, with its reading in each of the two latest periods (null where it has none).

    The scope is joined first, so only its observations are grouped, by the key they were joined on.
    """
    scoped = scoped_series(series, geography, scope)
    # The pair does not depend on the state a report narrows to.
    wide = scoped if scope.state is None else scoped_series(series, geography, replace(scope, state=None))
    latest, previous = latest_pair(metric, wide)
    reading = F.struct(F.col("value").alias("value"), F.col("value_state").alias("state"))
    two = metric.filter((F.col("period_start") == latest) | (F.col("period_start") == previous)).select(
        "series_key", (F.col("period_start") == latest).alias("is_latest"), reading.alias("reading")
    )
    return (
        scoped.join(two, "series_key", "left")
        .groupBy(*scoped.columns)
        .agg(
            F.max(F.when(F.col("is_latest"), F.col("reading"))).alias("latest"),
            F.max(F.when(~F.col("is_latest"), F.col("reading"))).alias("previous"),
        )
    )


def region_totals(series: DataFrame, metric: DataFrame, geography: DataFrame, scope: Scope) -> DataFrame:
    """One row per series in scope with its reading in each of the two latest periods."""
    readings = scoped_readings(series, metric, geography, scope)
    change = change_struct(F.col("latest.value"), F.col("previous.value"))
    return readings.select(
        F.col("geo_code").alias("code"),
        F.col("geo_name").alias("name"),
        "level",
        "state_code",
        "occ_code",
        F.col("latest.value").alias("latest_value"),
        F.col("latest.state").alias("latest_state"),
        F.col("previous.value").alias("previous_value"),
        F.col("previous.state").alias("previous_state"),
        change.alias("change"),
    )


def reporting(totals: DataFrame) -> DataFrame:
    """Regions with a row in the latest period, whatever that row says."""
    return totals.filter(F.col("latest_state").isNotNull())


def without_data(totals: DataFrame) -> DataFrame:
    """Regions the latest period says nothing about."""
    return totals.filter(F.col("latest_state").isNull())


def occupation_totals(
    series: DataFrame,
    metric: DataFrame,
    geography: DataFrame,
    scope: Scope,
    by_state: bool = False,
) -> DataFrame:
    """Per occupation: both period sums, regions reporting and regions in scope.

    ``by_state`` groups by state as well, so a report over all states is one
    aggregation and not one query per state.
    """
    keys = ["state_code", "occ_code"] if by_state else ["occ_code"]
    by_area = area_totals(scoped_readings(series, metric, geography, scope))
    grouped = by_area.groupBy(*keys).agg(*_sums()).withColumnRenamed("occ_code", "code")
    scoped = scoped_series(series, geography, scope)
    if by_state:
        in_scope = scoped.groupBy("state_code").agg(F.count_distinct("geo_code").alias("regions_in_scope"))
        return grouped.join(in_scope, "state_code", "left")
    in_scope = scoped.agg(F.count_distinct("geo_code").alias("n")).scalar()
    return grouped.withColumn("regions_in_scope", in_scope)


def area_totals(readings: DataFrame) -> DataFrame:
    """Both period sums per state, occupation and area, for series that name an occupation."""
    # Areas first, occupations from them: counting two distinct columns in one step would triple every row.
    reported = F.col("latest.value").isNotNull() & F.col("geo_code").isNotNull()
    return (
        readings.filter(F.col("occ_code").isNotNull() & (F.col("occ_code") != ""))
        .groupBy("state_code", "occ_code", "geo_code")
        .agg(
            F.min("occ_name").alias("first_name"),
            F.max("occ_name").alias("last_name"),
            F.sum("latest.value").alias("latest"),
            F.sum("previous.value").alias("previous"),
            F.max(reported).alias("reported"),
        )
    )


def _sums() -> list[Column]:
    """What a place's or the nation's row of an occupation sums up from area totals."""
    first_name = F.min("first_name")
    return [
        F.sum("latest").alias("total"),
        F.sum("previous").alias("previous_total"),
        F.count_if("reported").alias("regions_reporting"),
        F.when(first_name == F.max("last_name"), first_name).alias("name"),
    ]


def occupation_cube(
    series: DataFrame, metric: DataFrame, geography: DataFrame, scope: Scope, total_code: str
) -> DataFrame:
    """National and state totals of every occupation from one reading of the observations.

    One row per (state, code) and, with ``national``, one per code, by grouping sets
    over area totals. Beside each stand the total of its place (the place's row of
    ``total_code``, ``totalled`` where it has one, if without a figure), the nation's total of the code, the nation's total, and whether
    the code is one of the finest. Windows run over these few rows, by place and by code.
    """
    by_area = area_totals(scoped_readings(series, metric, geography, scope)).withColumnRenamed("occ_code", "code")
    cube = by_area.groupingSets([["state_code", "code"], ["code"]], "state_code", "code").agg(
        *_sums(), (F.grouping("state_code") == 1).alias("national")
    )
    in_place = Window.partitionBy("national", "state_code")
    cube = cube.withColumn("place_total", F.max(F.when(F.col("code") == total_code, F.col("total"))).over(in_place))
    cube = cube.withColumn("totalled", F.max(F.col("code") == total_code).over(in_place))
    cube = cube.withColumn("finest", finest("code", "national", "state_code"))
    nation = F.struct("total", "place_total", "finest")
    cube = cube.withColumn("nation", F.max(F.when(F.col("national"), nation)).over(Window.partitionBy("code")))
    return cube.select(
        "national",
        "state_code",
        "code",
        "name",
        "total",
        "previous_total",
        "regions_reporting",
        "place_total",
        "totalled",
        F.col("nation.total").alias("national_value"),
        F.col("nation.place_total").alias("national_total"),
        F.col("nation.finest").alias("is_leaf"),
    )


def finest(code: str, *group: str) -> Column:
    """Whether no other code of its group starts with this one; codes are unique in a group.

    In text order, codes that start with a code follow it at once.
    """
    after = F.lead(code).over(Window.partitionBy(*group, F.substring(code, 1, 1)).orderBy(code))
    return ~F.coalesce(F.startswith(after, F.col(code)), F.lit(False))


def occupation_options(series: DataFrame, source: str, dataset: str) -> DataFrame:
    """Every published code and its name, null where the source names it more than one way."""
    return (
        series.filter((F.col("source_key") == source) & (F.col("dataset") == dataset))
        .filter(F.col("occ_code").isNotNull() & (F.col("occ_code") != ""))
        .groupBy(F.col("occ_code").alias("code"))
        .agg(
            F.count_distinct(F.nullif("occ_name", F.lit(""))).alias("names"),
            F.min(F.nullif("occ_name", F.lit(""))).alias("only"),
        )
        .select("code", F.when(F.col("names") == 1, F.col("only")).alias("name"))
    )


def parent_codes(codes: DataFrame, code: str = "code") -> DataFrame:
    """Distinct codes that another code starts with. Prefixes join by equality, so no pair is tried."""
    shorter = (
        codes.filter(F.length(code) > 1)
        .select(
            F.explode(
                F.transform(F.sequence(F.lit(1), F.length(code) - 1), lambda n: F.substring(F.col(code), F.lit(1), n))
            ).alias(code)
        )
        .distinct()
    )
    return codes.select(code).distinct().join(shorter, code, "left_semi")


def leaf_codes(codes: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose code no other published code starts with."""
    return codes.join(parent_codes(codes, code), code, "left_anti")


def with_leaf_flag(codes: DataFrame, code: str = "code") -> DataFrame:
    parents = parent_codes(codes, code).withColumn("has_children", F.lit(True))
    return codes.join(parents, code, "left").select(
        *codes.columns, F.col("has_children").isNull().alias("is_leaf")
    )


def share(part: Column, whole: Column) -> Column:
    """A percentage, null where either side is missing or the whole is zero."""
    return F.when(whole != 0, part / whole * 100)


def concentration(local: Column, local_total: Column, national: Column, national_total: Column) -> Column:
    """Location quotient: how far a local share departs from the national one."""
    usable = (local_total > 0) & (national_total > 0) & (national > 0)
    return F.when(usable, (local / local_total) / (national / national_total))


def state_rollup(totals: DataFrame) -> DataFrame:
    """Region readings summed by state; null where no region of a state reports."""
    return (
        totals.filter(F.col("state_code").isNotNull())
        .groupBy("state_code")
        .agg(
            F.sum("latest_value").alias("total"),
            F.sum("previous_value").alias("previous_total"),
            F.count("latest_value").alias("regions_reporting"),
            F.count(F.lit(1)).alias("regions_in_scope"),
        )
    )


def divergence(cube: DataFrame, left: str, right: str, total_code: str, floor: float) -> DataFrame:
    """How the mixes of two states differ: finest codes both report, at least one at the floor, by share gap."""
    both = cube.filter(~F.col("national") & F.col("state_code").isin(left, right))
    of = lambda state, column: F.max(F.when(F.col("state_code") == state, F.col(column)))
    pairs = both.filter((F.col("code") != total_code) & F.col("is_leaf")).groupBy("code").agg(
        of(left, "name").alias("name"),
        of(left, "total").alias("a_value"),
        of(right, "total").alias("b_value"),
        of(left, "place_total").alias("a_total"),
        of(right, "place_total").alias("b_total"),
    )
    return (
        pairs.filter(F.col("a_value").isNotNull() & F.col("b_value").isNotNull())
        .filter((F.col("a_value") >= floor) | (F.col("b_value") >= floor))
        .withColumn("a_share", F.col("a_value") / F.col("a_total") * 100)
        .withColumn("b_share", F.col("b_value") / F.col("b_total") * 100)
        .withColumn("gap", F.col("a_share") - F.col("b_share"))
        .drop("a_total", "b_total")
    )


def movers(totals: DataFrame, count: int, percent_floor: float) -> DataFrame:
    """The largest rises and falls among codes with both periods; no percentage on a small base."""
    moved = (
        totals.filter(F.col("total").isNotNull() & F.col("previous_total").isNotNull())
        .withColumn("absolute", F.col("total") - F.col("previous_total"))
        .withColumn(
            "percent",
            F.when(F.col("previous_total") >= percent_floor, F.col("absolute") / F.col("previous_total") * 100),
        )
    )
    sided = moved.filter("absolute <> 0").withColumn("side", F.when(F.col("absolute") > 0, "RISER").otherwise("FALLER"))
    largest = Window.partitionBy("side").orderBy(F.desc(F.abs("absolute")), "code")
    ranked = sided.withColumn("place", F.row_number().over(largest)).filter(F.col("place") <= count)
    return ranked.orderBy(F.desc("side"), "place").drop("place")


def position_of(ranked: DataFrame, key: str, wanted: str, value: str) -> DataFrame:
    """Where one item stands among items with a value ("k of n"), by counting, without ordering them."""
    target = ranked.filter(F.col(key) == wanted).agg(F.max(value).alias("v")).scalar()
    ahead = (F.col(value) > target) | ((F.col(value) == target) & (F.col(key) < wanted))
    present = ranked.filter(F.col(value).isNotNull())
    return present.agg(
        F.when(F.max(F.when(F.col(key) == wanted, F.lit(1))).isNotNull(), F.count_if(ahead) + 1).alias("position"),
        F.count(F.lit(1)).alias("of"),
    ).select(F.lit(wanted).alias(key), "position", "of")


def with_share_of_maximum(df: DataFrame, value: str) -> DataFrame:
    top = df.agg(F.max(value).alias("m")).scalar()
    return df.withColumn("of_maximum", F.col(value) / top)


def value_positions(values: DataFrame, value: str, slices: int | None = None) -> DataFrame:
    """Each distinct value with how many rows hold it and how many rows come before it.

    Exact at any size: values are counted first and dealt in value order over ``slices`` tasks, by
    default as many as a shuffle has (ranges are sampled; which range a value fell in is written with
    it, so a task that runs again cannot disagree). Running counts are taken inside a range, and the
    ranges' own totals, one row each, are summed last. No task sees all values.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranged = counted.repartitionByRange(slices, value) if slices else counted.repartitionByRange(value)
    sliced = stage(ranged.withColumn("slice", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy("slice")
        .agg(F.sum("n").alias("in_slice"))
        .withColumn("start", F.coalesce(F.sum("in_slice").over(across), F.lit(0)))
        .drop("in_slice")
    )
    return (
        sliced.withColumn("before_in_slice", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(starts, "slice")
        .select(value, "n", (F.col("start") + F.col("before_in_slice")).alias("before"))
    )


def quantile_bands(values: DataFrame, value: str, count: int) -> DataFrame:
    """Up to ``count`` bands of equal numbers of values, picked by index; equal bands are merged."""
    placed = value_positions(values, value)
    total = values.agg(F.count(value).alias("n")).scalar()
    steps = F.sequence(F.lit(0), F.lit(count - 1))
    holds = lambda index: (index >= F.col("before")) & (index < F.col("before") + F.col("n"))
    first_index = lambda k: F.floor(k * (total / count))
    last_index = lambda k: F.least(total - 1, F.ceil((k + 1) * (total / count)) - 1)
    picks = (
        placed.withColumn("step", F.explode(steps))
        .select(
            "step",
            F.when(holds(first_index(F.col("step"))), F.col(value)).alias("low"),
            F.when(holds(last_index(F.col("step"))), F.col(value)).alias("high"),
        )
        .groupBy("step")
        .agg(F.max("low").alias("low"), F.max("high").alias("high"))
        .filter(F.col("low").isNotNull() & F.col("high").isNotNull())
    )
    # At most ``count`` rows from here on.
    earlier = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    kept = picks.withColumn("reached", F.max("high").over(earlier)).filter(
        F.col("reached").isNull() | (F.col("high") > F.col("reached"))
    )
    return kept.select(
        (F.row_number().over(Window.orderBy("step")) - 1).alias("band"), "low", "high"
    )


def assign_bands(df: DataFrame, value: str, bands: DataFrame) -> DataFrame:
    """The first band whose top a value does not pass; values beyond the last take the last."""
    tops = bands.agg(F.sort_array(F.collect_list("high")).alias("tops")).scalar()
    passed = F.size(F.filter("tops", lambda top: top < F.col(value)))
    band = F.when(F.col(value).isNotNull() & (F.size("tops") > 0), F.least(passed, F.size("tops") - 1))
    return df.withColumn("tops", tops).withColumn("band", band).drop("tops")


def with_change(metric: DataFrame, series: str = "series_key") -> DataFrame:
    """Each observation beside the one before it in its series, with the change between them."""
    in_series = Window.partitionBy(series).orderBy("period_start")
    return metric.withColumn("previous_value", F.lag("value").over(in_series)).withColumn(
        "change", change_struct(F.col("value"), F.col("previous_value"))
    )


def area_summary(series: DataFrame, metric: DataFrame) -> DataFrame:
    """The refreshed summary table: value, change and rank per area, measure, basis, period and occupation."""
    changed = with_change(metric.select("series_key", "period_start", "value", "value_state"))
    facts = changed.join(series.select("series_key", "geo_code", "occ_code", "measure", "basis"), "series_key")
    peers = Window.partitionBy("measure", "basis", "period_start", "occ_code")
    return facts.select(
        "geo_code",
        "measure",
        "basis",
        "period_start",
        "occ_code",
        "value",
        "value_state",
        F.col("change.absolute").alias("change"),
        F.col("change.percent").alias("change_percent"),
        F.when(
            F.col("value").isNotNull(), F.rank().over(peers.orderBy(F.col("value").desc_nulls_last()))
        ).alias("position"),
        F.count("value").over(peers).alias("sample_size"),
    )


def keep_recent(metric: DataFrame, count: int) -> DataFrame:
    """Observations of the ``count`` newest periods across all series."""
    newest = metric.select("period_start").distinct().orderBy(F.desc("period_start")).limit(count)
    return metric.join(newest, "period_start", "left_semi")


def retention_outcome(metric: DataFrame, count: int) -> DataFrame:
    """Each period with its row count and whether retention keeps it."""
    sizes = metric.groupBy("period_start").agg(F.count(F.lit(1)).alias("rows"))
    newest = sizes.select("period_start").orderBy(F.desc("period_start")).limit(count)
    kept = newest.withColumn("kept", F.lit(True))
    return sizes.join(kept, "period_start", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def unresolved_dimensions(series: DataFrame, source: str) -> DataFrame:
    """What a source stated that no area answers to, with how many series state it."""
    return (
        series.filter((F.col("source_key") == source) & F.col("resolved_code").isNull())
        .groupBy(F.col("stated_code").alias("code"), F.col("stated_name").alias("name"))
        .agg(F.count(F.lit(1)).alias("series_count"))
    )


def location_quotients(cube: DataFrame, total_code: str) -> DataFrame:
    """Each state's occupations with how far their share departs from the nation's; states without a total row are left out."""
    local = cube.filter(~F.col("national") & (F.col("code") != total_code) & F.col("totalled"))
    quotient = concentration(F.col("total"), F.col("place_total"), F.col("national_value"), F.col("national_total"))
    return local.withColumn("quotient", quotient)


def specialisms(cube: DataFrame, total_code: str, floor: float, per_state: int) -> DataFrame:
    """The most over-represented finest codes of each state, above the floor and above the nation."""
    scored = location_quotients(cube, total_code).filter(
        F.col("is_leaf") & (F.col("total") >= floor) & (F.col("quotient") > 1)
    )
    # One row per occupation of a state, so a partition is as large as the classification.
    best = Window.partitionBy("state_code").orderBy(F.desc("quotient"), "code")
    return scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= per_state)
